import re

from corpusframe.llm import quality_rules as Q
from tests.llm.fixtures import awkward, docs_of


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where, covered = {}, set()
    for i in range(len(words) - 4):
        where.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in where.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures_match_brute_force(spark):
    rows = awkward() + [(50, "a b c d e a b c d e f g"), (51, "x y z v w " * 3 + "\n# $ % x\n# $ % x"), (52, "one two three four five"), (53, "\n\n x \n x \n x ")]
    got = Q.quality_report(docs_of(spark, rows)).collect()
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(((r["doc_id"], *[r[f] for f in fields]) for r in got), key=str) == sorted(((r[0], *slow(r[1])) for r in rows), key=str)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_rules_reject_junk_and_keep_prose(spark):
    prose = "It was the best of times and it was the worst of days for all who lived in that town by the sea."
    rows = [(1, prose), (2, " ".join(f"{w}###" for w in prose.split())), (3, "Kurz ist das Leben und lang ist die Kunst, sagt der Arzt zu mir.")]
    rows.append((4, " ".join(f"zzq{i}" for i in range(80))))
    rows.append((5, "\n".join(f"- item {i} of the list" for i in range(20))))
    assert [r[0] for r in Q.keep_good(docs_of(spark, rows)).orderBy("doc_id").collect()] == [1, 3]


def test_rules_table_is_a_parameter(spark):
    docs = docs_of(spark, [(1, " ".join(f"w{i}" for i in range(30)))])
    assert Q.keep_good(docs, rules=[Q.Rule("short", "word_chars", "n_words", 500, None)]).count() == 0
    assert Q.keep_good(docs, rules=[]).columns == docs.columns


def test_no_user_function(spark):
    plan = Q.keep_good(docs_of(spark, awkward()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert Q.quality_report(docs_of(spark, [])).count() == 0
