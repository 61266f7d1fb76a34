"""The pipeline against a plain version of its five stages."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
from corpusframe.llm import mixing, piece_bpe
from corpusframe.llm import quality_rules as Q
from corpusframe.llm.tables import stored
from tests.llm.fixtures import awkward, docs_of
from tests.llm.test_mixing import water
from tests.llm.test_quality_rules import slow
from tests.llm.test_simhash import slow_components, slow_fingerprint

WORD = r"[^\x20\x09-\x0D]+"


def good(text):
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = slow(text)
    if n_words < 10 or 100 * n_repeat > 20 * n_words:
        return False
    text = text or ""
    stop = "|".join(sorted(Q.STOP_WORDS))
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    facts = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": len(lines),
        "n_stop_words": len(re.findall(rf"(?<![^\x20\x09-\x0D])(?i:{stop})(?!\w)", text)),
        "n_ellipsis_lines": sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines),
        "n_bullet_lines": sum(bool(re.match(r"\s*[-*•]\s", x)) for x in lines),
    }
    for r in Q.RULES:
        value, unit = 100 * facts[r.measure], facts[r.unit]
        if unit >= r.least and ((r.low is not None and value < r.low * unit) or (r.high is not None and value > r.high * unit)):
            return False
    return True


def key(doc_id, text):
    h = hashlib.md5(f"mix:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    solid = re.sub(r"[\x20\x09-\x0D]", "", text)
    weight = 0.5 + (sum(c.isalpha() for c in solid) / len(solid) if solid else 0)
    return -math.log((int(h[:13], 16) + 0.5) / (1 << 52)) / weight


def plain(rows):
    rows = [r for r in rows if good(r[1])]
    best = {}
    for r in rows:
        if r[1] not in best or (r[0] is not None and (best[r[1]][0] is None or r[0] > best[r[1]][0])):
            best[r[1]] = r
    rows = list(best.values())
    firsts = slow_components([r[0] for r in rows], [slow_fingerprint(r[1]) for r in rows])
    rows = [r for r, c in zip(rows, firsts) if r[0] == c]
    size = {r[0]: len(re.findall(WORD, r[1])) for r in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    goal, out = water(total), []
    for s in total:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (key(r[0], r[1]), r[0]))
        epochs = int(goal[s] // total[s])
        rest, sums = goal[s] - epochs * total[s], [0]
        for r in own:
            sums.append(sums[-1] + size[r[0]])
        n = min(range(len(sums)), key=lambda k: (abs(sums[k] - rest), sums[k])) if rest > 0 else 0
        for k, r in enumerate(own):
            out += [r] * (epochs + (k < n))
    return out


def fixture():
    rnd = random.Random(11)
    words = "the of and to in is it was for on he sea town river old boat green hill stone fire bread long walk home".split()
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rnd.choice(words) + ("" if rnd.random() < 0.5 else str(rnd.randrange(99))) for _ in range(rnd.randrange(5, 90))), f"s{i % 4}"))
    rows += [(200 + i, rows[i][1], "s1") for i in range(15)]
    rows += [(300 + i, rows[40 + i][1].replace("the", "thee", 1), "s2") for i in range(25)]
    rows += [(400, "### $$$ " * 40, "s0"), (401, "a b c d e " * 30, "s3"), (402, None, "s3"), (403, "", None)]
    long = " ".join(rnd.choice(words) + str(i) for i in range(3000))
    return rows + [(500, long, None), (501, long + " end", "s0")] + [(r[0] + 1000, *r[1:]) for r in awkward() if r[0] is not None and len(r[1] or "") < 5000]


def test_pipeline_matches_plain_version(spark, tmp_path):
    import public_tokenizers
    import sentencepiece

    rows = fixture()
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))
    want = Counter((i, tuple(library.encode(t))) for i, t, _ in plain(rows))
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and sum(want.values()) > 60


def test_stages_keep_columns_and_feed_each_other(spark, tmp_path):
    docs = docs_of(spark, fixture())
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] > counts[3]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "piece_bpe"]


def test_empty_documents(spark, tmp_path):
    docs_of(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_constants():
    assert mixing.WEIGHTS == (5, 2, 1) and mixing.SHARE == 1.5 and mixing.MOST == 2
