import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusframe.llm import collocations as C
from tests.llm.fixtures import EXTRA, awkward, docs_of

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())]
                    + [StructField(x, StringType()) for x in ("g", "n", "done", "p", "head", "score", *EXTRA)])


def table_of(spark, rows):
    """rows: (text, lang)."""
    return spark.createDataFrame([(i, t, lang) + ("x",) * (len(SCHEMA) - 3) for i, (t, lang) in enumerate(rows)], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def counts_of(rows):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return f


def brute(rows, least, top=2000):
    out = []
    for lang, f in counts_of(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) >= 2 and c >= least}
        hidden = set()
        for q, c in found.items():
            for i in range(len(q)):
                for j in range(i + 1, len(q) + 1):
                    if j - i < len(q) and 100 * c >= 100 * f[q[i:j]]:
                        hidden.add(q[i:j])
        mine = []
        for p, a in found.items():
            if p not in hidden:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                mine.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(mine)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n, -s))
    return sorted(out)


def got_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def prose(n, seed=1):
    r = random.Random(seed)
    words = ["the", "of", "Old", "town", "river", "a", "b", "é", "中文", "x_1", "IS", "it's", "\x01", "\x00", "q\x1f"]
    fixed = ["New York Stock Exchange opened early today", "one two three four five six seven eight", "a a a a a a a"]
    rows = []
    for i in range(n):
        parts = [r.choice(fixed) if r.random() < 0.3 else " ".join(r.choices(words, k=r.randint(0, 9))) for _ in range(r.randint(0, 5))]
        rows.append((r.choice([". ", "; ", "\n", "\x0b", "  \t ", "?!", " "]).join(parts), r.choice(["en", "en", "de", None, "a b"])))
    return rows


@pytest.mark.parametrize("least", [2, 7, 30])
def test_matches_brute_force(spark, least):
    rows = prose(500)
    assert got_of(C.collocations(table_of(spark, rows), least)) == brute(rows, least)


def test_small_tables_of_counts_and_partitions_change_nothing(spark, monkeypatch):
    rows = prose(200, 3)
    want = brute(rows, 4)
    monkeypatch.setattr(C, "HELD", 10)
    monkeypatch.setattr(C, "BATCH", 3)
    assert got_of(C.collocations(table_of(spark, rows).repartition(6), 4)) == want


def test_any_bitmap_that_holds_the_frequent_pairs_gives_the_same(spark, monkeypatch):
    """A full bitmap cuts nothing, as on a corpus whose every pair is frequent."""
    import numpy as np

    rows = prose(200, 4)
    cut = C.frequent_pairs(table_of(spark, rows).select("lang", "text").na.fill(""), 6)
    assert 0 < np.unpackbits(cut).sum() < 2000
    monkeypatch.setattr(C, "frequent_pairs", lambda texts, least: np.full(C.PAIRS // 8, 255, dtype=np.uint8))
    assert got_of(C.collocations(table_of(spark, rows), 6)) == brute(rows, 6)


def test_rare_triples_of_frequent_pairs_are_no_edges(spark):
    """Frequent pairs whose triples are rare are counted as pairs: no phrase of
    more words is written for them, and the counts stay whole."""
    import pyarrow as pa

    r = random.Random(6)
    rows = [(" ".join(r.choices([f"w{i}" for i in range(20)], k=40)), "en") for _ in range(300)]
    docs = table_of(spark, rows)
    kept = C.frequent_pairs(docs.select("lang", "text"), 15)  # of 400 pairs about 29 each, of 8,000 triples under 2
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 300, "text": [t for t, _ in rows]})
    kept_of = type("Kept", (), {"value": kept})
    edges = [g for b in C._edges(iter([batch]), kept_of) for g in b.column("g").to_pylist()]
    assert len(edges) < 500 and max(len(g.split(" ")) for g in edges) == 2
    assert got_of(C.collocations(docs, 15)) == brute(rows, 15)


def test_lots_words_and_numbers(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["", " a  B\tc. d", "é" * 9 + " \x00 \x00\x00", "x", "long" * 5 + " " + "long" * 4, "", "a b c"] * 3
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"] * 7, "text": texts})
    for lot, rows in ((1, 2), (20, 256), (1 << 20, 5)):
        monkeypatch.setattr(C, "LOT", lot)
        monkeypatch.setattr(C, "ROWS", rows)
        got, pairs = Counter(), {}
        for lang, text in C._lots(iter([batch, batch.slice(0, 0)])):
            starts, ends, joined = C._words(text)
            words = [text[i:j] for i, j in zip(starts, ends)]
            got.update((lang, w) for w in words)
            two, three = C._numbers(lang, text, starts, ends)
            assert len(joined) == len(two) == max(len(words) - 1, 0) and len(three) == max(len(words) - 2, 0)
            for i in np.flatnonzero(joined):
                assert pairs.setdefault((lang, words[i], words[i + 1]), two[i]) == two[i]
        want = Counter((lang, w.encode()) for lang, t in zip(batch["lang"].to_pylist(), texts) for w in re.findall(r"[^ \t.]+", lower(t)))
        assert got == want and len(set(pairs.values())) == len(pairs)
        assert set(pairs) == {(lang, a.encode(), b.encode()) for lang, t in zip(batch["lang"].to_pylist(), texts) for piece in lower(t).split(".") for a, b in zip(piece.split(), piece.split()[1:])}


def test_counts_are_the_flow(spark):
    rows = prose(150, 5)
    f = counts_of(rows)
    got = {(r["lang"], tuple(r["g"].split(" ")) if r["g"] else ()): r["n"] for r in C.phrase_counts(table_of(spark, rows), 3).collect()}
    want = {(lang, p): c for lang, by in f.items() for p, c in by.items() if c >= 3}
    want |= {(lang, ()): sum(c for p, c in by.items() if len(p) == 1) for lang, by in f.items()}
    assert got == want


def test_unary_paths(spark):
    line = "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11 p12"
    rows = [(line, "en")] * 6 + [("p1 p2 p3 p4 p5 p6 q1 q2", "en")] * 4 + [("z1 z2 z3 z4 z5 z6", "de")] * 3
    paths = {(r["lang"], " ".join(r["path"])): (r["n"], r["edges"]) for r in C.unary_paths(C.phrase_counts(table_of(spark, rows), 3)).collect()}
    assert paths == {
        ("en", "p1 p2 p3 p4 p5 p6"): (10, 2),  # then the way parts
        ("en", "p3 p4 p5 p6 p7 p8 p9 p10 p11 p12"): (6, 6),
        ("en", "p3 p4 p5 p6 q1 q2"): (4, 2),
        ("de", "z1 z2 z3 z4 z5 z6"): (3, 2),
    }
    long = " ".join(f"v{i}" for i in range(300))
    paths = C.unary_paths(C.phrase_counts(table_of(spark, [(long, "en")] * 2), 2)).collect()
    assert [(" ".join(p["path"]), p["edges"]) for p in paths] == [(long, 296)]


def test_scores_past_64_bits(spark):
    a, n, left, right = 10**12, 9 * 10**15, 10**13, 3 * 10**12 + 1
    counts = spark.createDataFrame([("en", "x y", a), ("en", "x", left), ("en", "y", right), ("en", "", n)], "lang string, g string, n long")
    got = C.scored(counts.where("g = 'x y'"), counts).collect()
    assert [(r["score"], r["l"], r["r"]) for r in got] == [(1000 * a * n // (left * right), left, right)]


def test_top_and_ties(spark):
    rows = [(f"w{i} v{i}", "en") for i in range(30) for _ in range(5)]
    got = got_of(C.collocations(table_of(spark, rows), 5, top=7))
    assert got == brute(rows, 5, 7) and len(got) == 7


def test_awkward_and_empty_tables(spark):
    rows = awkward()
    docs = docs_of(spark, rows)
    assert got_of(C.collocations(docs, 2)) == brute([(t, "en") for _, t, _ in rows], 2)
    for empty in (docs_of(spark, []), docs_of(spark, [(1, None), (2, " . ")])):
        df = C.collocations(empty)
        assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and df.count() == 0
