from corpusframe.llm import mixing
from tests.llm.fixtures import awkward, docs_of


def water(sizes):
    """Targets by resharing round by round. sizes: source to words, in order."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, full, budget = set(names), {}, 1.5 * sum(sizes.values())
    while left:
        share = (budget - sum(full.values())) / sum(w[s] for s in left)
        over = {s for s in left if share * w[s] > 2 * sizes[s]}
        if not over:
            return full | {s: share * w[s] for s in left}
        full |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return full


def check(rows, got):
    sizes, most = {}, {}
    for _, t, s in rows:
        n = len((t or "").replace("\x0b", " ").split())
        sizes[s] = sizes.get(s, 0) + n
        most[s] = max(most.get(s, 0), n)
    want, taken = water(sizes), {}
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["times"] * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6


def many():
    return [(i, " ".join(["word"] * (i * 7919 % 60)), f"s{i % 7 if i % 3 else 0}") for i in range(3000)] + [(9000 + i, "a b c", None) for i in range(40)]


def test_targets_and_taken_words(spark):
    rows = many()
    docs = docs_of(spark, rows)
    by = {r[0]: r[2] for r in rows}
    got = [r.asDict() | {"source": by[r["doc_id"]]} for r in mixing.mix_report(docs).collect()]
    assert len(got) == len(rows)
    check(rows, got)
    again = mixing.mix_report(docs.repartition(5)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in got}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in mixed.select("doc_id").groupBy("doc_id").count().collect()}
    assert times == {r["doc_id"]: r["times"] for r in got if r["times"]}


def test_one_range_or_many_give_the_same(spark, monkeypatch):
    docs = docs_of(spark, many())
    got = {(r["doc_id"], r["taken"]) for r in mixing.mix_report(docs).collect()}
    monkeypatch.setattr(mixing, "BUCKETS", 1)
    assert {(r["doc_id"], r["taken"]) for r in mixing.mix_report(docs).collect()} == got


def test_awkward_rows(spark):
    docs = docs_of(spark, awkward())
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(awkward())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(docs).columns == docs.columns


def test_heavier_documents_come_first(spark):
    """Weights show in what a partial epoch selects."""
    from pyspark.sql import functions as F

    rows = [(i, "one two three four", "abc"[i // 4 % 3]) for i in range(6000)]
    got = mixing.mix_report(docs_of(spark, rows), weight=F.when(F.col("doc_id") % 4 < 2, 4.0).otherwise(1.0)).collect()
    part = [r for r in got if r["target"] % r["source_size"]]
    heavy = [r["times"] for r in part if r["doc_id"] % 4 < 2]
    light = [r["times"] for r in part if r["doc_id"] % 4 >= 2]
    assert sum(heavy) / len(heavy) > sum(light) / len(light) + 0.2


def test_empty_and_wordless_tables(spark):
    assert mixing.mix_report(docs_of(spark, [])).count() == 0
    got = mixing.mix_report(docs_of(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in got) == [(1, 0, 0.0), (2, 0, 0.0)]
