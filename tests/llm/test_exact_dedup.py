import hashlib
from collections import defaultdict

import pytest

from corpusframe.llm import exact_dedup
from tests.llm.fixtures import awkward, docs_of


def brute(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        at = ids.index(keep)
        for k, i in enumerate(ids):
            out.append((i, keep, len(ids), k == at, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [0, 2, 2048])
def test_report_matches_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(exact_dedup, "HEAVY_DIGESTS", max(1, heavy))
    if not heavy:
        monkeypatch.setattr(exact_dedup, "heavy_digests", lambda ids: ids.selectExpr("digest", "doc_id keep_id", "1L group_size").limit(0))
    rows = awkward() + [(100 + i, "hot text") for i in range(400)] + [(1000 + i, f"text {i // 2}") for i in range(300)]
    got = exact_dedup.duplicate_report(docs_of(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_rows_that_stay(spark):
    rows = awkward() + [(100 + i, "hot text") for i in range(50)]
    docs = docs_of(spark, rows)
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    by_digest = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t, *_ in rows}
    want = [(i, by_digest[s]) for i, _, _, kept, s in brute(rows) if kept]
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    docs = docs_of(spark, [])
    assert exact_dedup.duplicate_report(docs).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == 0
