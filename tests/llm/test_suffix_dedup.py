import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from corpusframe.llm import suffix_dedup as S
from tests.llm.fixtures import awkward, docs_of


def brute(rows, length=S.LENGTH):
    where = defaultdict(int)
    raws = [(r[1] or "").encode() for r in rows]
    for raw in raws:
        for s in range(len(raw) - length + 1):
            where[raw[s : s + length]] += 1
    out = []
    for r, raw in zip(rows, raws):
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - length + 1):
            if where[raw[s : s + length]] > 1:
                gone[s : s + length] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out.append((r[0], len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def text(rnd, n):
    return " ".join("".join(rnd.choice("aeioubcdst") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def tangled(seed, n=60):
    """Texts that share passages of about 200 bytes, with near copies."""
    rnd = random.Random(seed)
    passages = [text(rnd, 80)[:k] for k in (150, 199, 200, 201, 260, 400)]
    rows = []
    for i in range(n):
        parts = [text(rnd, rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(passages), text(rnd, rnd.randrange(0, 30))]
        rows.append((i, rnd.choice(["", " ", "ü"]).join(parts)))
    for i in range(20):
        t = list(rows[i][1])
        for _ in range(2):
            if t:
                t[rnd.randrange(len(t))] = "#"
        rows.append((100 + i, "".join(t)))
    return rows


@pytest.mark.parametrize("seed,group", [(1, None), (2, None), (3, 1), (4, 3)])
def test_report_matches_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(S, "BATCH", 50 if seed % 2 else 20_000)
    rows = tangled(seed) + [(300, "z" * 700), (301, "-" * 250 + "x" * 250), (302, "ab" * 300), (303, "k" * 200), (304, "short")]
    if seed == 1:
        rows += [r for r in awkward() if len(r[1] or "") < 5000]
    got = S.repeats_report(docs_of(spark, rows), group=group)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_segments_cover_all_windows(monkeypatch):
    rnd = random.Random(5)
    raw = (text(rnd, 400) + "y" * 500).encode()
    for block in (1 << 20, 256):
        monkeypatch.setattr(S, "BLOCK", block)
        found = S.segments(raw)
        at = 0
        for s, n, before, _, _ in found:
            assert s == at and 0 <= before - (n - 1) and before <= S.LENGTH - S.GRAM
            at += n
        assert at == len(raw) - S.LENGTH + 1


@pytest.mark.parametrize("shallow", [0, 8, 64])
def test_deep_shallow_sorts(shallow):
    rnd = random.Random(shallow)
    for _ in range(150):
        strings = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randrange(0, 30))) for _ in range(rnd.randrange(1, 40))]
        strings += [s + b"tail" for s in strings[:5]] + strings[:3]
        assert [strings[i] for i in S.deep_shallow(strings, shallow)] == sorted(strings)


def test_empty_table(spark):
    assert S.repeats_report(docs_of(spark, [])).count() == 0
