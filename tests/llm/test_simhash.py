import random

import numpy as np
import pytest
import xxhash

from corpusframe.llm import simhash
from tests.llm.fixtures import awkward, docs_of


def slow_fingerprint(text, shingle=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hs = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(ids, fps, bits=4):
    """Smallest id reachable, by comparing every two fingerprints."""
    seen, out = {}, {}
    for start in sorted(range(len(fps)), key=lambda k: (ids[k] is None, ids[k] or 0)):
        if start in seen:
            continue
        todo = [start]
        seen[start] = ids[start]
        while todo:
            a = todo.pop()
            for b in range(len(fps)):
                if b not in seen and (fps[a] ^ fps[b]).bit_count() <= bits:
                    seen[b] = ids[start]
                    todo.append(b)
    for k in seen:
        out[k] = seen[k]
    return [out[k] for k in range(len(fps))]


def near_copies(seed, n):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(3000)}" for _ in range(300)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(i % 7):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(99)}"
        rows.append((1000 * seed + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("text", [r[1] for r in awkward()] + ["A b\x0bC d\x0c\x0dE", "ÀB cD", " lead  and trail \n"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_components_match_brute_force(spark):
    rows = awkward() + near_copies(1, 60) + near_copies(2, 40)
    docs = docs_of(spark, rows)
    got = simhash.components(docs).selectExpr("doc_id", "fp", "first.doc_id c").collect()
    fps = [slow_fingerprint(r[1]) for r in rows]
    want = slow_components([r[0] for r in rows], fps)
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=str) == sorted(((r[0], f, c) for r, f, c in zip(rows, fps, want)), key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    firsts = [r[0] for r in kept.collect()]
    assert sorted(firsts, key=str) == sorted({c for c in want}, key=str)


@pytest.mark.parametrize("depth,differ", [(6, 0), (6, 3), (8, 4)])
def test_trie_links_span_all_links(depth, differ):
    """Clustered fingerprints under one or two top nodes, against all pairs."""
    rnd = random.Random(depth * 10 + differ)
    def below(top, n):
        centres = [rnd.getrandbits(64 - depth) for _ in range(5)]
        out = set()
        for _ in range(n):
            f = rnd.choice(centres) if rnd.random() < 0.7 else rnd.getrandbits(64 - depth)
            for _ in range(rnd.randrange(6)):
                f ^= 1 << rnd.randrange(64 - depth)
            out.add(top << (64 - depth) | f)
        return out, centres
    a, centres = below(0, 300)
    other = (1 << differ) - 1
    b = {other << (64 - depth) | (x & ((1 << (64 - depth)) - 1)) ^ (1 << rnd.randrange(20)) for x in a if rnd.random() < 0.5}
    fa = np.array(sorted(a), np.uint64)
    if differ:
        fb = np.array(sorted(b), np.uint64)
        links = simhash.trie_links(fa, fb, depth, differ, 4)
        pairs = [(x, y) for x in a for y in b if (x ^ y).bit_count() <= 4]
    else:
        links = simhash.trie_links(fa, None, depth, 0, 4)
        pairs = [(x, y) for x in a for y in a if x < y and (x ^ y).bit_count() <= 4]
    def sets(edges):
        up = {}
        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x
        for x, y in edges:
            up[find(int(x))] = find(int(y))
        return {x: find(x) for x in up}
    s, t = sets(links), sets(pairs)
    assert set(s) == set(t)
    assert len(set(s.values())) == len(set(t.values()))
    assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in links)
    assert len(links) == len(t) - len(set(t.values()))


def test_small_blocks_give_the_same(monkeypatch):
    rnd = random.Random(9)
    fa = np.array(sorted({rnd.getrandbits(14) << 3 for _ in range(900)}), np.uint64)
    whole = len(simhash.trie_links(fa, None, 6, 0, 4))
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert len(simhash.trie_links(fa, None, 6, 0, 4)) == whole


def test_empty_table(spark):
    assert simhash.components(docs_of(spark, [])).count() == 0
    assert simhash.keep_one(docs_of(spark, [])).count() == 0
