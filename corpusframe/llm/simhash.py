"""SimHash near-dedup by a binary trie self-join.

Fingerprint. A-Z are lower-cased; words are runs of characters other than space
and U+0009 to U+000D; shingles are ``shingle`` consecutive words joined by one
space, repeats included (fewer words: the whole sequence). A bit is 1 if it is
set in more than half of the shingles' XXH64 values (seed 42). A text without
words has the fingerprint 0.

Join. Equal fingerprints are one class, so copies are never paired. The binary
trie over the distinct fingerprints is traversed as pairs of nodes, with the
bits in which the pair's paths differ added up and the pair given up as soon as
they exceed the budget. Spark walks the top ``depth`` levels: the fingerprints
below one node are packed into an array, and each surviving pair of top nodes
is one group, which gets the two arrays. A task walks the rest of the trie for
its pair, depth first in blocks of bounded size. A task reports only links that
join two of its own subsets (a spanning forest), so a dense group of near
copies gives at most one link per fingerprint and pair of top nodes, and not
all its pairs. Components are found from the links.

Scale. ``depth`` follows from the number of fingerprints: a subtree holds
``SUBTREE`` of them on average, up to ``MAX_DEPTH`` levels; a fingerprint is
sent to as many groups as there are masks of ``depth`` bits within the budget.

Defined cases. Null text counts as empty. A null id is larger than any id: it
represents a component only if that has no ids, and ``component_id`` is null
then. Rows that repeat id and text are one document. An empty table gives an
empty result. Other columns pass through ``keep_one`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusframe.llm.components import connected_components
from corpusframe.llm.tables import fresh, stored, table, text_of

SHINGLE = 4
MAX_BITS = 4
SUBTREE = 1 << 16
MIN_DEPTH, MAX_DEPTH = 6, 12
#: Node pairs, or pairs of fingerprints, handled at once in a task.
BLOCK = 1 << 20
#: A pair of nodes with at most so many pairs of fingerprints is compared directly.
DIRECT = 16
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = ~white
    edge = np.concatenate(([True], white, [True]))
    starts = np.flatnonzero(inside & edge[:-2])
    if not len(starts):
        return 0
    sizes = np.flatnonzero(inside & edge[2:]) + 1 - starts
    # Words joined by one space: each white run between words shrinks to its last character.
    last = white & ~edge[2:]
    last[: starts[0]] = False
    joined = np.where(white, np.uint8(32), raw)[inside | last].tobytes()
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    n = max(1, len(starts) - shingle + 1)
    ends = ends[shingle - 1:] if len(starts) >= shingle else ends[-1:]
    ones = np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        b, e = begins[k : min(n, k + _CHUNK)].tolist(), ends[k : k + _CHUNK].tolist()
        hashes = np.array([h(joined[x:y], 42) for x, y in zip(b, e)], dtype=np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): one row per document; fp as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_of(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    out = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("text_key", StringType()), StructField("fp", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, out)


class _Trie:
    """Binary trie over sorted distinct fingerprints; levels built on demand.
    At a level, ``starts`` has each node's first fingerprint and ``child`` the
    nodes below it for bit 0 and 1, or -1."""

    def __init__(self, fps: np.ndarray, depth: int):
        self.fps, self.levels, self.top = fps, [], depth
        self.starts = [np.zeros(1, np.int64)]

    def child(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            d = self.top + len(self.levels)
            above = self.starts[-1]
            path = self.fps >> np.uint64(63 - d)
            below = np.concatenate(([0], np.flatnonzero(path[1:] != path[:-1]) + 1))
            child = np.full((len(above), 2), -1, np.int32)
            parent = np.searchsorted(above, below, "right") - 1
            child[parent, (path[below] & np.uint64(1)).astype(np.int64)] = np.arange(len(below))
            self.levels.append(child)
            self.starts.append(below)
        return self.levels[k]

    def sizes(self, k: int) -> np.ndarray:
        return np.diff(np.append(self.starts[k], len(self.fps)))


class _Forest:
    """Keeps the links that join two sets."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.label[i], self.label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        _, at = np.unique(np.minimum(a, b) * len(self.label) + np.maximum(a, b), return_index=True)
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                y = up[x]
                if y in up:
                    up[x] = up[y]
                x = y
            return x

        for x, y, p, q in zip(a[at].tolist(), b[at].tolist(), i[at].tolist(), j[at].tolist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                self.links.append((p, q))
        new = np.arange(len(self.label))
        for x in up:
            new[x] = find(x)
        self.label = new[self.label]


def trie_links(a: np.ndarray, b: np.ndarray | None, depth: int, differ: int, max_bits: int) -> np.ndarray:
    """Links within ``max_bits`` between two sorted arrays of distinct
    fingerprints whose first ``depth`` bits differ in ``differ`` places, or
    within one (``b`` None): pairs of fingerprints that span each linked set."""
    same = b is None
    ta = _Trie(a, depth)
    tb = ta if same else _Trie(b, depth)
    shift = 0 if same else len(a)
    forest = _Forest(len(a) + (0 if same else len(b)))

    def compare(k: int, x: np.ndarray, y: np.ndarray) -> None:
        nx, ny = ta.sizes(k)[x], tb.sizes(k)[y]
        pairs = nx * ny
        cuts = np.flatnonzero(np.diff(np.cumsum(pairs) // BLOCK)) + 1
        for part in np.split(np.arange(len(x)), cuts):
            n = pairs[part]
            which = np.repeat(part, n)
            at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i = ta.starts[k][x[which]] + at // ny[which]
            j = tb.starts[k][y[which]] + at % ny[which]
            near = np.bitwise_count(ta.fps[i] ^ tb.fps[j]) <= max_bits
            if same:
                near &= i < j
            forest.add(i[near], j[near] + shift)

    todo = [(0, np.zeros(1, np.int32), np.zeros(1, np.int32), np.full(1, differ, np.uint8))]
    while todo:
        k, x, y, d = todo.pop()
        if len(x) > BLOCK:
            for part in np.array_split(np.arange(len(x)), -(-len(x) // BLOCK)):
                todo.append((k, x[part], y[part], d[part]))
            continue
        few = ta.sizes(k)[x] * tb.sizes(k)[y] <= DIRECT
        if few.any():
            compare(k, x[few], y[few])
            x, y, d = x[~few], y[~few], d[~few]
        if not len(x):
            continue
        cx, cy = ta.child(k)[x], tb.child(k)[y]
        found = []
        for p in (0, 1):
            for q in (0, 1):
                ok = (cx[:, p] >= 0) & (cy[:, q] >= 0)
                if p != q:
                    ok &= d < max_bits
                if same and p > q:
                    ok &= x != y
                found.append((cx[ok, p], cy[ok, q], d[ok] + np.uint8(p != q)))
        todo.append((k + 1, *(np.concatenate(z) for z in zip(*found))))
    every = a if same else np.concatenate((a, b))
    return every[np.array(forest.links, np.int64).reshape(-1, 2)]


def near_links(distinct: DataFrame, max_bits: int = MAX_BITS, depth: int | None = None) -> DataFrame:
    """``distinct`` (fp), stored -> (u, v): links that span every set of
    fingerprints reachable from each other within ``max_bits`` per step."""
    if depth is None:
        depth = min(MAX_DEPTH, max(MIN_DEPTH, (distinct.count() // SUBTREE).bit_length()))

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        fps = np.sort(rows["fp"].to_numpy().view(np.uint64))
        return pd.DataFrame({"top": [key[0]], "fps": [fps.tobytes()]})

    def join(key, rows: pd.DataFrame) -> pd.DataFrame:
        a = [np.frombuffer(x, np.uint64) for x in rows.sort_values("top")["fps"]]
        differ = (int(key[0]) ^ int(key[1])).bit_count()
        if key[0] == key[1]:
            links = trie_links(a[0], None, depth, 0, max_bits)
        elif len(a) == 2:
            links = trie_links(a[0], a[1], depth, differ, max_bits)
        else:
            links = np.empty((0, 2), np.uint64)
        links = links.view(np.int64)
        return pd.DataFrame({"u": links[:, 0], "v": links[:, 1]})

    top = F.shiftrightunsigned("fp", 64 - depth).cast("int")
    packed = distinct.select("fp", top.alias("top")).groupBy("top").applyInPandas(pack, "top int, fps binary")
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << depth) - 1)), lambda m: F.bit_count(m) <= max_bits)
    pairs = packed.select("top", "fps", F.explode(masks).alias("mask")).withColumn("other", F.col("top").bitwiseXOR(F.col("mask")))
    pairs = pairs.select(F.least("top", "other").alias("lo"), F.greatest("top", "other").alias("hi"), "top", "fps")
    return pairs.groupBy("lo", "hi").applyInPandas(join, "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_key, fp, first): every document with its component's
    first document, a struct (no_id, doc_id, text_key)."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    distinct = stored(rows.groupBy("fp").agg(first), "simhash-distinct")
    links = connected_components(near_links(distinct.select("fp"), max_bits))
    members = distinct.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = members.groupBy("root").agg(F.min("first").alias("first"))
    of_fp = members.select("fp", "root").join(lowest, "root").select("fp", "first")
    return rows.join(of_fp, "fp").select("doc_id", "text_key", "fp", "first")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, the one with the smallest id, with the
    columns of ``docs``."""
    (key,) = fresh(docs, "key")
    name = lambda i, t: F.concat_ws(":", t, i.cast("string"))
    staying = components(docs, id_col, text_col, shingle, max_bits).select("first").distinct()
    staying = staying.select(name(F.col("first.doc_id"), F.col("first.text_key")).alias(key))
    rows = docs.withColumn(key, name(F.col(id_col), F.md5(text_of(text_col))))
    return rows.join(staying, key, "left_semi").dropDuplicates([key]).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))
