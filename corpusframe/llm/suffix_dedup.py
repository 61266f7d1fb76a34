"""Suffix-array dedup: every byte covered by a repeated 200-byte string goes.

A string of ``LENGTH`` bytes that starts at two or more places (of one or
several texts) is repeated; matches never cross texts. All repeated strings
are found, by sorting suffixes that start at anchors instead of at every byte.

Anchors. In each window of ``LENGTH`` bytes the ``GRAM``-byte substring with
the smallest hash (leftmost of equals) is its anchor; equal windows have equal
anchors at equal offsets. Neighbouring windows mostly share their anchor, so
the windows of a text form segments, one per anchor, some 80 bytes apart.
Windows whose anchor occurs once are unique. Segments that are wholly equal
(same anchor, same bytes by a joint 128-bit hash) are repeated throughout.

Suffix sort. What remains are anchors with different segments. For each, the
text after the anchor and, reversed, the text before it are sorted by deep-
shallow sorting: multikey quicksort on eight-byte characters down to
``SHALLOW`` bytes, then a blind trie (skip values and branching bytes only) for
groups that still agree. The common prefixes of neighbours give, for every
length, the classes of suffixes that agree that far; a window with ``o`` bytes
before its anchor is repeated if another segment shares both its class of
``o`` bytes before and of ``LENGTH - o`` bytes after.

Scale. Copies of a text are one text (deduplicated map-side first). The texts
are shuffled once, into a table bucketed by digest; later passes over them join
narrow tables bucket by bucket. Anchors with more than ``GROUP`` different
segments (a passage with many different surroundings) are not sorted in one
task: their windows are counted by hash, which combines map-side, and joined
back. A text's segments are bounded by its length.

Defined cases. Null text counts as empty; texts under ``LENGTH`` bytes keep
everything; of copies no byte stays, as each repeats the others; rows are
reported one by one whatever their ids; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.tables import small, stored, table, text_of
from corpusframe.session import scratch_path

LENGTH = 200
GRAM = 40
SHALLOW = 64
#: Most different segments of one anchor that are sorted in one task.
GROUP = 1 << 15
#: Segments gathered before a task sorts; texts are hashed in such blocks of bytes.
BATCH = 20_000
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POS = 24  # low bits of a sort key that hold the position within a block


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Hash:
    """Hashes of all substrings of one length, from prefix sums modulo 2**64."""

    def __init__(self, n: int):
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def grams(self, raw: np.ndarray, width: int) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64)))
        h = (sums[width:] - sums[:-width]) * self.down[: len(raw) - width + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by minima up to and from block ends."""
    n = len(x)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = x
    rows = rows.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[: n - width + 1], upto[width - 1 : n])


def segments(raw: bytes, length: int = LENGTH, gram: int = GRAM, hashes: _Hash | None = None) -> list[tuple[int, int, int, int, int]]:
    """(start, windows, anchor - start, anchor hash, segment hash), signed hashes."""
    out, data = [], np.frombuffer(raw, np.uint8)
    hashes = hashes or _Hash(BLOCK + length)
    for at in range(0, len(raw) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        h = hashes.grams(part, gram)
        key = (h >> np.uint64(_POS) << np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_min(key, length - gram + 1) & np.uint64((1 << _POS) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        count = np.diff(np.append(first, len(anchor)))
        where = anchor[first]
        for s, n, a, v in zip(first.tolist(), count.tolist(), where.tolist(), h[where].view(np.int64).tolist()):
            whole = xxhash.xxh3_64_intdigest(raw[at + s : at + s + n - 1 + length], a - s)
            out.append((at + s, n, a - s, v, whole - (1 << 63)))
    return out


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


def blind_trie(strings: list[bytes], group: list[int]) -> list[int]:
    """``group`` in the order of its strings. A node is [skip, {byte: node or
    leaf}], a leaf a list of equal strings; the end of a string branches as -1.
    A string descends by branching bytes alone to some leaf; one comparison
    there shows where it parts from the trie."""
    root = [len(strings[group[0]]), {-1: [group[0]]}]
    for i in group[1:]:
        s = strings[i]
        node = root
        while True:
            byte = s[node[0]] if node[0] < len(s) else -1
            below = node[1].get(byte)
            if below is None:
                below = next(iter(node[1].values()))
            if not (len(below) == 2 and isinstance(below[1], dict)):
                break
            node = below
        other = strings[below[0]]
        n = common(s, other)
        if n == len(s) == len(other):
            below.append(i)
            continue
        byte, old = s[n] if n < len(s) else -1, other[n] if n < len(other) else -1
        above, node = None, root
        while node[0] < n:
            branch = s[node[0]] if node[0] < len(s) else -1
            below = node[1][branch]
            above = (node, branch)
            if not (len(below) == 2 and isinstance(below[1], dict)):
                node = below
                break
            node = below
        if len(node) == 2 and isinstance(node[1], dict) and node[0] == n:
            node[1][byte] = [i]
        else:
            new = [n, {byte: [i], old: node}]
            if above is None:
                root = new
            else:
                above[0][1][above[1]] = new
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if len(node) == 2 and isinstance(node[1], dict):
            todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow(strings: list[bytes], shallow: int | None = None) -> list[int]:
    """Order of ``strings``: multikey quicksort on eight bytes at a time, then
    blind tries for groups that agree on ``shallow`` bytes."""
    shallow = SHALLOW if shallow is None else shallow
    out: list[int] = []
    todo = [(list(range(len(strings))), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) < 2:
            out += group
        elif depth >= shallow:
            out += blind_trie(strings, group)
        else:
            heads = [strings[i][depth : depth + 8] for i in group]
            pivot = heads[len(heads) // 2]
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for i, x in zip(group, heads):
                parts[0 if x < pivot else 1 if x == pivot else 2].append(i)
            todo.append((parts[2], depth))
            todo.append((parts[1], depth + 8 if len(pivot) == 8 else shallow))
            todo.append((parts[0], depth))
    return out


def _sorted_classes(strings: list[bytes], bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions in sorted order, group by group, and the common prefix of each
    with the one before (-1 at a group's first)."""
    order, lcp = [], []
    for a, b in zip(bounds, bounds[1:]):
        got = [a + i for i in deep_shallow(strings[a:b])]
        order += got
        lcp.append(-1)
        lcp += [common(strings[x], strings[y]) for x, y in zip(got, got[1:])]
    return np.array(order, np.int64), np.array(lcp, np.int64)


def repeated_windows(parts: list[bytes], before: np.ndarray, windows: np.ndarray, bounds: list[int], length: int = LENGTH) -> np.ndarray:
    """Boolean (segment, bytes before the anchor): the segment's windows that
    another segment of its group holds too. ``parts``: the segments' bytes,
    grouped by anchor (``bounds``), each with ``before`` bytes ahead of it."""
    after_at, after = _sorted_classes([p[b:] for p, b in zip(parts, before.tolist())], bounds)
    ahead_at, ahead = _sorted_classes([p[:b][::-1] for p, b in zip(parts, before.tolist())], bounds)
    most = int(before.max()) + 1
    out = np.zeros((len(parts), most), bool)
    left, right = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for o in range(most):
        own = np.flatnonzero((before >= o) & (before - windows < o))
        if len(own) < 2:
            continue
        left[ahead_at] = np.cumsum(ahead < o)
        right[after_at] = np.cumsum(after < length - o)
        key = left[own] * (len(parts) + 1) + right[own]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        out[own, o] = count[which] > 1
    return out


def _bucketed(docs: DataFrame, length: int) -> DataFrame:
    """Distinct texts of at least ``length`` bytes, bucketed by digest."""
    spark = docs.sparkSession
    path = scratch_path(spark, "suffix-texts")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.where(F.octet_length("text") >= length).select("digest", "text").dropDuplicates(["digest"])
    texts.write.bucketBy(n, "digest").option("path", path).saveAsTable(name)
    return spark.table(name)



def _segments_of(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hash(BLOCK + length)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                digests, rows = [], []
                for d, t in zip(part.column("digest").to_pylist(), part.column("text").to_pylist()):
                    found = segments(t.encode(), length, gram, hashes)
                    digests += [d] * len(found)
                    rows += [(s << 20 | n << 10 | a, v, w) for s, n, a, v, w in found]
                place, anchor, whole = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(place, pa.int64()), pa.array(anchor, pa.int64()), pa.array(whole, pa.int64())],
                    names=["digest", "place", "anchor", "whole"])

    return texts.mapInArrow(run, "digest binary, place long, anchor long, whole long")


def _strings(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(digest, place, anchor, single, part): the bytes of ``wanted`` segments."""
    lists = wanted.groupBy("digest").agg(F.collect_list(F.struct("place", "anchor", "single")).alias("segs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                cols: tuple[list, ...] = ([], [], [], [], [])
                for d, t, segs in zip(*(part.column(c).to_pylist() for c in ("digest", "text", "segs"))):
                    raw = t.encode()
                    for x in segs:
                        s, n = x["place"] >> 20, x["place"] >> 10 & 1023
                        for c, v in zip(cols, (d, x["place"], x["anchor"], x["single"], raw[s : s + n - 1 + length])):
                            c.append(v)
                types = (pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["digest", "place", "anchor", "single", "part"])

    return texts.join(lists.hint("shuffle_hash"), "digest").mapInArrow(run, "digest binary, place long, anchor long, single boolean, part binary")


def _sorted_groups(strings: DataFrame, length: int) -> DataFrame:
    """(digest, start, windows): runs of repeated windows of single segments."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        anchors = np.array([r[2] for r in rows])
        bounds = [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), len(rows)]
        place = np.array([r[1] for r in rows], np.int64)
        before, windows = place & 1023, place >> 10 & 1023
        hit = repeated_windows([r[4] for r in rows], before, windows, bounds, length)
        hit &= np.array([r[3] for r in rows])[:, None]
        pad = np.zeros((len(rows), 1), np.int8)
        edge = np.diff(np.concatenate((pad, hit.astype(np.int8), pad), axis=1), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1]  # bytes before the anchor, one past the run's last
        starts = (place >> 20)[row] + before[row] - (high - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in row.tolist()], pa.binary()), pa.array(starts, pa.int64()), pa.array((high - low).astype(np.int64), pa.int64())],
            names=["digest", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in ("digest", "place", "anchor", "single", "part")))
            if len(held) >= BATCH:
                cut = len(held)
                while cut and held[cut - 1][2] == held[-1][2]:
                    cut -= 1
                if cut:
                    yield work(held[:cut])
                    held = held[cut:]
        if held:
            yield work(held)

    return strings.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "digest binary, start long, windows long")


def _counted_windows(strings: DataFrame, length: int) -> DataFrame:
    """The same for segments of anchors with too many of them: every window's
    hash is counted, and repeated ones are joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [])
            for d, p, single, part in zip(*(b.column(c).to_pylist() for c in ("digest", "place", "single", "part"))):
                for k in range(p >> 10 & 1023):
                    for c, v in zip(cols, (d, (p >> 20) + k, single, xxhash.xxh3_128_digest(part[k : k + length]))):
                        c.append(v)
            types = (pa.binary(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["digest", "start", "single", "window"])

    found = stored(strings.mapInArrow(run, "digest binary, start long, single boolean, window binary"), "suffix-windows")
    again = stored(found.groupBy("window").count().where("count > 1").select("window"), "suffix-again")
    return found.where("single").join(again, "window", "left_semi").select("digest", "start", F.lit(1).cast("long").alias("windows"))


def _kept(texts: DataFrame, cover: DataFrame, length: int) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256) of texts with repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t, runs in zip(*(b.column(c).to_pylist() for c in ("digest", "text", "runs"))):
                raw = t.encode()
                edge = np.zeros(len(raw) + 1, np.int32)
                for r in runs:
                    edge[r["start"]] += 1
                    edge[r["start"] + r["windows"] - 1 + length] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
                left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((d, len(raw) - len(left), spans, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["digest", "n_removed", "n_spans", "kept_sha256"])

    lists = cover.groupBy("digest").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    return texts.join(lists.hint("shuffle_hash"), "digest").mapInArrow(run, "digest binary, n_removed long, n_spans long, kept_sha256 string")


def repeats_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    group = GROUP if group is None else group
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("digest", F.unhex(F.md5("text")))
    ids = stored(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "suffix-ids")
    texts = _bucketed(rows, length)
    segs = stored(_segments_of(texts, length, gram), "suffix-segments")

    anchors = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("whole").alias("a"), F.max("whole").alias("b"))
    # Stored, so that the join shuffles both sides itself and can split an anchor with very many segments.
    anchors = stored(anchors.where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "suffix-anchors")
    again = stored(segs.join(anchors, "anchor"), "suffix-repeated")
    mixed = again.where("mixed")
    kinds = mixed.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "place")).alias("one"))
    kinds = stored(kinds, "suffix-kinds")
    whole = again.where("not mixed").select("digest", "place").unionByName(
        mixed.join(kinds.where("n > 1").select("anchor", "whole"), ["anchor", "whole"], "left_semi").select("digest", "place"))
    wanted = kinds.select("one.digest", "one.place", "anchor", (F.col("n") == 1).alias("single"))
    crowded = small(stored(kinds.groupBy("anchor").count().where(F.col("count") > group).select("anchor"), "suffix-crowded"))
    strings = stored(_strings(texts, wanted, length), "suffix-strings")
    parts = _sorted_groups(strings.join(crowded, "anchor", "left_anti").select(strings.columns), length)
    parts = parts.unionByName(_counted_windows(strings.join(crowded, "anchor", "left_semi").select(strings.columns), length))

    places = whole.select("digest", F.shiftright("place", 20).alias("start"), F.shiftright("place", 10).bitwiseAND(F.lit(1023)).alias("windows"))
    copies = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    cover = places.unionByName(parts)
    partly = stored(_kept(texts, cover, length), "suffix-kept")
    facts = copies.join(partly, "digest", "left")
    met = ids.join(facts, "digest")
    copied = (F.col("n") > 1) & (F.col("n_bytes") >= length)
    none = F.lit(0).cast("long")
    return met.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", none)).alias("n_removed"),
        F.when(copied, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", none)).alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(table(spark, sf_dir, "documents"))
