"""Phrase collocations from a weighted de Bruijn graph.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and
into words at spaces and tabs; everything is per language (null: ``und``). An
edge of the graph is a phrase of ``LONGEST`` words inside a piece, its weight how
often it occurs; it leads from the node of its first ``LONGEST - 1`` words to the
node of its last ones.

0. Cuts. Adjacent pairs and triples of words are counted by a hash; one whose
   hash occurs fewer than ``least`` times lies in no frequent phrase.
1. Edges. At every word the longest phrase that starts there and holds no such
   pair or triple is counted: an edge, or fewer words. So each occurrence of a
   frequent phrase, and each word, starts one phrase counted.
2. Shorter counts come from the flow through the nodes: a phrase occurs as often
   as all phrases that are one word longer and start with it, plus the ones
   counted in step 1 that are no longer than it. One level after the other
   gives every phrase of 4, 3 and 2 words, every word, and the number of words.
3. Unary paths are compacted: a node that has the weight of one edge in and of
   one edge out has no other edge, and no piece starts or ends there; such edges
   are joined into one path of constant weight (pointers are doubled until they
   reach the path's head). Nodes on a path that have its weight are part of a
   longer phrase that occurs as often, so they are no candidates.
4. The other candidates are scored by their weakest cut, in whole numbers of up
   to 38 digits, and ranked per language.

Scale. Pairs and triples are counted as numbers of ``PAIRS``, first in each task,
a few millions at once, then in the parts of the range, to which they are dealt
as arrays. What comes of it is a bitmap of ``PAIRS`` bits, whatever the input's
size: the larger the corpus, the less it cuts, and the counts are exact with any
bitmap. Tasks count ``HELD`` phrases at once, so a frequent phrase is one row of
each such count. Edges are dealt by their node, so that edges and nodes are summed
after one shuffle; the lower levels are sums with partial sums before each shuffle,
so no word or short phrase makes a hot task. A phrase of ``least`` occurrences is
passed on as finished and is not counted again. Steps 3 and 4 work on phrases of
at least ``least`` occurrences only: a path or candidate has no other parts.

Defined cases. Null and blank texts have no words; a null language is ``und``.
Very long texts are counted like others (a task holds one Arrow batch of texts).
Repeated rows count each time. Ties: the cut after fewest words; equal scores by
count, then phrase in byte order. Ranks are gapless. An empty table, or one
without a frequent phrase, gives an empty result. A phrase of one word more that
occurs as often shows that a candidate lies inside a longer one: every longer
phrase with the same count contains such a one. Only the text and language
columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.llm.tables import small, stored, table, text_of

LONGEST = 5
LEAST = 100
TOP = 2000
#: Phrases, or numbers of pairs and triples, that a task holds before it counts
#: them and passes them on, and rows of a batch.
HELD = 1 << 22
BATCH = 50_000
#: Numbers by which nodes are dealt to tasks.
DEALT = 1 << 20
#: Lots in which a language's candidates are ranked first.
LOTS = 64
#: Bits of the bitmap, half of them of pairs, half of triples (a power of two),
#: and parts in which they are counted.
PAIRS = 1 << 28
PARTS = 1 << 10
#: Bytes of texts that a task takes at once, and rows it reads for them.
LOT = 1 << 20
ROWS = 256

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_READ = bytes.maketrans(_UPPER + _ENDS + b"\t", _UPPER.lower() + b"\n" * len(_ENDS) + b" ")
#: Masks of the first 0 to 8 bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)

# ------------------------------------------------------------- counting


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text) -> (lang, texts of it, together about ``LOT`` bytes or one
    text): pieces end with a line end, words of a piece are one space apart."""
    held: dict[str, list[bytes]] = {}

    def passed_on() -> Iterator[tuple[str, bytes]]:
        for lang, texts in held.items():
            text = b"\n".join(texts).translate(_READ)
            while b"  " in text:
                text = text.replace(b"  ", b" ")
            yield lang, text
        held.clear()

    size = 0
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= LOT:
                    yield from passed_on()
                    size = 0
    yield from passed_on()


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of a lot, and for each word but the last
    whether the next one is of the same piece."""
    a = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=bool)
    inside[1:-1] = (a != ord(" ")) & (a != ord("\n"))
    at = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = at[::2], at[1::2]
    return starts, ends, (starts[1:] == ends[:-1] + 1) & (a[ends[:-1]] == ord(" "))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(32)


def _numbers(lang: str, text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the pairs and triples of adjacent words, by their first
    word: those of pairs are the lower half of ``PAIRS``. A word is hashed by its
    first and last 8 bytes and its length."""
    eight = np.ndarray(len(text), "<u8", text + bytes(8), strides=(1,))  # the 8 bytes from each place on
    size = ends - starts
    first = eight[starts] & _FIRST[np.minimum(size, 8)]
    last = np.where(size > 8, eight[np.maximum(ends - 8, 0)], first)
    words = _mixed(_mixed(first, last), (size + (crc32(lang.encode()) << 31)).astype(np.uint64))
    pairs = _mixed(words[:-1], words[1:])
    triples = _mixed(pairs[:-1], words[2:])
    half = PAIRS // 2
    return tuple((x & np.uint64(half - 1)).astype(np.int32) + np.int32(at) for x, at in ((pairs, 0), (triples, half)))


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (part, numbers, n): the numbers found, in the ``PARTS``
    parts of their range, each with its count."""
    held, size = [], 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        found = np.sort(np.concatenate(held or [np.empty(0, np.int32)]))
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
        numbers, n = found[first], np.diff(np.append(first, len(found))).astype(np.int32)
        bounds = pa.array(np.searchsorted(numbers, np.arange(PARTS + 1) * (PAIRS // PARTS)), pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (numbers, n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), *lists], ["part", "numbers", "n"])
        held.clear()

    for lang, text in _lots(batches):
        starts, ends, joined = _words(text)
        pairs, triples = _numbers(lang, text, starts, ends)
        held += [pairs[joined], triples[joined[:-1] & joined[1:]]]
        size += len(held[-2]) + len(held[-1])
        if size >= HELD:
            yield from passed_on()
            size = 0
    if size:
        yield from passed_on()


def _frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(part, numbers, n), the rows of a part together -> (part, bits)."""
    at, counts = None, None

    def passed_on() -> Iterator[pa.RecordBatch]:
        if at is not None:
            bits = np.packbits(counts >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([at], pa.int32()), "bits": pa.array([bits], pa.binary())})

    for b in batches:
        numbers, n = b.column(1), b.column(2)
        for i, part in enumerate(b.column(0).to_pylist()):
            if part != at:
                yield from passed_on()
                at, counts = part, np.zeros(PAIRS // PARTS, dtype=np.int64)
            counts[numbers[i].values.to_numpy() % len(counts)] += n[i].values.to_numpy()  # each number once
    yield from passed_on()


def frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """The bitmap, as bytes: bits of the numbers of pairs and triples that occur
    ``least`` times."""
    counts = texts.mapInArrow(_count_pairs, "part int, numbers array<int>, n array<int>")
    counts = counts.repartition("part").sortWithinPartitions("part")
    found = counts.mapInArrow(partial(_frequent, least=least), "part int, bits binary").toArrow()  # PAIRS bits
    bitmap = np.zeros((PARTS, PAIRS // PARTS // 8), dtype=np.uint8)
    for part, bits in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
        bitmap[part] = np.frombuffer(bits, dtype=np.uint8)
    return bitmap.ravel()


def _phrases(text: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> Iterator[pa.Array]:
    """The phrases of ``words`` words from each word of a lot on."""
    for k in range(1, LONGEST + 1):
        of = np.flatnonzero(words == k)
        for first in range(k):
            at = of[of % k == first]  # these do not overlap: with the gaps between them they are one array
            if len(at):
                places = np.stack([starts[at], ends[at + k - 1]], axis=1).astype(np.int32).ravel()
                found = pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer(places), pa.py_buffer(text)])
                yield found.take(pa.array(np.arange(0, len(places), 2)))


def _edges(batches: Iterator[pa.RecordBatch], kept) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, g, n): the phrases that start at each word."""
    held: dict[str, list[pa.Array]] = {}
    bitmap, size = kept.value, 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for lang, phrases in held.items():
            counts = pa.chunked_array(phrases).value_counts()
            for at in range(0, len(counts), BATCH):
                part = counts.slice(at, BATCH)
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(part)), part.field("values").cast(pa.string()), part.field("counts")]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "g", "n"])
        held.clear()

    for lang, text in _lots(batches):
        starts, ends, joined = _words(text)
        many = len(starts)
        if not many:
            continue
        pairs, triples = (((bitmap[x >> 3] >> (x & 7).astype(np.uint8)) & 1).astype(bool) for x in _numbers(lang, text, starts, ends))
        pairs = np.append(joined & pairs, [False] * LONGEST)
        triples = np.append(triples, [False] * LONGEST)
        words, on = np.ones(many, dtype=np.int64), pairs[:many].copy()
        for k in range(LONGEST - 1):  # one word more, if its pair and its triple are frequent
            if k:
                on &= pairs[k : many + k] & triples[k - 1 : many + k - 1]
            words += on
        found = list(_phrases(text, starts, ends, words))
        held.setdefault(lang, []).extend(found)
        size += sum(max(len(p), p.nbytes // 16) for p in found)  # long ones count more
        if size >= HELD:
            yield from passed_on()
            size = 0
    yield from passed_on()


def _level(rows: DataFrame, words: int, least: int, keys: list[str]) -> DataFrame:
    """Counts of phrases of ``words`` words from those of one word more. Rows of
    at least ``least`` occurrences that are longer are also passed on as done."""
    shorter = F.substring_index("g", " ", words) if words else F.lit("")
    up = F.struct(shorter.alias("g"), "n", F.lit(False).alias("done"))
    done = F.struct("g", "n", F.lit(True).alias("done"))
    longer = (F.col("n") >= least) & (F.col("g") != shorter)
    each = F.when(F.col("done"), F.array(done)).when(longer, F.array(up, done)).otherwise(F.array(up))
    # explode_outer: for explode the optimizer would evaluate the array twice
    each = rows.select(*keys, F.explode_outer(each).alias("e")).select(*keys, "e.*")
    return each.groupBy(*keys, "g", "done").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, g, n), stored: every phrase of at most ``LONGEST`` words with at
    least ``least`` occurrences, and one row with an empty phrase per language
    that has words: the number of its words."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(lang.alias("lang"), text_of(text_col).alias("text"))
    kept = docs.sparkSession.sparkContext.broadcast(frequent_pairs(texts, least))  # PAIRS bits
    edges = texts.mapInArrow(partial(_edges, kept=kept), "lang string, g string, n long")
    node = F.xxhash64("lang", F.substring_index("g", " ", LONGEST - 1))
    edges = edges.withColumn("p", F.pmod(node, F.lit(DEALT)).cast("int")).repartition("p")
    # Grouped by p as well, edges and nodes are summed where they were dealt to.
    rows = edges.groupBy("p", "lang", "g").agg(F.sum("n").alias("n")).withColumn("done", F.lit(False))
    for words in range(LONGEST - 1, -1, -1):
        rows = _level(rows, words, least, ["p", "lang"] if words == LONGEST - 1 else ["lang"])
    return stored(rows.where("done OR g = ''").select("lang", "g", "n"), "phrase-counts")


# ------------------------------------------------------------- the graph


def _n_words():
    return F.size(F.split("g", " "))


def unary_paths(counts: DataFrame) -> DataFrame:
    """(lang, path, n, edges), stored: the edges of ``phrase_counts`` with their
    maximal unary paths compacted; ``path`` is the array of its words."""
    nodes = counts.where(_n_words() == LONGEST - 1)
    edges = counts.where(_n_words() == LONGEST)
    near = LONGEST - 1
    into = edges.select("lang", "n", F.col("g").alias("head"), F.substring_index("g", " ", -near).alias("v"))
    out = edges.select("lang", "n", F.col("g").alias("g"), F.substring_index("g", " ", near).alias("v"))
    links = into.join(nodes.withColumnRenamed("g", "v"), ["lang", "v", "n"]).join(out, ["lang", "v", "n"]).select("lang", "g", "head")
    jumps = edges.join(links, ["lang", "g"], "left").select(
        "lang", "g", "n", F.coalesce("head", "g").alias("head"), F.col("head").isNotNull().cast("long").alias("d")
    )
    jumps, far = stored(jumps, "phrase-jumps"), -1
    while (now := jumps.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]) != far:
        far = now
        ahead = jumps.select("lang", F.col("g").alias("head"), F.col("head").alias("next"), F.col("d").alias("more"))
        jumps = jumps.join(ahead, ["lang", "head"]).select("lang", "g", "n", F.col("next").alias("head"), (F.col("d") + F.col("more")).alias("d"))
        jumps = stored(jumps, "phrase-jumps")
    # A path is no longer than a piece that holds it.
    last = F.substring_index("g", " ", -1)
    paths = jumps.groupBy("lang", "head").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", last.alias("w")))).alias("steps"))
    path = F.concat(F.split(F.substring_index("head", " ", near), " "), F.transform("steps", lambda s: s["w"]))
    return stored(paths.select("lang", path.alias("path"), "n", F.size("steps").alias("edges")), "phrase-paths")


def candidates(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """(lang, g, n): phrases of 2 and more words that do not lie inside a longer
    phrase with the same count."""
    near = LONGEST - 1
    on_path = F.transform(F.sequence(F.lit(1), F.size("path") - near + 1), lambda i: F.array_join(F.slice("path", i, near), " "))
    inside = paths.select("lang", F.explode_outer(on_path).alias("g"), "n")
    shorter = counts.where(_n_words().between(3, near)).withColumn("w", _n_words())
    parts = F.array(F.expr("substring_index(g, ' ', w - 1)"), F.expr("substring_index(g, ' ', 1 - w)"))
    inside = inside.unionByName(shorter.select("lang", F.explode_outer(parts).alias("g"), "n"))
    return counts.where(_n_words() >= 2).join(inside, ["lang", "g", "n"], "left_anti")


def scored(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` (lang, g, n) -> (lang, phrase, a, l, r, n, score)."""
    cuts = found.select("lang", "g", F.col("n").alias("a"), _n_words().alias("w"))
    cuts = cuts.withColumn("k", F.explode(F.expr("sequence(1, w - 1)")))
    cuts = cuts.select("lang", "g", "a", "k", F.expr("substring_index(g, ' ', k)").alias("left"), F.expr("substring_index(g, ' ', k - w)").alias("right"))
    of = lambda part, n: small(counts).select("lang", F.col("g").alias(part), F.col("n").alias(n))
    met = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    total = counts.where("g = ''").select("lang", "n")
    met = met.join(small(total), "lang")
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = met.groupBy("lang", "g").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", F.col("g").alias("phrase"), "b.a", "b.l", "b.r", "b.n", "b.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a (its
    occurrences), l and r (those of the parts of its weakest cut), n (words of
    the language), score."""
    counts = phrase_counts(docs, least, text_col, lang_col)
    found = scored(candidates(counts, unary_paths(counts)), counts)
    by = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # A language's best are among the best of its lots, so that one task ranks
    # at most LOTS * top rows of it, however many candidates there are.
    lots = found.withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(LOTS)).cast("int"))
    best = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*by))).where(F.col("rank") <= top).drop("lot")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle_sql() -> str:
    words = [f"w{i}" for i in range(1, LONGEST + 1)]
    counted = "\n  UNION ALL ".join(
        f"SELECT lang, [{', '.join(words[:k])}] AS p, count(*) AS f FROM g WHERE w{k} IS NOT NULL GROUP BY lang, {', '.join(words[:k])}"
        for k in range(1, LONGEST + 1)
    )
    later = ", ".join(f"lead(w1, {k - 1}) OVER o AS w{k}" for k in range(2, LONGEST + 1))
    upper = _UPPER.decode()
    return rf"""
WITH pieces AS MATERIALIZED (
  SELECT row_number() OVER () AS id, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
),
t AS (
  SELECT id, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i
  FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)
),
g AS MATERIALIZED (SELECT lang, w1, {later} FROM t WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS MATERIALIZED (
  {counted}
),
c AS MATERIALIZED (SELECT * FROM f WHERE len(p) >= 2 AND f >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
inside AS (
  SELECT DISTINCT lang, p[i:j] AS p, f FROM c, range(1, {LONGEST + 1}) a(i), range(1, {LONGEST + 1}) b(j)
  WHERE j <= len(p) AND i < j AND j - i + 1 < len(p)
),
kept AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.p = c.p AND 100 * x.f >= 100 * c.f)),
cuts AS (
  SELECT kept.lang, kept.p, kept.f AS a, k, l.f AS l, r.f AS r, n.n,
         ((1000::HUGEINT * kept.f * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM kept JOIN range(1, {LONGEST}) t(k) ON k < len(kept.p) JOIN n USING (lang)
  JOIN f l ON l.lang = kept.lang AND l.p = kept.p[1:k] JOIN f r ON r.lang = kept.lang AND r.p = kept.p[k + 1:]
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
         array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM best
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
