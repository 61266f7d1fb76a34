"""Secret scans by a randomness test battery, DataFrame functions only.

Base kinds, each leftmost and non-overlapping over the whole text: assignments
(``password = ...``), access keys (``AKIA...``) and long hex runs. The method
adds spans of kind ``random``: runs of ``RUN`` (``=`` ends a run, so names before
it are split off; up to two belong to it as padding) and, of runs that overlap
base spans, what remains between those and is still that long (without the
separators next to the cut), that look like an encoding (hex, base32, lower or upper alphanumeric, base64; each
must mix the classes of its alphabet) and pass three tests of randomness over
that alphabet: chi-squared uniformity of the letters, runs above and below the
alphabet's middle, and lag-1 serial correlation (Bonferroni at ``GATE``).

Passing is easy for a short run, so a second p-value asks how often a run that
is not random would be as even: under the null, two letters of natural text
agree with at least the encoding's natural coincidence rate, and the number of
agreeing pairs has a known mean and spread that grow with the length. A run
that fails the battery has p = 1. Within each length class of all runs of the
corpus, the Benjamini-Hochberg step-up (on p-values rounded up to bins of a
hundredth of a decade) keeps the false discovery rate at ``FDR``.

Positions are code points, found without user functions: the pieces between
matches give the distances, summed by doubling steps.

Scale. One pass over the texts writes spans and candidates (a narrow table);
the thresholds come from at most classes x bins counts; a second pass over the
narrow table applies them. No text is shuffled.

Defined cases. Null text counts as empty: no spans, the hash of an empty
string. Rows are treated one by one; repeated rows count as often as they occur
among the candidates. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusframe.llm.tables import stored, table, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Equal to matching HEX and dropping short matches: a maximal run is long or holds no long part.
LONG_HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Separators beside a blank; one letter each, so that places are kept.
CUT_EDGE = r"[+/_-](?=[+/_-]{0,8} )|(?<= [+/_-]{0,8})[+/_-]"
KINDS = ("assign", "access", "hex", "random")
GATE = 0.01
FDR = 0.05
#: Lower ends of the length classes.
LENGTHS = (20, 32, 64, 128, 256)
BINS_A_DECADE, MOST_DECADES = 100, 40

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Encoding: condition on the bare run, alphabet, natural rate at which two and
#: at which three letters agree (hex: decimal digits; others: English text).
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])([0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef", 0.1, 0.01),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567", 0.065, 0.0058),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER, 0.065, 0.0058),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER, 0.065, 0.0058),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 0.065, 0.0058),
)


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _running(a: Column) -> Column:
    """Running sums of an array: each step adds what lies 1, 2, 4, ... before."""
    steps = lambda x: F.sequence(F.lit(0), F.ceil(F.log2(F.size(x) + 1)).cast("int"))
    add = lambda acc, k: F.transform(
        acc, lambda x, i: x + F.coalesce(F.when(i >= F.expr("1") * F.pow(F.lit(2), k).cast("int"), F.get(acc, i - F.pow(F.lit(2), k).cast("int"))), F.lit(0))
    )
    return _bind(a, lambda x: F.aggregate(steps(x), x, add))


SPAN = "array<struct<start:int,end:int,kind:int,what:string>>"


def _spans(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Matches as (start, end, kind, what); ``what`` is the given group."""

    def found(m: Column) -> Column:
        whole, pieces = m["m"], m["p"]
        steps = F.transform(pieces, lambda x, i: F.length(x) + F.coalesce(F.when(i > 0, F.length(F.get(whole, i - 1))), F.lit(0)))
        return _bind(_running(steps), lambda at: F.transform(whole, lambda x, i: F.struct(
            F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), F.lit(kind).alias("kind"), F.get(m["g"], i).alias("what"))))

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.split(text, pattern, -1).alias("p"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"),
    )
    out = _bind(parts, found)
    if keep is not None:
        out = F.filter(out, keep)
    none = F.array().cast(SPAN)
    return F.when(text.rlike(pattern), out.cast(SPAN)).otherwise(none)


def _erfc(z: Column) -> Column:
    """Complementary error function, relative error below 1.2e-7 (the usual
    Chebyshev fit)."""
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)

    def of(z: Column) -> Column:
        t = 1.0 / (1.0 + 0.5 * F.abs(z))
        poly = F.lit(0.0)
        for c in reversed(fit):
            poly = F.lit(c) + t * poly
        tail = t * F.exp(-z * z + poly)
        return F.when(z >= 0, tail).otherwise(2.0 - tail)

    return _bind(z, of)


def _two_sided(z: Column) -> Column:
    return _erfc(F.abs(z) / math.sqrt(2))


def battery(bare: Column) -> Column:
    """Struct (encoding, uniform, runs, serial, natural) of a run without
    padding; null if it looks like no encoding."""
    out = F.lit(None)
    canon = F.translate(bare, "-_", "+/")
    for name, shape, *facts in reversed(ENCODINGS):
        word = F.lower(canon) if name == "hex" else canon
        out = F.when(canon.rlike(shape), _bind(word, partial(_tests, name, *facts))).otherwise(out)
    return out


def _tests(name: str, alphabet: str, two: float, three: float, s: Column) -> Column:
    size = len(alphabet)
    n = F.length(s).cast("double")
    letters = F.array(*[F.lit(c) for c in alphabet])
    squares = F.aggregate(F.transform(letters, lambda c: F.length(s) - F.length(F.replace(s, c, F.lit("")))), F.lit(0.0), lambda acc, c: acc + c * c)
    high = F.translate(s, alphabet, "0" * (size // 2) + "1" * (size - size // 2))
    ranks = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
    ranks = F.filter(ranks, lambda x: x > 0)

    def of(v: Column) -> Column:
        q, bits, x, mean = v["q"], v["bits"], v["x"], v["mean"]
        freedom = size - 1.0
        chi = F.lit(float(size)) / n * q - n
        root = (F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
        uniform = 0.5 * _erfc(root / math.sqrt(2))
        ones = F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double")
        cross = 2.0 * ones * (n - ones)
        spread = cross * (cross - n) / (n * n * (n - 1.0))
        runs = F.when(spread > 0, _two_sided((F.regexp_count(bits, F.lit("0+|1+")) - cross / n - 1.0) / F.sqrt(spread))).otherwise(F.lit(0.0))
        deviations = F.transform(x, lambda y: y - mean)

        def correlation(d: Column) -> Column:
            total = F.aggregate(d, F.lit(0.0), lambda acc, y: acc + y * y)
            lagged = F.aggregate(F.zip_with(d, F.slice(d, F.lit(2), F.greatest(F.size(d) - 1, F.lit(0))), lambda y, z: y * F.coalesce(z, F.lit(0.0))), F.lit(0.0), lambda acc, y: acc + y)
            return F.when(total > 0, _two_sided((lagged / total + 1.0 / n) * F.sqrt(n))).otherwise(F.lit(0.0))

        pairs = n * (n - 1.0) / 2
        triples = n * (n - 1.0) * (n - 2.0) / 6
        spread_pairs = pairs * (two - two * two) + 6 * triples * max(0.0, three - two * two)
        natural = 0.5 * _erfc((pairs * two - (q - n) / 2) / F.sqrt(spread_pairs) / math.sqrt(2))
        return F.struct(F.lit(name).alias("encoding"), uniform.alias("uniform"), runs.alias("runs"),
                        _bind(deviations, correlation).alias("serial"), natural.alias("natural"))

    mean = F.aggregate(ranks, F.lit(0.0), lambda acc, y: acc + y, lambda acc: acc / n)
    return _bind(F.struct(squares.alias("q"), high.alias("bits"), ranks.alias("x"), mean.alias("mean")), of)


def _rest(run: Column, over: Column) -> Column:
    """The runs that are left of a run when the spans ``over`` are cut out."""

    def blank(what: Column, b: Column) -> Column:
        start = F.greatest(b["start"] - run["start"], F.lit(0))
        end = F.least(b["end"] - run["start"], F.length(what))
        return F.concat(F.substr(what, F.lit(1), start), F.repeat(F.lit(" "), end - start), F.substr(what, end + 1))

    cut = F.aggregate(over, run["what"], blank)
    left = _bind(F.regexp_replace(cut, CUT_EDGE, " "), lambda t: _spans(t, RUN, 3))
    return F.transform(left, lambda c: F.struct(
        (run["start"] + c["start"]).alias("start"), (run["start"] + c["end"]).alias("end"), c["kind"].alias("kind"), c["what"].alias("what")))


def candidates(text: Column, base: Column) -> Column:
    """(start, end, what, test) of the runs that look like an encoding."""
    whole = F.transform(_spans(text, RUN, 3), lambda c: F.struct(
        c.alias("c"), F.filter(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])).alias("over")))
    runs = F.flatten(F.transform(whole, lambda w: F.when(F.size(w["over"]) == 0, F.array(w["c"])).otherwise(_rest(w["c"], w["over"]))))
    tested = F.transform(runs, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), _bind(F.rtrim(c["what"], F.lit("=")), battery).alias("test")))
    return F.filter(tested, lambda c: c["test"].isNotNull() & (F.length(c["test"]["encoding"]) > 0))


def p_value(test: Column) -> Column:
    passes = 3 * F.least(test["uniform"], test["runs"], test["serial"]) >= GATE
    return F.when(passes, test["natural"]).otherwise(F.lit(1.0))


def _class(start: Column, end: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(LENGTHS):
        out = F.when(end - start >= low, F.lit(k)).otherwise(out)
    return out


def _bin(p: Column) -> Column:
    """Largest b with p <= 10 ** (-b / BINS_A_DECADE)."""
    decades = F.when(p > 0, -F.log10(F.least(p, F.lit(1.0)))).otherwise(F.lit(float(MOST_DECADES)))
    return F.least(F.floor(decades * BINS_A_DECADE), F.lit(MOST_DECADES * BINS_A_DECADE)).cast("int")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, base (sorted spans), found (candidates with their
    length class and p-value bin)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    text = F.col("text")
    base = F.concat(
        _spans(text, ASSIGN, 0, lambda s: F.length(s["what"]) >= 6, 2),
        _spans(text, ACCESS, 1, lambda s: s["end"] - s["start"] >= 20),
        _spans(text, LONG_HEX, 2),
    )
    base = F.array_sort(F.transform(base, lambda s: F.struct(s["start"], s["kind"], s["end"])))

    def of(b: Column) -> Column:
        found = F.transform(candidates(text, b), lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), _class(c["start"], c["end"]).alias("size"), _bin(p_value(c["test"])).alias("bin")))
        return F.struct(b.alias("base"), found.alias("found"))

    return rows.select("doc_id", _bind(base, of).alias("s")).select("doc_id", "s.base", "s.found")


def thresholds(scans: DataFrame) -> DataFrame:
    """(size, least_bin): per length class the smallest bin that the step-up
    procedure accepts; classes without discoveries are missing."""
    counts = scans.select(F.explode("found").alias("c")).groupBy("c.size", "c.bin").count()
    up = Window.partitionBy("size").orderBy(F.desc("bin"))  # classes x bins rows at most
    counts = counts.withColumn("found", F.sum("count").over(up)).withColumn("all", F.sum("count").over(Window.partitionBy("size")))
    bound = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) * F.col("all")
    return counts.where(bound <= FDR * F.col("found")).groupBy("size").agg(F.min("bin").alias("least_bin"))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts per base kind, base_sha256, spans, n_random."""
    scans = stored(scanned(docs, id_col, text_col), "secret-scans")
    limit = thresholds(scans).agg(F.map_from_entries(F.collect_list(F.struct("size", "least_bin"))).alias("limit"))
    rows = scans.crossJoin(F.broadcast(limit))  # one row
    added = F.filter("found", lambda c: F.coalesce(c["bin"] >= F.element_at("limit", c["size"]), F.lit(False)))
    rows = rows.withColumn("added", F.transform(added, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def _spans_sql(name: str, pattern: str, group: int = 0, source: str = "d") -> str:
    """CTE of the matches of one pattern in the texts of ``source`` (rid, t)
    with their places."""
    p = pattern.replace("'", "''")
    return f"""
{name}0 AS (SELECT rid, unnest(regexp_extract_all(t, '{p}')) AS w, unnest(regexp_extract_all(t, '{p}', {group})) AS g,
           unnest(regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]) AS piece,
           unnest(range(len(regexp_extract_all(t, '{p}')))) AS i FROM {source} WHERE regexp_matches(t, '{p}')),
{name} AS (SELECT rid, w, g, (sum(length(piece)) OVER o + coalesce(sum(length(w)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS s
           FROM {name}0 WINDOW o AS (PARTITION BY rid ORDER BY i))"""


def _erfc_sql(z: str) -> str:
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + 0.5::DOUBLE * abs({z})))"
    poly = "0.0::DOUBLE"
    for c in reversed(fit):
        poly = f"({c!r}::DOUBLE + {t} * {poly})"
    tail = f"({t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 2.0::DOUBLE - {tail} END)"


def oracle_sql() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    keywords = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = f"({keywords})" + ASSIGN[ASSIGN.index("[\"']?") :]
    mixes = {"hex": ("[0-9]", "[a-fA-F]"), "base32": ("[2-7]", "[A-Z]"), "lower": ("[0-9]", "[a-z]"), "upper": ("[0-9]", "[A-Z]"), "base64": ("[0-9]", "[a-z]", "[A-Z]")}
    shapes = {name: shape[shape.rindex("(?=") :].split(")", 1)[1].strip("^$") for name, shape, *_ in ENCODINGS}
    encoding = " ".join(
        f"WHEN regexp_full_match(canon, '{shapes[n]}') AND " + " AND ".join(f"regexp_matches(canon, '{x}')" for x in mixes[n]) + f" THEN '{n}'"
        for n, *_ in ENCODINGS
    )
    facts = ", ".join(f"('{n}', '{a}', {two!r}::DOUBLE, {three!r}::DOUBLE)" for n, _, a, two, three in ENCODINGS)
    two_sided = lambda z: _erfc_sql(f"(abs({z}) / sqrt(2.0::DOUBLE))")
    kinds = "['" + "','".join(KINDS) + "']"
    size = " ".join(f"WHEN e - s >= {low} THEN {k}" for k, low in reversed(list(enumerate(LENGTHS))))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_spans_sql('a', assign, 2)},{_spans_sql('k', ACCESS)},{_spans_sql('h', LONG_HEX)},{_spans_sql('r', RUN)},
base AS (SELECT rid, s, 0 AS kind, s + length(w) AS e FROM a WHERE length(g) >= 6
         UNION ALL SELECT rid, s, 1, s + length(w) FROM k WHERE length(w) >= 20
         UNION ALL SELECT rid, s, 2, s + length(w) FROM h),
runs AS MATERIALIZED (SELECT row_number() OVER () AS k, rid, w, s, s + length(w) AS e FROM r),
hit AS MATERIALIZED (SELECT runs.k, b.s, b.e FROM runs JOIN base b ON b.rid = runs.rid AND b.s < runs.e AND runs.s < b.e),
letters AS (SELECT k, i, CASE WHEN EXISTS (SELECT 1 FROM hit WHERE hit.k = x.k AND x.s + i >= hit.s AND x.s + i < hit.e) THEN ' ' ELSE substr(w, i::INTEGER + 1, 1) END AS c
            FROM (SELECT *, unnest(range(length(w))) AS i FROM runs WHERE k IN (SELECT k FROM hit)) x),
cut AS (SELECT k, string_agg(c, '' ORDER BY i) AS t FROM letters GROUP BY k),
rest AS (SELECT k AS rid, string_agg(CASE WHEN regexp_matches(c, '[+/_-]') AND (regexp_matches(substr(t, i::INTEGER + 2, 9), '^[+/_-]{{0,8}} ')
                OR regexp_matches(substr(t, greatest(i::INTEGER - 8, 1), least(i::INTEGER, 9)), ' [+/_-]{{0,8}}$')) THEN ' ' ELSE c END, '' ORDER BY i) AS t
         FROM letters JOIN cut USING (k) GROUP BY k),
{_spans_sql('q', RUN, 0, 'rest')},
found AS (SELECT rid, s, w FROM runs WHERE k NOT IN (SELECT k FROM hit) UNION ALL SELECT runs.rid, runs.s + q.s, q.w FROM q JOIN runs ON q.rid = runs.k),
c0 AS (SELECT row_number() OVER () AS cid, rid, s, s + length(w) AS e, translate(rtrim(w, '='), '-_', '+/') AS canon FROM found),
c1 AS (SELECT *, CASE {encoding} END AS enc FROM c0),
c2 AS (SELECT cid, rid, s, e, CASE WHEN enc = 'hex' THEN lower(canon) ELSE canon END AS word, alphabet, length(alphabet)::DOUBLE AS size, two, three
       FROM c1 JOIN (VALUES {facts}) f(name, alphabet, two, three) ON enc = name),
ch AS (SELECT cid, i, strpos(alphabet, substr(word, i::INTEGER, 1))::DOUBLE AS x, size FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM c2)),
cm AS (SELECT *, x - avg(x) OVER (PARTITION BY cid) AS dev, (x > size // 2)::INTEGER AS bit FROM ch),
cl AS (SELECT *, lead(dev) OVER o AS ahead, lag(bit) OVER o AS past FROM cm WINDOW o AS (PARTITION BY cid ORDER BY i)),
st AS (SELECT cid, count(*)::DOUBLE AS n, sum(bit)::DOUBLE AS ones, count_if(past IS NULL OR past <> bit) AS runs, sum(dev * dev) AS total, sum(dev * coalesce(ahead, 0)) AS lagged
       FROM cl GROUP BY cid),
sq AS (SELECT cid, sum(m * m)::DOUBLE AS q FROM (SELECT cid, x, count(*) AS m FROM ch GROUP BY ALL) GROUP BY cid),
z0 AS (SELECT c2.*, n, q, ones, runs, total, lagged, size - 1 AS f, 2.0::DOUBLE * ones * (n - ones) AS cross_, n * (n - 1) / 2 AS pairs, n * (n - 1) * (n - 2) / 6 AS triples
       FROM c2 JOIN st USING (cid) JOIN sq USING (cid)),
z AS (SELECT *, ((pow(greatest(size / n * q - n, 0) / f, {1 / 3!r}::DOUBLE) - (1 - 2 / (9 * f))) / sqrt(2 / (9 * f))) / sqrt(2.0::DOUBLE) AS zu,
             cross_ * (cross_ - n) / (n * n * (n - 1)) AS spread,
             (pairs * two - (q - n) / 2) / sqrt(pairs * (two - two * two) + 6 * triples * greatest(0, three - two * two)) / sqrt(2.0::DOUBLE) AS zn FROM z0),
y AS (SELECT *, CASE WHEN spread > 0 THEN (runs - cross_ / n - 1) / sqrt(spread) END AS zr, CASE WHEN total > 0 THEN (lagged / total + 1 / n) * sqrt(n) END AS zs FROM z),
p AS (SELECT cid, rid, s, e, CASE WHEN 3 * least(0.5 * {_erfc_sql('zu')}, CASE WHEN zr IS NULL THEN 0 ELSE {two_sided('zr')} END,
             CASE WHEN zs IS NULL THEN 0 ELSE {two_sided('zs')} END) >= {GATE} THEN 0.5 * {_erfc_sql('zn')} ELSE 1.0::DOUBLE END AS p FROM y),
b AS (SELECT *, CASE {size} ELSE 0 END AS len_class,
             least(floor(CASE WHEN p > 0 THEN -log10(least(p, 1)) ELSE {MOST_DECADES} END * {BINS_A_DECADE}), {MOST_DECADES * BINS_A_DECADE})::INTEGER AS bin FROM p),
bc AS (SELECT len_class, bin, count(*) AS m FROM b GROUP BY ALL),
up AS (SELECT *, sum(m) OVER (PARTITION BY len_class ORDER BY bin DESC) AS found, sum(m) OVER (PARTITION BY len_class) AS every FROM bc),
lim AS (SELECT len_class, min(bin) AS least_bin FROM up WHERE pow(10.0::DOUBLE, -bin / {float(BINS_A_DECADE)!r}::DOUBLE) * every <= {FDR} * found GROUP BY len_class),
every_span AS (SELECT * FROM base UNION ALL SELECT rid, s, 3, e FROM b JOIN lim USING (len_class) WHERE bin >= least_bin),
g AS (SELECT rid, count_if(kind = 0) AS n_assign, count_if(kind = 1) AS n_access, count_if(kind = 2) AS n_hex, count_if(kind = 3) AS n_random,
             string_agg({kinds}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) FILTER (WHERE kind < 3) AS b,
             string_agg({kinds}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e) AS spans FROM every_span GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0)::BIGINT AS n_random FROM d LEFT JOIN g USING (rid)
"""
