"""Quality rules: a threshold table compiled into one projection.

``measures`` are built-in expressions over the whole text; ``RULES`` is a table
of (rule, measure per unit, bound); ``verdict`` compiles the table into one
boolean expression. Everything is one projection: no user function, no shuffle.

Words are runs of characters other than space and U+0009 to U+000D. Repeated
words are the words covered by a five-word window found at least twice in the
text: windows are hashed (64 bits), sorted with their positions, neighbours
with equal hashes marked, and the covered positions counted. Lines are
separated by ``\\n``; only lines that hold a word count.

Defined cases. A null or empty text has no words: all measures are 0 and
``base_failed`` is true. A rule whose unit count is below its ``least`` does not
apply (a ratio over a handful of words says nothing). Rows are treated one by
one, so repeated rows give repeated results and an empty table an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusframe.llm.tables import WORD, fresh, table, text_of

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
WINDOW = 5
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "is", "it", "for", "on", "was", "are", "this",
    "de", "la", "le", "les", "des", "et", "un", "une", "que", "du", "est", "pour", "dans",
    "der", "die", "das", "und", "ist", "ein", "eine", "zu", "den", "von", "mit",
    "el", "los", "las", "y", "en", "se", "del", "para", "con", "por",
)


class Rule(NamedTuple):
    """Reject when ``100 * measure`` is outside ``[low, high] * unit``; the rule
    applies to texts with at least ``least`` units."""

    name: str
    measure: str
    unit: str
    low: float | None
    high: float | None
    least: int = 1


#: The threshold table; ratios in percent of the unit.
RULES: tuple[Rule, ...] = (
    Rule("mean word length", "word_chars", "n_words", 200, 1800),
    Rule("symbols per word", "n_symbols", "n_words", None, 10),
    Rule("stop words", "n_stop_words", "n_words", 1, None, 50),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 30, 4),
    Rule("ellipsis lines", "n_ellipsis_lines", "n_lines", None, 30, 4),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 90, 4),
)


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once (a lambda's argument is)."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Number of words in windows of ``WINDOW`` words found twice or more."""

    def of_hashes(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            again = lambda x, i: (
                ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            )
            starts = F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))
            covered = lambda d: F.aggregate(
                F.transform(d, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(d, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0).cast("long"), lambda a, x: a + x,
            )
            return _bind(starts, covered)

        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_bind(ordered, of_sorted))

    hashes = lambda w: F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])
    )
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(_bind(hashes(words), of_hashes))


def measures(text: Column) -> dict[str, Column]:
    """The measures in an order in which each uses only earlier ones."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    stop = "(?<![^\\x20\\x09-\\x0D])(?i:" + "|".join(sorted(STOP_WORDS)) + ")(?![\\p{L}\\p{N}])"
    count = lambda c: F.size(c).cast("long")
    return {
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_stop_words": F.regexp_count(text, F.lit(stop)).cast("long"),
        "by_words": _bind(words, lambda w: F.struct(count(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))),
        "by_lines": _bind(lines, lambda x: F.struct(
            count(x).alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            count(F.filter(x, lambda v: v.rlike("(\\.\\.\\.|…)\\s*$"))).alias("n_ellipsis_lines"),
            count(F.filter(x, lambda v: v.rlike("^\\s*[-*•]\\s"))).alias("n_bullet_lines"),
        )),
    }


def verdict(rules: Sequence[Rule], measure) -> Column:
    """The rules as one boolean: true if none rejects. ``measure``: name to column."""
    ok = F.lit(True)
    for r in rules:
        value, unit = 100 * measure(r.measure), measure(r.unit)
        if r.low is not None:
            ok = ok & ((unit < r.least) | (value >= F.lit(r.low) * unit))
        if r.high is not None:
            ok = ok & ((unit < r.least) | (value <= F.lit(r.high) * unit))
    return ok


def score(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with one more column, a struct named by ``QUALITY``'s fresh
    name, of all measures, base_failed and kept."""
    (m,) = fresh(docs, "quality")
    found = docs.withColumn(m, F.struct(*[c.alias(n) for n, c in measures(text_of(text_col)).items()]))

    def measure(name: str) -> Column:
        c = F.col(m)
        if name in ("n_words", "n_repeat_words"):
            return c["by_words"][name]
        if name.endswith("lines"):
            return c["by_lines"][name]
        return c[name]

    failed = (measure("n_words") < 10) | (100 * measure("n_repeat_words") > 20 * measure("n_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_bullet_lines", "n_repeat_words")
    return found.withColumn(m, F.struct(
        *[measure(n).alias(n) for n in names], failed.alias("base_failed"), (~failed & verdict(rules, measure)).alias("kept")
    ))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    q = found.columns[-1]
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines")
    return found.select("doc_id", *[F.col(f"{q}.{n}").alias(n) for n in out])


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    found = score(docs, text_col, rules)
    return found.where(F.col(found.columns[-1])["kept"]).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"))


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    ok = " AND ".join(
        f"({r.unit} < {r.least} OR 100 * {r.measure} {op} {bound} * {r.unit})"
        for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
    )
    stop = "|".join(sorted(STOP_WORDS))
    space = "[\\x20\\x09-\\x0D]"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (
  SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS win
  FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)
),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
cover AS (
  SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n_repeat_words
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dup) GROUP BY rid
),
lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
),
stops AS (
  SELECT rid, count(*) FILTER (WHERE regexp_matches(x, '^(?i:{stop})($|[^\p{{L}}\p{{N}}])'))::BIGINT AS n_stop_words
  FROM (SELECT rid, unnest(words) AS x FROM w) GROUP BY rid
),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(w.text, '{space}', '', 'g'))::BIGINT AS word_chars,
         (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_stop_words, 0)::BIGINT AS n_stop_words,
         len(ls)::BIGINT AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){space}*$')))::BIGINT AS n_ellipsis_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^{space}*[-*•]{space}')))::BIGINT AS n_bullet_lines
  FROM w JOIN lines USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN stops USING (rid)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {ok} AS kept FROM b
"""
