"""Token counts by a count-only Viterbi over a unigram vocabulary.

A unigram tokenizer cuts a text into the pieces with the greatest sum of
scores. Only the number of pieces is wanted, so no path is kept: for each
position the best score and the piece count of the best way to reach it. An
Aho-Corasick automaton enumerates all vocabulary matches in one pass over a
word, longest first at each end, and a later match wins only with a strictly
greater score. That is the libraries' rule: positions are extended from left to
right and an equal score does not replace the first found. A character that is
no piece itself may be passed at the lowest score less ``UNKNOWN_PENALTY`` and
counts one piece per UTF-8 byte (byte fallback).

Blanks become U+2581 and one is put in front. Where no piece holds that sign
after another character and all scores are whole numbers, words, each with the
blanks before it, are cut independently, and distinct words are solved once per
task: the sums are exact in double precision, so solving words apart gives the
same ties as solving the text at once. With other vocabularies (a trained model
has real scores) the whole text is one run of the dynamic programming, with sums
in the library's order, so that rounding and ties are the library's too; it
keeps as many positions as the longest piece has characters.

The vocabulary is a parameter: pairs of piece and score. The query's comes from
the public 32k model's pieces and scores.

Defined cases: null counts as empty; an empty text has no tokens; rows are
treated one by one; an empty table gives an empty result; texts of over ``LONG``
characters are worked through in slices of ``SLICE`` words, or as one run. Other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusframe.llm.tables import table

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
SLICE = 1 << 16
LONG = 1 << 18
CACHED_WORDS = 500_000
_LOW = float("-inf")

Vocabulary = tuple[tuple[str, float], ...]


def public_vocabulary(path: str | None = None) -> Vocabulary:
    """Ordinary pieces and scores of a sentencepiece model file."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(
        (sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
    )


class UnigramCounter:
    def __init__(self, vocabulary: Sequence[tuple[str, float]]):
        import ahocorasick

        if any(not p or not math.isfinite(s) for p, s in vocabulary):
            raise ValueError("pieces must not be empty and scores must be finite")
        self.apart = all(s == int(s) for _, s in vocabulary) and not any(re.search(f"[^{BLANK}]{BLANK}", p) for p, _ in vocabulary)
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.matches = ahocorasick.Automaton()
        for p, s in vocabulary:
            self.matches.add_word(p, (len(p), s))
        self.matches.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.words = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.cache: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Pieces of the best cut of one word."""
        best, count = [_LOW] * (len(w) + 1), [0] * (len(w) + 1)
        best[0], done = 0.0, 0
        for end, (size, score) in self.matches.iter(w):
            if end > done:
                self._pass(w, best, count, done, end)
                done = end
            start = end + 1 - size
            total = best[start] + score
            if total > best[end + 1]:
                best[end + 1], count[end + 1] = total, count[start] + 1
        self._pass(w, best, count, done, len(w))
        return count[-1]

    def _pass(self, w: str, best: list, count: list, low: int, high: int) -> None:
        """Characters ``low`` to ``high - 1`` that are no piece, once all matches
        that end there are known. Such a character is the shortest, hence the
        last, way to its end."""
        for i in range(low, high):
            if w[i] not in self.single and best[i] + self.unknown > best[i + 1]:
                best[i + 1], count[i + 1] = best[i] + self.unknown, count[i] + len(w[i].encode())

    def whole(self, t: str) -> int:
        """Pieces of the best cut of a marked text, as one run. Positions are
        kept modulo the longest piece's length plus one."""
        size_of_ring = self.longest + 1
        best, count = [_LOW] * size_of_ring, [0] * size_of_ring
        best[0], done = 0.0, 0

        def passed(i: int) -> None:
            """Position ``i + 1`` is final, position ``i + 2`` opens."""
            here, ahead = i % size_of_ring, (i + 1) % size_of_ring
            if t[i] not in self.single and best[here] + self.unknown > best[ahead]:
                best[ahead], count[ahead] = best[here] + self.unknown, count[here] + len(t[i].encode())
            best[(i + 2) % size_of_ring] = _LOW

        for end, (size, score) in self.matches.iter(t):
            while done < end:
                passed(done)
                done += 1
            start, ahead = (end + 1 - size) % size_of_ring, (end + 1) % size_of_ring
            total = best[start] + score
            if total > best[ahead]:
                best[ahead], count[ahead] = total, count[start] + 1
        while done < len(t):
            passed(done)
            done += 1
        return count[len(t) % size_of_ring]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.apart:
            return self.whole(BLANK + text.replace(" ", BLANK))
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        cache, total = self.cache, 0
        for part in self.slices(text):
            for w in set(part).difference(cache):
                cache[w] = self.word(w)
            total += sum(map(cache.__getitem__, part))
        return total

    def slices(self, text: str) -> Iterator[list[str]]:
        """The words of a text, a bounded number at a time."""
        marked = BLANK + text.replace(" ", BLANK)
        if len(text) <= LONG:
            yield self.words.findall(marked)
            return
        found = (m.group() for m in self.words.finditer(marked))
        while part := list(islice(found, SLICE)):
            yield part


@lru_cache(maxsize=2)
def _counter(vocabulary: Vocabulary) -> UnigramCounter:
    return UnigramCounter(vocabulary)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens."""
    sent = public_vocabulary() if vocabulary is None else tuple(vocabulary)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(sent)
        for b in batches:
            counts = [counter.count(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return rows.mapInArrow(run, StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("n_tokens", LongType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
