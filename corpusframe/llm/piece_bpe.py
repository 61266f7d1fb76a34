"""SentencePiece encoding and decoding by vectorised merge rounds.

Encoding reproduces the library for BPE models with byte fallback, identity
normalisation and a dummy prefix. Blanks become U+2581 and the text is cut
before every run of them: no piece holds that sign after another character
(checked when the model is loaded), so no merge crosses a cut. Distinct words
are encoded once per task.

The words' symbols lie in one flat numpy array. In each round every word finds
its best pair rank (a segmented minimum) and merges its leftmost occurrence. It
merges further occurrences in the same round where the library's order gives
the same result: all non-overlapping ones from the left if the piece cannot be
continued by a better merge, else those at least ``APART`` characters behind
the one before (a piece has at most ``LONGEST`` characters, so what follows
from one merge ends before the next). Pairs of equal score merge one at a time.
Finished words leave the arrays; rounds go on until no pair remains. Characters
without a piece become their UTF-8 bytes' pieces.

Rows are taken ``ROWS`` at a time. Texts of over ``LONG`` characters are worked
through in slices of ``SLICE`` words, so a very long text needs no more memory
than its slices and its ids. A word's ids, their decimal form and their decoded
bytes are kept with it: ids decode piece by piece, so a text's decoded form is
its words' forms in a row, less the dummy prefix.

Defined cases: null counts as empty; an empty text has no ids and decodes to
an empty text; rows are treated one by one; other columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpusframe.llm.tables import fresh, table

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
LONGEST = 16
APART = 64
SLICE = 1 << 16
ROWS, LONG = 400, 1 << 18
CACHED_WORDS = 400_000
_NONE = np.iinfo(np.int32).max


class PieceBpe:
    """A model's tables, the encoder and the decoder."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        words = {p: i for i, p in enumerate(pieces) if not special[i]}
        if any(re.search(f"[^{BLANK}]{BLANK}", p) or len(p) > LONGEST for p in words):
            raise ValueError("pieces must hold blanks only in front and have at most 16 characters")
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        tied = np.bincount(rank[list(words.values())], minlength=n + 1) > 1
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.char_id = -1 - np.arange(0x110000, dtype=np.int32)
        for p, i in words.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        pairs = [(words[p[:k]], words[p[k:]], i) for p, i in words.items() for k in range(1, len(p)) if p[:k] in words and p[k:] in words]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs))
        self.width = n
        order = np.argsort(left * n + right)
        self.pair_key = (left * n + right)[order]
        self.pair_piece = merged[order].astype(np.int32)
        self.pair_rank = rank[self.pair_piece]
        best_next = np.full(n, _NONE, np.int32)
        np.minimum.at(best_next, left, rank[merged])
        np.minimum.at(best_next, right, rank[merged])
        # By rank: 0 merge the leftmost only, 1 all that lie apart, 2 all from the left.
        self.mode = np.zeros(n + 1, np.int8)
        for i in words.values():
            self.mode[rank[i]] = 0 if tied[rank[i]] else 2 if best_next[i] > rank[i] else 1
        run = all(BLANK * k in words for k in range(1, LONGEST + 1)) and len({scores[words[BLANK * k]] for k in range(2, LONGEST + 1)}) == 1
        run = run and not any(re.match(f"{BLANK}{BLANK}+[^{BLANK}]", p) for p in words)
        # Long runs of blanks are filled from the left with the longest blank piece.
        self.segment = re.compile((f"{BLANK}{{{LONGEST}}}(?={BLANK})|" if run else "") + f"{BLANK}*[^{BLANK}]+|{BLANK}+")
        self.bytes_of = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append((" ⁇ " if sp.is_unknown(i) else p.replace(BLANK, " ")).encode())
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.shown = np.array([not sp.is_control(i) for i in range(n)])
        self.blank_first = np.array([p.startswith(BLANK) for p in pieces])
        self.cache: dict[str, tuple[bytes, str, bytes]] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; rank ``_NONE`` if it has no piece."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.width + right)
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        found = self.pair_key[at] == key
        return np.where(found, self.pair_rank[at], _NONE), self.pair_piece[at]

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, word numbers), flat, by word; symbols below 0 are
        ``-1 - code point`` of characters without a piece."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sym = self.char_id[points]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        pos = np.arange(len(sym))
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def ranked(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            j = np.minimum(i + 1, len(sym) - 1)
            r, p = self._pairs(sym[i], sym[j])
            return np.where((j > i) & (word[i] == word[j]), r, _NONE), p

        rank, piece = ranked(np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            if (best == _NONE).any():
                over = np.repeat(best == _NONE, sizes)
                done.append((sym[over], word[over]))
                sym, word, pos, rank, piece = (x[~over] for x in (sym, word, pos, rank, piece))
                if not len(sym):
                    break
                best, sizes = best[best != _NONE], sizes[best != _NONE]
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            first = np.concatenate(([True], word[hit[1:]] != word[hit[:-1]]))
            mode = self.mode[rank[hit]]
            joins = ~first & np.concatenate(([False], hit[1:] == hit[:-1] + 1))
            run = np.flatnonzero(~joins)
            even = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0
            apart = np.concatenate(([True], pos[hit[1:]] - pos[hit[:-1]] >= APART))
            hit = hit[first | ((mode == 2) & even) | ((mode == 1) & apart)]
            sym[hit] = piece[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word, pos, rank, piece = (x[stay] for x in (sym, word, pos, rank, piece))
            at = hit - np.arange(len(hit))
            at = np.unique(np.concatenate((at, np.maximum(at - 1, 0))))
            rank[at], piece[at] = ranked(at)
        if not done:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        sym, word = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that are not in the cache."""
        new = [w for w in words if w not in self.cache]
        sym, word = self.merge_rounds(new)
        ends = np.searchsorted(word, np.arange(len(new)), "right").tolist()
        sym, begin = sym.tolist(), 0
        for w, end in zip(new, ends):
            ids = []
            for s in sym[begin:end]:
                if s >= 0:
                    ids.append(s)
                else:
                    ids += [self.byte_id[b] for b in chr(-1 - s).encode()]
            decoded = b"".join([self.bytes_of[i] for i in ids])
            self.cache[w] = (np.array(ids, np.int32).tobytes(), ",".join(map(str, ids)), decoded)
            begin = end

    def slices(self, text: str | None) -> Iterator[list[str]]:
        """The words of a text, in order, a bounded number at a time."""
        if text:
            marked = BLANK + text.replace(" ", BLANK)
            if len(text) <= LONG:
                yield self.segment.findall(marked)
                return
            found = (m.group() for m in self.segment.finditer(marked))
            while part := list(islice(found, SLICE)):
                yield part

    def digests(self, parts: Iterable[list[str]]) -> tuple[np.ndarray, str, str]:
        """ids, and the hashes of their decimal form and of the decoded text,
        of a text given as slices of learned words."""
        shown, back, flat = hashlib.sha256(), hashlib.sha256(), []
        for part in parts:
            got = [self.cache[w] for w in part]
            shown.update((("," if flat else "") + ",".join([x[1] for x in got])).encode())
            raw = b"".join([x[2] for x in got])
            back.update(raw if flat else raw[1:])  # the first piece starts with the dummy prefix
            flat.append(b"".join([x[0] for x in got]))
        return np.frombuffer(b"".join(flat), np.int32), shown.hexdigest(), back.hexdigest()

    def encode(self, text: str | None) -> np.ndarray:
        out = []
        for part in self.slices(text):
            self.learn(set(part))
            out += [self.cache[w][0] for w in part]
        return np.frombuffer(b"".join(out), np.int32)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of ``ids``; bytes that are not UTF-8 become U+FFFD one by one."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            out, kind = [], self.is_byte[ids]
            cuts = np.flatnonzero(kind[1:] != kind[:-1]) + 1
            for part in np.split(ids, cuts):
                piece = b"".join(map(self.bytes_of.__getitem__, part.tolist()))
                while piece:
                    try:
                        piece.decode()
                        out.append(piece)
                        break
                    except UnicodeDecodeError as e:
                        out.append(piece[: e.start] + "�".encode())
                        piece = piece[e.start + 1 :]
            raw = b"".join(out)
        shown = ids[self.shown[ids]][:1]  # the dummy prefix is the blank of the first piece
        return raw[1:] if len(shown) and self.blank_first[shown[0]] else raw

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode()


def model_bytes(path: str | None = None) -> bytes:
    """The model's file, read once on the driver and sent along with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> PieceBpe:
    return PieceBpe(model)


def encode(docs: DataFrame, text_col: str = "text", model: bytes | None = None, with_ids: bool = True, name: str = "tokens") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (n_tokens, ids_sha256, decoded_sha256 and,
    unless ``with_ids`` is false, ids); returns the column's name too, which no
    column of ``docs`` has."""
    (out,) = fresh(docs, name)
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids
    sent = model or model_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = b.slice(at, ROWS)
                texts = rows.column(text_col).to_pylist()
                if len(bpe.cache) > CACHED_WORDS:
                    bpe.cache.clear()
                held = [None if t and len(t) > LONG else list(bpe.slices(t)) for t in texts]
                new: set[str] = set()
                for t, parts in zip(texts, held):
                    for part in bpe.slices(t) if parts is None else parts:
                        new.update(part)
                bpe.learn(new)
                done = [bpe.digests(bpe.slices(t) if parts is None else parts) for t, parts in zip(texts, held)]
                arrays = [pa.array([len(d[0]) for d in done], pa.int64()), *(pa.array([d[k] for d in done], pa.string()) for k in (1, 2))]
                if with_ids:
                    arrays.append(pa.array([d[0] for d in done], pa.list_(pa.int32())))
                tokens = pa.StructArray.from_arrays(arrays, names=[f.name for f in fields])
                yield pa.RecordBatch.from_arrays([*rows.columns, tokens], names=[*rows.schema.names, out])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, StructType(fields))])), out


def token_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: bytes | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) per row."""
    found, t = encode(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", model, with_ids)
    return found.select("doc_id", f"{t}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"))
