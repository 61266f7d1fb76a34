import hashlib
import random

import pytest

from corpusframe.llm import piece_bpe
from tests.llm.fixtures import awkward, docs_of


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_bpe.MODEL))


@pytest.fixture(scope="module")
def bpe():
    return piece_bpe.PieceBpe(piece_bpe.model_bytes())


def texts(library):
    rnd = random.Random(3)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 31000)]
    for alphabet in ("ab", "abc ", "the and ing ", "01289 ", "()[]{}<>=_- ", "αβγ деж ", "漢字仮名 ", "a\n\t  ", "".join(map(chr, range(0x1F5F0, 0x1F640)))):
        for n in (1, 7, 60, 500):
            yield "".join(rnd.choice(alphabet) for _ in range(n))
    for n in (1, 5, 50):
        for _ in range(40):
            yield "".join(rnd.choice(pieces) for _ in range(n))
            yield "".join(rnd.choice(pieces) for _ in range(n)).replace(" ", "")
    yield from (" " * n for n in (1, 2, 15, 16, 17, 33, 500))
    yield from (" " * n + "word" for n in (15, 16, 17, 33))
    yield from ("a" * 3000, "-" * 999, "!?" * 300, "<s> <0x41> </s>", "a\x00b", "▁x▁▁ y", "\U000E0001")


def test_ids_and_text_equal_the_library(library, bpe):
    for t in texts(library):
        want = library.encode(t)
        assert bpe.encode(t).tolist() == want, t
        assert bpe.decode(want) == library.decode(want), t


def test_decoding_any_ids(library, bpe):
    rnd = random.Random(4)
    for _ in range(500):
        ids = [rnd.choice((rnd.randrange(0, 259), rnd.randrange(259, 32000))) for _ in range(rnd.randrange(12))]
        ids = [i for i in ids if i]
        assert bpe.decode(ids) == library.decode(ids), ids


def test_slices_give_the_same(library, bpe, monkeypatch):
    monkeypatch.setattr(piece_bpe, "SLICE", 3)
    t = "one two three four five six  seven"
    assert bpe.encode(t).tolist() == library.encode(t)


def test_report(spark, library):
    rows = awkward()
    got = piece_bpe.token_report(docs_of(spark, rows), with_ids=True).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    docs = docs_of(spark, rows)
    found, name = piece_bpe.encode(docs)
    assert found.columns == [*docs.columns, name]


def test_empty_table(spark):
    assert piece_bpe.token_report(docs_of(spark, [])).count() == 0
