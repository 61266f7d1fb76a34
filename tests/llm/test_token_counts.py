import random

import pytest

from corpusframe.llm import token_counts
from tests.llm.fixtures import awkward, docs_of


def slow(text, vocabulary):
    """Viterbi over the whole text, from left to right, pieces by length."""
    if not text:
        return 0
    t = "▁" + text.replace(" ", "▁")
    longest = max(map(len, vocabulary))
    unknown = min(vocabulary.values()) - token_counts.UNKNOWN_PENALTY
    best = [(0.0, 0)] + [None] * len(t)
    for i in range(len(t)):
        single = False
        ways = []
        for k in range(1, longest + 1):
            if i + k <= len(t) and t[i : i + k] in vocabulary:
                single |= k == 1
                ways.append((i + k, vocabulary[t[i : i + k]], 1))
        if not single:
            ways.append((i + 1, unknown, len(t[i].encode())))
        for end, score, n in ways:
            total = best[i][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, best[i][1] + n)
    return best[-1][1]


@pytest.fixture(scope="module")
def public():
    return token_counts.public_vocabulary()


def strings(pieces, seed):
    rnd = random.Random(seed)
    for alphabet in ("ab", "abc ", "the and ing ", "αβ γ", "漢字仮名 ", "a\n\t  é"):
        for n in (0, 1, 9, 120):
            yield "".join(rnd.choice(alphabet) for _ in range(n))
    for _ in range(60):
        yield "".join(rnd.choice(pieces) for _ in range(rnd.randrange(30))).replace("▁", " ")
    yield from ("   lead", "trail   ", "\U0001F600\U0001F601 x", "a\x00b", "▁▁x", " ")


def test_counts_equal_whole_text_viterbi(public):
    vocabulary = dict(public)
    counter = token_counts.UnigramCounter(public)
    for t in strings(list(vocabulary), 1):
        assert counter.count(t) == slow(t, vocabulary), t


def test_ties_and_unknown_characters():
    """Few pieces with equal scores: many ties."""
    rnd = random.Random(2)
    for k in range(200):
        vocabulary = {"▁": -2.0}
        for _ in range(rnd.randrange(1, 12)):
            vocabulary[("▁" if rnd.random() < 0.2 else "") + "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4)))] = float(-rnd.randrange(1, 4))
        counter = token_counts.UnigramCounter(tuple(vocabulary.items()))
        for _ in range(10):
            t = "".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(12)))
            assert counter.count(t) == slow(t, vocabulary), (t, vocabulary)


def test_counts_equal_a_tokenizer_library(public):
    """The library's unigram model over the same pieces, with byte fallback."""
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", -2e9)] + [(f"<0x{b:02X}>", -2e9) for b in range(256)] + list(public)
    lowest = min(s for _, s in public)
    vocabulary = [(p, s if s != -2e9 else lowest) for p, s in vocabulary]
    model = Tokenizer(models.Unigram(vocabulary, 0, True))
    counter = token_counts.UnigramCounter(public)
    for t in strings([p for p, _ in public], 3):
        if t:
            assert counter.count(t) == len(model.encode("▁" + t.replace(" ", "▁")).ids), t


def test_report(spark, public):
    vocabulary = dict(public)
    rows = [r for r in awkward() if len(r[1] or "") < 5000]
    got = token_counts.count_tokens(docs_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], slow(r[1], vocabulary)) for r in rows), key=str)
    assert token_counts.count_tokens(docs_of(spark, [])).count() == 0


def random_vocabulary(rnd, score):
    out = {"▁": score()}
    for _ in range(rnd.randrange(1, 40)):
        inner = "".join(rnd.choice("abc▁" if rnd.random() < 0.1 else "abc") for _ in range(rnd.randrange(1, 6)))
        out[("▁" if rnd.random() < 0.3 else "") + inner] = score()
    return out


def test_real_scores_equal_whole_text_viterbi_and_a_library():
    """Fractional scores, many of them equal, and pieces with blanks inside."""
    from tokenizers import Tokenizer, models

    rnd = random.Random(7)
    for k in range(150):
        some = [-rnd.random() * 3 - 0.1 for _ in range(3)]
        vocabulary = random_vocabulary(rnd, (lambda: rnd.choice(some)) if k % 2 else lambda: -rnd.random() * 5)
        counter = token_counts.UnigramCounter(tuple(vocabulary.items()))
        assert not counter.apart
        lowest = min(vocabulary.values())
        model = Tokenizer(models.Unigram([("<unk>", lowest)] + [(f"<0x{b:02X}>", lowest) for b in range(256)] + list(vocabulary.items()), 0, True))
        for _ in range(12):
            t = "".join(rnd.choice("abcd é ") for _ in range(rnd.choice((3, 12, 200))))
            want = slow(t, vocabulary)
            assert counter.count(t) == want, (t, vocabulary)
            if t:
                assert want == len(model.encode("▁" + t.replace(" ", "▁")).ids), (t, vocabulary)


def test_whole_run_equals_words_apart(public):
    counter = token_counts.UnigramCounter(public)
    assert counter.apart
    for t in strings([p for p, _ in public], 5):
        if t:
            assert counter.whole("▁" + t.replace(" ", "▁")) == counter.count(t)


def test_trained_vocabulary_report(spark, public):
    """Real scores through the operator, whole texts of awkward rows."""
    rnd = random.Random(1)
    vocabulary = {p: -1.0 - 10 * rnd.random() for p, _ in public[:4000]}
    rows = [r for r in awkward() if len(r[1] or "") < 5000]
    got = token_counts.count_tokens(docs_of(spark, rows), vocabulary=tuple(vocabulary.items())).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((r[0], slow(r[1], vocabulary)) for r in rows), key=str)


def test_bad_vocabulary():
    for bad in ((("", -1.0),), (("a", float("nan")),), (("a", float("-inf")),)):
        with pytest.raises(ValueError):
            token_counts.UnigramCounter(bad)
