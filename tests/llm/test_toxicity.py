"""Toxicity: readings of hidden words, the lattice against all of its paths, the fit on any number of features."""

import itertools
import re
from math import inf

import numpy as np
import pyarrow as pa
import pytest

from areagrade.llm import toxicity
from areagrade.llm.wordhash import word_slices

TEXT = (
    "the idiot and the moron said stupid pathetic things to a clown at the station in the morning while "
    "all of us will be off to see the better letters that he took from well kept books and it is a good day " * 20
)


@pytest.fixture(scope="module")
def counts():
    c = toxicity._CLASS[np.frombuffer(TEXT.encode(), np.uint8)]
    n = toxicity.SYMBOLS
    return np.bincount((c[:-2] * n + c[1:-1]) * n + c[2:], minlength=n**3).astype(float)


@pytest.mark.parametrize(
    "hidden, read",
    [
        ("í d i o t", "idiot"), ("id.iot", "idiot"), ("id iot", "idiot"), ("st up id", "stupid"), ("iidiott", "idiot"), ("stu-pid!", "stupid"),
        ("mo_ron", "moron"), ("cl own", "clown"), ("1d iot", "idiot"), ("í d í ó t", "idiot"), ("m.o.r.o.n", "moron"), ("i-d-i-o-t", "idiot"),
        ("the id iot said", "the idiot said"), ("a id\niot", "a idiot"), ("sstuppid", "stupid"), ("iiiidiot", "idiot"),
    ],
)
def test_hidden_words_are_read(counts, hidden, read):
    assert texts_read(counts, [hidden]) == [read]


def texts_read(counts, texts):
    out = []
    for words in word_slices(pa.array(texts, pa.string())):
        data, bounds = toxicity.restored(words, toxicity.Restorer(counts))
        out += [data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_plain_texts_stay(counts):
    plain = [TEXT, "", "a", "all of us", "to see, off to see.", "better letters", "it is a good day", "é", "id", "iot", "one\n\ntwo", "...", " ", "the end."]
    assert texts_read(counts, plain) == plain
    assert texts_read(counts, ["id", "iot"] * 3 + ["the i", "diot", None]) == ["id", "iot"] * 3 + ["the i", "diot", ""]


def test_texts_are_read_alone(counts):
    texts = ["id iot", "x", "", "i d i o t", "st up id the", "1d10t", "the", "iidiott"]
    assert texts_read(counts, texts) == [texts_read(counts, [t])[0] for t in texts]


def test_best_path_equals_all_paths(counts):
    model = toxicity.LetterModel(counts)

    def ways(token, spaced):
        """Every reading with its price, each run of equal letters by itself."""
        steps = []
        for m in re.finditer(r"(.)\1*", token):
            x, n = m[1], len(m[0])
            if n >= 3 and x.isalpha():
                steps.append([(x, toxicity.SINGLE_COST), (x * 2, toxicity.SINGLE_COST)])
            elif n == 2 and "a" <= x <= "z":
                steps.append([(x * 2, 0.0), (x, -toxicity.LIKELIER)])
            else:
                steps += [[(x, 0.0), *((y, toxicity.SIGN_COST) for y in toxicity.SIGNS.get(x, ""))]] * n
                if x in "éí":
                    steps[-n:] = [[(x, -1.0 * spaced), ({"é": "e", "í": "i"}[x], 0.0 if spaced else -1.0)]] * n
        for path in itertools.product(*steps):
            for blanks in itertools.product((False, True), repeat=len(path) - 1) if spaced else [(False,) * (len(path) - 1)]:
                out = path[0][0] + "".join(" " * b + p for b, (p, _) in zip(blanks, path[1:]))
                yield out, sum(c for _, c in path) + toxicity.SPLIT_COST * sum(blanks)

    def price(out):
        codes = [0, 0, *(c for byte in (out + " ").encode() for c in [int(toxicity._CLASS[byte])])]
        return sum(model.log[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:]))

    for token, spaced in [("1d10t", False), ("iidiott", False), ("st*p1d", False), ("ídiot", True), ("th3id", True), ("oofff", False), ("é1", True), ("b3tter", False)]:
        best, best_price = "", -inf
        for out, cost in ways(token, spaced):
            if price(out) + cost > best_price:
                best, best_price = out, price(out) + cost
        assert toxicity.decode(token, model, spaced) == best.strip(), token


def test_more_features_than_any_fixed_number():
    """5,000 features, of which one tells: the fit finds it and weighs no other much."""
    pick = np.random.default_rng(3)
    rows, features = 400, 5000
    labels = (np.arange(rows) % 2).astype(float)
    row = np.repeat(np.arange(rows), 20)
    column = pick.integers(1, features, len(row))
    row, column = np.concatenate([row, np.flatnonzero(labels)]), np.concatenate([column, np.zeros(rows // 2, dtype=int)])
    weights, _ = toxicity.fit_logistic((row, column), features, labels, np.ones(rows), 0.5)
    assert weights[0] > 3 and np.abs(weights[1:]).max() < 0.1 * weights[0]
    assert toxicity.fit_logistic((row[:0], column[:0]), 0, labels, np.ones(rows), 0.25)[1] == pytest.approx(np.log(1 / 3), abs=1e-3)
