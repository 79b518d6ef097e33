"""Importance resampling: against the plain definition; the radix sort against sorting."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from areagrade.llm import resample as op
from areagrade.llm.wordhash import NO_WORD, Words

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_of(text):
    words = WORD.findall((text or "").translate(ASCII))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def plain(docs, target, share=25, least_words=20):
    """{doc_id: (n_features, weight, score, rank)}."""
    counts = []
    for texts in ([t for _, t in docs], target):
        c = [0] * 10000
        for t in texts:
            for f in features_of(t)[1]:
                c[f] += 1
        counts.append(c)
    s, t = counts
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    out, known = {}, []
    for i, text in docs:
        n, f = features_of(text)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(f), weight, score, None]
        if n >= least_words:
            known.append((-score, i))
    for rank, (_, i) in enumerate(sorted(known)[: share * len(known) // 100], 1):
        out[i][3] = rank
    return {i: tuple(x) for i, x in out.items()}


def some_docs(n=300):
    r = random.Random(1)
    words = ["alpha", "Beta", "gámma", "x" * 33, "y" * 200, "日本", "e2", "É", "the", "of"] + [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 5, 19, 20, 21, 60, 400]))) + r.choice(["", ".", "\n\x00\x7f!"])) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "?!"), (-5, "long " * 50_000)]


TARGET = ["alpha beta alpha beta w1 w2 w3", "Gámma w7", None, ""]


def test_equals_the_definition(spark, frame):
    docs = some_docs()
    got = op.resample(frame("doc_id long, text string", *docs), frame("item_id int, text string", *enumerate(TARGET)), kept=["doc_id"]).collect()
    assert {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in got} == plain(docs, TARGET)
    assert {r["rank"] for r in got} - {None} == set(range(1, 1 + sum(features_of(t)[0] >= 20 for _, t in docs) // 4))


def test_clashing_columns_repeated_rows_and_nothing(spark, frame):
    schema = "doc_id int, text string, row int, body string, Rank int, mean int, words int, id int, place int"
    text = "word " * 30
    docs = frame(schema, *[(1, text, 2, "b", 3, 4, 5, 6, 7)] * 5, (None, text, 2, "b", 3, 4, 5, 6, 7), (2, text, 2, "b", 3, 4, 5, 6, 7), (3, None, 2, "b", 3, 4, 5, 6, 7))
    target = frame("text string", ("word",))
    got = op.resample(docs, target, share=100).collect()
    assert len(got) == 8 and all((r.row, r.body, r.mean, r.words, r.id, r.place) == (2, "b", 4, 5, 6, 7) for r in got)
    assert sorted(r["rank"] for r in got if r.text) == list(range(1, 8))
    ones = sorted(r["rank"] for r in got if r.doc_id == 1)
    assert ones == list(range(ones[0], ones[0] + 5))
    assert op.resample(docs.where("false"), target).collect() == []
    rarity = plain([(i, text) for i in range(7)] + [(9, None)], [])
    assert {(r.text is None, r.weight) for r in op.resample(docs, target.where("false")).collect()} == {(False, rarity[0][1]), (True, 0)}


@pytest.mark.parametrize("low, high", [(0, 3), (-40, 1000), (-(1 << 63), (1 << 63) - 1), (5, 5)])
def test_radix_ranks_equal_sorting(spark, frame, low, high):
    r = random.Random(low)
    rows = [(i, r.choice([0, 0, 0, 7, -3]), r.randint(low, high) if i % 10 else None) for i in range(700)]
    got = dict(op.radix_ranks(frame("i int, a long, b long", *rows).repartition(5), "i", ["a", "b"], block_bits=5, digit_bits=3 if high < 1 << 40 else 13).collect())
    assert sorted(got.values()) == list(range(1, 701))
    key = {i: (a, b is None, b or 0) for i, a, b in rows}
    ordered = [key[i] for i in sorted(got, key=got.get)]
    assert ordered == sorted(key.values())


def test_radix_ranks_of_few(spark, frame):
    assert op.radix_ranks(frame("i int, a long"), "i", ["a"]).collect() == []
    assert [tuple(r) for r in op.radix_ranks(frame("i int, a long", (4, None)), "i", ["a"]).collect()] == [(4, 1)]


def test_checksums_of_joined_words():
    text = " ".join(["a", "Bc", "z" * 32, "z" * 33, "é" * 40, "0"]).encode()
    words = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 0, NO_WORD)
    crc = op.word_crcs(words)
    plain_ = text.lower().split(b" ")
    assert crc.tolist() == [zlib.crc32(w) for w in plain_]
    assert op.joined_crcs(words, crc, np.arange(5)).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(plain_, plain_[1:])]
