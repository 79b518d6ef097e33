"""Fill-in-middle: against the plain definition."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from areagrade.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def some_texts():
    r = random.Random(3)
    shared = "".join(r.choice("abc déß \t\n日本 ") for _ in range(5000))
    return [
        None,
        "",
        " ",
        "one",
        "  one\n",
        "a b\tc \x0b\x0cd\r\n",
        "no\xa0break is a word",
        "a <P> mark",
        "<S",
        "x <M",
        "w" * 40_000,
        " " * 40_000,
        "é" * 20_000 + " end",
        "ab " * 30_000,
        shared,
        "front " + shared,
        shared + shared,
        shared[:2500] + "changed" + shared[2500:],
        "".join(chr(r.choice([32, 97, 0x1F600, 0x0301, 10])) for _ in range(20_000)),
    ]


def test_equals_the_definition(frame):
    rows = [(i, t, "kept") for i, t in enumerate(some_texts() * 6)] + [(5, "twice the same row", "x")] * 2 + [(None, "no id at all", "x")]
    docs = frame("doc_id long, text string, Form string", *rows)
    made = middle.fill_in_middle(docs).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(rows) and {"plain", "psm", "spm"} == {r.form for r in made}
    for r in made:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "")


def test_clashing_columns_and_nothing(frame):
    schema = "n int, body string, digest int, units int, low int, high int, h1 int, form_ int, output int, doc_id long, text string, kept0 int"
    docs = frame(schema, (1, "b", 2, 3, 4, 5, 6, 7, 8, 11, "a few words of text", 9))
    (r,) = middle.fill_in_middle(docs).collect()
    assert (r.body, r.digest, r.units, r.low, r.high, r.h1, r.form_, r.kept0) == ("b", 2, 3, 4, 5, 6, 7, 9)
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(11, r.text)
    assert middle.fill_in_middle(docs.where("false")).collect() == []


def test_chunks_depend_on_content_only():
    r = random.Random(5)
    text = np.frombuffer(bytes(r.choice(b"abcdefgh ") for _ in range(300_000)), np.uint8)
    ends = middle.chunk_ends(text)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(text) and sizes[:-1].min() >= middle.LEAST and sizes.max() <= middle.MOST and 700 < sizes.mean() < 2000
    moved = np.concatenate([np.frombuffer(b"something before it ", np.uint8), text])
    later = {e - 20 for e in middle.chunk_ends(moved)}
    assert len(later & set(ends)) > 0.98 * len(ends)
    halves = middle.READ  # a text longer than what is hashed at a time has the same cuts
    long = np.tile(text, 5)
    assert len(long) > halves
    h = middle.rolled(long)
    hits = set((np.flatnonzero(h >> np.uint32(32 - middle.MEAN_BITS) == 0) + 1).tolist()) | {len(long)}
    assert set(middle.chunk_ends(long)) <= hits


def test_texts_that_end_where_a_chunk_would():
    r = random.Random(8)
    text = np.frombuffer(bytes(r.choice(b"abcdefgh ") for _ in range(50_000)), np.uint8)
    memo = middle.Memo()
    ends = middle.chunk_ends(text)
    assert len(ends) > 20
    for i, end in enumerate(ends):
        assert middle.chunk_ends(text[:end]) == ends[: i + 1]
        assert middle.Chunked(text[:end], memo).units == len(UNIT.findall(text[:end].tobytes().decode()))


def test_memo_reads_shared_chunks_once_and_is_bounded():
    r = random.Random(6)
    text = np.frombuffer(bytes(r.choice(b"abcdefgh ") for _ in range(100_000)), np.uint8)
    memo = middle.Memo()
    first = middle.Chunked(text, memo)
    made = memo.made
    assert middle.Chunked(text, memo).units == first.units and memo.made == made
    middle.Chunked(np.concatenate([np.frombuffer(b"new words here ", np.uint8), text]), memo)
    assert memo.made <= made + 3
    small = middle.Memo(most=10_000)
    assert middle.Chunked(text, small).units == first.units
    assert sum(map(len, small.young)) + sum(map(len, small.old)) <= 10_000 + middle.MOST


@pytest.mark.parametrize("seed", range(3))
def test_summaries_combine_in_any_grouping(seed):
    r = random.Random(seed)
    text = "".join(r.choice("ab \né") for _ in range(400))
    cuts = sorted(r.sample(range(1, 400), 9))
    parts = [middle.summary(text[a:b].encode()) for a, b in zip([0, *cuts], [*cuts, 400])]
    left = middle.EMPTY
    for p in parts:
        left = left + p
    right = middle.EMPTY
    for p in reversed(parts):
        right = p + right
    assert left == right == middle.summary(text.encode())
