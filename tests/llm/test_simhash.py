"""SimHash: fingerprints, links and components against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from areagrade.llm import simhash as op

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    words = WORD.findall((text or "").translate(ASCII))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components_of(prints, budget=3):
    """The least place linked to each place, by all pairs."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(prints))]


def clustered(seed, n=400):
    """Different numbers of which many differ in a few bits, some chained."""
    r = random.Random(seed)
    out = {0, 1, (1 << 64) - 1}
    while len(out) < n:
        base = r.choice(sorted(out)) if r.random() < 0.7 else r.getrandbits(64)
        for b in r.sample(range(64), r.randint(1, 4)):
            base ^= 1 << b
        out.add(base)
    return sorted(out)


def test_documents_equal_brute_force(spark, frame):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)] + ["É", "Ünder", "日本"]
    texts = [None, "", " \n", "one", "ONE", "two words", "three small words", "no\xa0break here now"]
    for _ in range(40):
        base = r.choices(words, k=r.choice([2, 3, 30, 300, 900]))
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            base[r.randrange(len(base))] = r.choice(words)
            texts.append("\t".join(base).upper())
    texts += ["very long " * 60_000]
    ids = r.sample(range(10_000), len(texts))
    rows = [(i, t) for i, t in zip(ids, texts)] + [(ids[8], texts[8]), (9_999_999, texts[9]), (None, texts[10]), (None, "alone without an id, far from any other text")]
    got = op.near_duplicates(frame("doc_id long, text string", *rows)).collect()
    assert len(got) == len(rows)
    prints = [print_of(t) for _, t in rows]
    label = components_of(prints)
    names = {}
    for (i, _), l in zip(rows, label):
        names[l] = min((x for x in (names.get(l), i) if x is not None), default=None)
    want = sorted(((i, t, f"{p:016x}", names[l]) for (i, t), p, l in zip(rows, prints, label)), key=repr)
    assert sorted(((x.doc_id, x.text, x.fingerprint, x.component_id) for x in got), key=repr) == want


def test_clashing_columns_and_nothing(spark, frame):
    docs = frame("doc_id int, text string, print int, id int, Fingerprint int, root int, body int, least int", (1, "a b c", 2, 3, 4, 5, 6, 7), (2, "a b c", 2, 3, 4, 5, 6, 7))
    got = op.near_duplicates(docs).collect()
    assert {(r.doc_id, r.component_id, r["print"], r.id, r.root, r.body, r.least) for r in got} == {(1, 1, 2, 3, 5, 6, 7), (2, 1, 2, 3, 5, 6, 7)}
    assert op.near_duplicates(docs.where("false")).collect() == []


@pytest.mark.parametrize("seed, unit", [(0, 1 << 16), (1, 2), (2, 12)])
def test_units_lose_no_link_of_crowded_prints(spark, frame, seed, unit):
    prints = clustered(seed)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    roots = op.near_prints(frame("print long", *signed), unit=unit).collect()
    root = {r.u: r.root for r in roots}
    label = components_of(prints)
    groups, want = {}, {}
    for (p,), l in zip(signed, label):
        groups.setdefault(root.get(p, p), set()).add(p)
        want.setdefault(l, set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_units_are_bounded(spark, frame):
    prints = [(int(np.uint64(p).view(np.int64)),) for p in clustered(4, 600)]
    units = op.trie_units(frame("print long", *prints), unit=20)
    sizes = units.groupBy("turn", "depth", "one", "two").agg(F.count("*").alias("n")).agg(F.max("n"), F.countDistinct("depth")).first()
    assert sizes[0] <= 20 and sizes[1] > 1


@pytest.mark.parametrize("budget", range(4))
def test_walk_equals_all_pairs(budget):
    keys = np.array(clustered(7, 800), dtype=np.uint64)
    tries = op.Tries(keys, np.array([0]), np.array([len(keys)]))
    root = np.array([0])
    assert op.linked(tries, root, root, budget).tolist() == components_of(keys.tolist(), budget)


def test_bit_sums_of_long_and_empty_ranges():
    r = np.random.default_rng(1)
    values = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    bounds = np.array([0, 0, 1, 256, 256, 2900, 3000, 3000])
    bits = (values[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    want = [bits[a:b].sum(0).tolist() for a, b in zip(bounds, bounds[1:])]
    assert op.bit_sums(values, bounds).tolist() == want
    assert op.bit_sums(values[:0], np.array([0, 0])).tolist() == [[0] * 64]
