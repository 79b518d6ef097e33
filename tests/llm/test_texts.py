"""Near copies, decontamination, BPE: against brute force and the library itself."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from areagrade.llm import bpe, leaks, near, wordhash
from areagrade.llm.graph import components
from areagrade.llm.wordhash import NO_WORD, word_slices
from areagrade.llm.workers import BATCH, importable

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "un", "vo", "es", "pri") for b in ("n", "da", "sch", "rel", "tu", "x")]


def prose(pick, n):
    return " ".join(pick.choice(WORDS) for _ in range(n))


def grams(text, n=5):
    words = (text or "").lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def edited(pick, text, changes):
    words = text.split()
    for _ in range(changes):
        words[pick.randrange(len(words))] = "changed" + str(pick.randint(0, 99))
    return " ".join(words)


def test_workers_need_little_room_for_many_texts():
    pick = random.Random(5)
    texts = pa.array([prose(pick, 400) for _ in range(2500)])
    for work in (lambda: near._signed(texts, 5, 18, 5), lambda: [w.ngrams(3)[0].sum() for w in word_slices(texts, NO_WORD)]):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 20 << 20
    long = [w.hash.tolist() for w in word_slices(pa.array(["ab " * 1_000_000, "ab"]))]
    assert set(long[0]) == set(long[1]) and len(long[0]) == 1_000_000
    assert all(row.nbytes < 9 << 20 for row in wordhash._powers.values())


def test_batches_of_texts_are_small(spark):
    rows = spark.range(0, 600, 1, 1).selectExpr("repeat(cast(id % 10 as string), 20000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["size", "n"])

    before = spark.conf.get(BATCH, None)
    spark.conf.unset(BATCH)
    try:
        importable(spark)
        found = rows.mapInArrow(sizes, "size long, n long").collect()
    finally:
        spark.conf.set(BATCH, before) if before else spark.conf.unset(BATCH)
    assert sum(r["n"] for r in found) == 600 and max(r["size"] for r in found) < 3 << 20


def test_word_hashes_follow_words_only():
    texts = ["Ab  cd", "ab\tCD\n", None, "", "é É", "ab cd ab", "x" * 3_000_000 + " ab"]
    hashes = []
    for w in word_slices(pa.array(texts)):
        hashes += [w.hash[a:b].tolist() for a, b in zip(w.offset[:-1], w.offset[1:])]
    assert hashes[0] == hashes[1] and hashes[2] == hashes[3] == []
    assert hashes[4][0] != hashes[4][1] and hashes[5][0] == hashes[5][2] == hashes[6][1]


def test_band_plan_reaches_its_recall():
    bands, rows = near.band_plan(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 128


def test_components_of_a_chain_and_stars(frame):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.u: r.root for r in components(frame("u int, v int", *pairs)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}


@pytest.fixture(scope="module")
def near_texts():
    pick = random.Random(11)
    base = [prose(pick, pick.randint(3, 80)) for _ in range(25)]
    texts = list(base)
    for b in base:
        texts += [b, b.upper().replace(" ", "  ")] + [edited(pick, b, c) for c in (1, 1, 2, 4)]
    return texts + [None, "", " \n", "one", "ONE", prose(pick, 3000), "same"]


def near_by_hand(texts):
    sets = [grams(t) for t in texts]
    root = list(range(len(texts)))
    links = [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in range(len(texts))}


@pytest.mark.parametrize("block", [near.BLOCK, 7])
def test_near_classes_equal_brute_force(frame, near_texts, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    df = frame("doc_id int, text string, digest int", *((i, t, 0) for i, t in enumerate(near_texts)))
    got = {r._id: (r.class_id, r.n_links) for r in near.near_classes(df).collect()}
    assert got == near_by_hand(near_texts)


def test_one_of_each_class_stays(frame):
    text = " ".join(WORDS[:20])
    rows = [(5, text), (3, text + " more"), (3, text + " more"), (None, text), (7, None), (None, ""), (8, "other words here")]
    kept = near.drop_near_copies(frame("doc_id int, text string, u int", *((*r, 1) for r in rows)))
    assert kept.columns == ["doc_id", "text", "u"]
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted([rows[1], rows[4], rows[5], rows[6]], key=repr)
    assert near.near_classes(frame("doc_id int, text string")).collect() == []


def align_by_hand(item, words):
    best, table = 0, [[0] * (len(words) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if a == b else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_equals_the_plain_table():
    pick = random.Random(5)
    for _ in range(60):
        item, words = (np.array([pick.randint(0, 6) for _ in range(pick.randint(1, 15))], dtype=np.uint64) for _ in range(2))
        score, matches, first, end = leaks.align(item, words)
        assert score == align_by_hand(item.tolist(), words.tolist())
        assert matches <= end - first <= len(words)


def test_leaks_are_found_and_clean_texts_left_alone(frame):
    pick = random.Random(2)
    items = [prose(pick, 40) for _ in range(6)] + [None, "", prose(pick, 2)]
    clean = [prose(pick, 120) for _ in range(30)]
    leaked = {}
    for i in range(6):
        before, after = prose(pick, 60), prose(pick, 60)
        leaked[100 + i] = (i, f"{before} {items[i].upper()}. {after}")
        leaked[200 + i] = (i, f"{before} {edited(pick, items[i], 5)} {after}")
        words = items[i].split()
        leaked[300 + i] = (i, f"{before}\n{' '.join(words[:18] + ['so', 'to', 'speak'] + words[20:])}, {after}")
    rows = [(i, t, 0) for i, t in enumerate(clean)] + [(i, t, 0) for i, (_, t) in leaked.items()] + [(900, None, 0), (901, "", 0)]
    rows += [(100, leaked[100][1], 1), (None, leaked[101][1], 1), (902, " ".join(clean) + " " + items[3], 0)]
    docs = frame("doc_id int, text string, score int", *rows)
    bench = frame("item_id int, text string, doc_id int", *((i, t, 0) for i, t in enumerate(items)), (77, items[0], 0))
    found = leaks.find_leaks(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    want = {(d, i) for d, (i, _) in leaked.items()} | {(d, 77) for d, (i, _) in leaked.items() if i == 0} | {(None, 1), (902, 3)}
    assert pairs == want
    assert sum(r.doc_id == 100 and r.item_id == 0 for r in found) == 2
    assert all(r.score == 1 for r in found if r.doc_id in range(100, 106))
    left = leaks.drop_leaks(docs, bench)
    assert left.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id for r in left.collect()) == [*range(30), 900, 901]
    assert leaks.find_leaks(docs.limit(0), bench).collect() == [] and leaks.find_leaks(docs, bench.limit(0)).collect() == []


@pytest.mark.parametrize("every", [4, 5])
def test_leaks_with_every_nth_word_replaced_are_found(frame, every):
    pick = random.Random(every)
    items = [prose(pick, n) for n in (15, 25, 37) for _ in range(4)]
    rows = [(i, prose(pick, 120)) for i in range(100, 120)]
    for i, item in enumerate(items):
        words = [f"other{i}x{j}" if j % every == every - 1 else w for j, w in enumerate(item.split())]
        rows.append((i, f"{prose(pick, 40)} {' '.join(words)} {prose(pick, 40)}"))
    found = leaks.find_leaks(frame("doc_id int, text string", *rows), frame("item_id int, text string", *enumerate(items))).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(len(items))]


PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def odd_texts():
    pick = random.Random(1)
    parts = ["a", "the", " ", "\n", "  ", "é", "12", "!", "'s", "'", "re", "<|endoftext|>", "abcab", "x" * 37, "\t", "日本", "$$$", "\U0001f469‍"]
    texts = ["".join(pick.choice(parts) * pick.choice([1, 1, 2, 40]) for _ in range(pick.randint(0, 80))) for _ in range(150)]
    return texts + [None, "", "a" * 9000, "xyab" * 3000, " " * 3000 + "b", "thequick" * 700, "ab " * 9000, "\x00\x01", texts[3]]


@pytest.mark.parametrize("piece_chars, unit_bytes", [(1 << 15, 1 << 12), (40, 64)])
def test_bpe_equals_the_library_and_decodes(frame, odd_texts, piece_chars, unit_bytes):
    library = Tokenizer.from_file(PATH)
    df = frame("doc_id int, text string, ids int", *((i if i % 7 else None, t, 1) for i, t in enumerate(odd_texts)))
    coded = bpe.encode_texts(df, PATH, piece_chars=piece_chars, unit_bytes=unit_bytes)
    rows = bpe.decode_ids(coded, PATH).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_texts(df.limit(0), PATH).collect() == []


def test_joins_grow_until_both_sides_agree():
    v = bpe.vocabulary_of(PATH)
    pick = random.Random(4)
    for unit in [b"a" * 4001, b"xyab" * 900, bytes(pick.choice(b"etaoinsh") for _ in range(5000))]:
        parts = [v.encode_unit(p) for p in bpe.halves(unit, 100)]
        assert len(parts) > 16 and bpe.joined_parts(parts, v) == v.encode_unit(unit)


def test_unknown_bytes_decode_with_replacement(frame):
    v = bpe.vocabulary_of(PATH)
    half = np.array(v.encode_unit("é".encode()[:1]), "<u4").tobytes()
    out = bpe.decode_ids(frame("ids binary", (half,), (None,), (b"",)), PATH).collect()
    assert sorted((r.decoded for r in out), key=repr) == sorted(["�", None, ""], key=repr)
