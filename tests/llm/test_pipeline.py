"""The stages of the pipeline against brute force, and on odd rows."""

import random
import re
import sys
from collections import Counter
from pathlib import Path

import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline  # noqa: E402
from areagrade.llm import bpe, toxicity  # noqa: E402

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "un", "vo", "es", "pri") for b in ("n", "da", "sch", "rel", "tu", "x")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_dropped int, _t1 int"


def prose(pick, n):
    return " ".join(pick.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    pick = random.Random(21)
    items = [prose(pick, 30) for _ in range(4)]
    rows, toxic = [], {}
    for i in range(160):
        text = prose(pick, pick.randint(20, 60))
        if i % 5 == 0:
            words = text.split()
            for k in range(3):
                words[pick.randrange(len(words))] = pick.choice(["idiot", "moron", "1d10t", "scum"])
            text = " ".join(words)
        if i % 7 == 0:
            text += "\nShared line of the site. \n"
        if i % 40 == 3:
            text += " " + items[i // 40]
        toxic[i] = int(i % 5 == 0)
        rows.append((i, text))
    rows += [(200 + i, rows[11 + i][1] + " tail") for i in range(5)] + [(300, rows[1][1]), (1, rows[1][1]), (None, rows[2][1])]
    rows += [(400, None), (401, ""), (402, "SHARED line of the site."), (403, "x" * 50_000), (404, prose(pick, 9000))]
    folder = tmp_path_factory.mktemp("tables")
    full = [(i, t, None if k % 3 else "en", None, None if t is None else len(t), "s", k, k) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, y) for i, y in toxic.items()] + [(None, 1, 1), (7, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), items


def key(row):
    return tuple(repr(x) for x in row)


def test_stages_equal_brute_force(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen[name] = (docs.collect(), out.collect())
        if name != "bpe":
            assert out.columns == columns
            path = f"{folder}/{name}.parquet"
            out.write.parquet(path)
            docs = spark.read.parquet(path)

    before, after = seen["toxicity"]
    scores = toxicity.score(spark.createDataFrame(before, SCHEMA).select("doc_id", "text"), toxicity.trained(spark, folder, spark.createDataFrame(before, SCHEMA))).collect()
    assert sorted(key((r.doc_id, r.text)) for r in scores if r.score < 0.5) == sorted(key((r.doc_id, r.text)) for r in after)
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {i for i in range(0, 160, 5)} | {204}  # 204 is a copy of 15

    before, after = seen["line_dedup"]
    norm = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(ASCII)
    docs_of = Counter(k for r in before for k in {norm(x) for x in (r.text or "").split("\n")} if k)
    want = []
    for r in before:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if docs_of[norm(x)] < 10]
        changed = len(kept) < len(lines)
        text = "\n".join(kept) if changed else r.text
        want.append((r.doc_id, text, r.lang, r.source, len(text) if changed else r.n_chars, r.score, r.n_dropped, r._t1))
    assert max(docs_of.values()) >= 10 and sorted(map(key, want)) == sorted(map(key, after))

    before, after = seen["near_copies"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r.text or "").translate(ASCII).split()) else set() for r in before]
    root = list(range(len(before)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    classes = {}
    for i, r in enumerate(before):
        if sets[i]:
            classes.setdefault(root[i], []).append(r)
    want = [min((r.doc_id is None, r.doc_id or 0) for r in c) for c in classes.values()] + [(r.doc_id is None, r.doc_id or 0) for r, s in zip(before, sets) if not s]
    assert len(classes) < len(before) and sorted(want) == sorted((r.doc_id is None, r.doc_id or 0) for r in after)
    assert set(map(key, after)) <= set(map(key, before))

    before, after = seen["decontamination"]
    joined = [" ".join(re.findall(r"\w+", x)) for x in items]
    want = [r for r in before if not any(x in " ".join(re.findall(r"\w+", r.text or "")) for x in joined)]
    assert len(want) < len(before) and sorted(map(key, want)) == sorted(map(key, after))

    before, after = seen["bpe"]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    n_tokens = sorted((repr(r.doc_id), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in before)
    assert sorted((repr(r.doc_id), r.n_tokens) for r in after) == n_tokens


def test_stages_on_an_empty_table(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == [], name
