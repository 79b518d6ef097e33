"""Line dedup, sharding and licence scans: plain DataFrame operators."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from areagrade.llm import licences
from areagrade.llm.licences import known_digests, scan_licences
from areagrade.llm.lines import LineRuns, dedup_lines
from areagrade.llm.shards import kd_shards

STRIP = " \t\n\x0b\x0c\r"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(STRIP).translate(ASCII)


def dedup_by_hand(texts, min_docs):
    split = [(t or "").split("\n") for t in texts]
    docs = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    kept = [[x for x in lines if docs[key(x)] < min_docs or not key(x)] for lines in split]
    return [("\n".join(k), len(s), len(s) - len(k)) for k, s in zip(kept, split)]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2)])
def test_line_dedup_equals_brute_force(frame, batches, fanout):
    pick = random.Random(7)
    pool = ["Common", " common\t", "COMMON", "é", "É", "once", "", "  ", "a\x0bb", "x" * 3000, " nbsp", "tab\t"]
    texts = ["\n".join(pick.choice(pool) + pick.choice(["", "", str(i % 7)]) for _ in range(pick.randint(1, 6))) for i in range(60)]
    texts += [None, "", "\n\n", texts[0], texts[0], "Common\n" * 5000]
    df = frame("doc_id int, text string, n_lines string", *((i % 50 if i % 9 else None, t, "old") for i, t in enumerate(texts)))
    got = sorted((r.kept_text, r.n_lines, r.n_dropped) for r in dedup_lines(df, min_docs=4, batches=batches, fanout=fanout).collect())
    assert got == sorted(dedup_by_hand(texts, 4))


def test_line_dedup_of_nothing(frame):
    df = frame("doc_id int, text string")
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "kept_text", "n_lines", "n_dropped"]
    assert out.collect() == []


def test_runs_settle_and_are_dropped(spark, frame):
    before = len(spark.catalog.listTables())
    runs = LineRuns(spark, min_docs=3, fanout=2, buckets=2)
    for _ in range(5):
        runs.add(frame("h1 long, h2 long, docs long", (1, 1, 1), (2, 2, 3)))
    assert runs.settled and len(runs.levels) > 1
    assert sorted(tuple(r) for r in runs.common().collect()) == [(1, 1), (2, 2)]
    runs.close()
    assert len(spark.catalog.listTables()) == before


def test_line_dedup_runs_no_python(frame):
    plan = dedup_lines(frame("doc_id int, text string", (1, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def placed(frame, sizes, shards, **options):
    df = frame("doc_id int, n long, g long, shard string", *((i, n, g, "old") for i, (n, g) in enumerate(sizes)))
    out = kd_shards(df, F.col("n"), [F.col("n"), F.col("g")], [F.col("g"), F.col("doc_id")], shards, **options)
    return out.collect()


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_gapless(frame, shards):
    pick = random.Random(3)
    rows = placed(frame, [(pick.randint(8, 300), i % 40) for i in range(600)], shards)
    assert sorted(r.doc_id for r in rows) == list(range(600))
    by_shard = {s: [r for r in rows if r.shard == s] for s in range(shards)}
    weights = [sum(r.size for r in by_shard[s]) for s in by_shard]
    assert max(weights) - min(weights) < 0.1 * sum(weights) / shards
    assert all(sorted(r.slot for r in by_shard[s]) == list(range(len(by_shard[s]))) for s in by_shard)


def split_by_hand(rows, shards):
    """Shard of each (id, n, g): nodes are split at the row nearest to the wanted weight, the first of two."""
    ends = lambda part, i: (min(r[i] for r in part), max(r[i] for r in part))
    spans = [(ends(rows, i)[1] - ends(rows, i)[0]) or 1 for i in (1, 2)]

    def leaves(part, n):
        if n == 1 or not part:
            return [part] + [[]] * (n - 1)
        widths = [(ends(part, i)[1] - ends(part, i)[0]) / span for i, span in zip((1, 2), spans)]
        axis = 1 if widths[0] >= widths[1] else 2
        part = sorted(part, key=lambda r: (r[axis], r[2], r[0]))
        want, below = sum(r[1] for r in part) * (n // 2) // n, 0
        for at, row in enumerate(part):
            if below + row[1] >= want:
                break
            below += row[1]
        cut = at if want - below <= below + row[1] - want else at + 1
        return leaves(part[:cut], n // 2) + leaves(part[cut:], n - n // 2)

    return {r[0]: shard for shard, leaf in enumerate(leaves(rows, shards)) for r in leaf}


@pytest.mark.parametrize("shards, hot", [(2, 0), (5, 0), (8, 0.4), (11, 0)])
def test_shards_equal_a_plain_tree(frame, shards, hot):
    pick = random.Random(shards)
    rows = [(i, 50 if pick.random() < hot else pick.randint(8, 3000), pick.randint(-40, 40)) for i in range(300)]
    got = {r.doc_id: r.shard for r in placed(frame, [(n, g) for _, n, g in rows], shards, tolerance=0.0)}
    assert got == split_by_hand(rows, shards)


def test_shards_of_one_hot_value_are_even(frame):
    rows = placed(frame, [(10, 5)] * 400 + [(11, i) for i in range(100)], 5)
    weights = Counter()
    for r in rows:
        weights[r.shard] += r.size
    assert len(weights) == 5 and max(weights.values()) < 1.1 * min(weights.values())


def test_shards_keep_light_groups_together(frame):
    rows = placed(frame, [(50, i // 2) for i in range(1000)], 4)
    shard_of = {}
    for r in rows:
        shard_of.setdefault(r.g, set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())


def test_shards_of_nulls_repeats_and_nothing(frame):
    df = frame("doc_id int, n long", (None, None), (None, None), (1, 5), (1, 5), (2, None))
    out = kd_shards(df, F.coalesce("n", F.lit(0)) + 8, [F.col("n")], [F.col("doc_id")], 3).collect()
    assert len(out) == 5 and all(0 <= r.shard < 3 for r in out)
    assert {r.size for r in out} == {8, 13}
    empty = kd_shards(frame("doc_id int, n long"), F.col("n"), [F.col("n")], [F.col("doc_id")], 3)
    assert empty.columns == ["doc_id", "n", "size", "shard", "slot"] and empty.collect() == []


MIT_LINE = "released UNDER the mit licence"


def test_licences_by_canonical_text(spark, frame):
    from areagrade.llm.licence_texts import KNOWN

    changed = KNOWN["MIT"].upper().replace("LICENSE", "LICENCE").replace(",", " ;").replace("\n", "\r\n")
    whole = "Copyright (c) 2024 Somebody <a@b.c>\nAll rights reserved.\n\n" + changed
    texts = [whole, f"prose\n** {MIT_LINE}! **\nmore", "prose " + MIT_LINE, None, "", KNOWN["ISC"], KNOWN["ISC"], "x" * 200_000]
    df = frame("doc_id int, text string, digest int", *((None if i == 1 else i, t, 9) for i, t in enumerate(texts)))
    out = {r.text if r.doc_id is None else r.doc_id: r for r in scan_licences(df, known_digests(spark)).collect()}
    assert len(out) == len(texts)
    assert out[0].licences == ["MIT"] and out[5].licences == out[6].licences == ["ISC"]
    assert out[texts[1]].notices == ["MIT"] and out[texts[1]].licences == []
    assert out[2].notices == [] and out[2].licences == []
    assert out[3].digest == out[4].digest == hashlib.sha256(b"").hexdigest()
    assert scan_licences(frame("text string"), known_digests(spark)).collect() == []


def test_entire_licences_are_known(spark, frame):
    from areagrade.llm.licences import known_texts

    entire = {name.split("#")[0]: text for name, text in known_texts().items() if name.endswith("#entire")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Artistic-1.0-Perl", "BSD-3-Clause"} <= set(entire)
    texts = [*entire.items(), *((name, " ".join(entire[name].upper().split())) for name in ("MPL-2.0",))]
    texts.append(("Apache-2.0", entire["Apache-2.0"].partition("APPENDIX:")[0]))
    df = frame("name string, text string", *texts, (None, entire["GPL-3.0"][:9000]))
    got = scan_licences(df, known_digests(spark)).collect()
    assert len(got) == len(texts) + 1 and [(r.name, r.licences) for r in got if r.licences != ([r.name] if r.name else [])] == []


def test_copyright_lines_of_any_form_are_dropped(spark, frame):
    from areagrade.llm.licence_texts import KNOWN

    lines = ["(c) 2020 Name", "Copyright Name Inc.", "Portions Copyright (c) 2020 X", "\xa9 Name", "Copyright (C) 2001-2004 A, B", "c 2020 Name", "(c) Name"]
    lines += ["# Copyright: The Name Authors", "Copyright [yyyy] [name]", "Some portions copyright Somebody", "COPYRIGHT 2020 NAME", "(c) Copyright Name", "(c) Name Ltd."]
    texts = [(name, f"{line}\n\n{KNOWN[name]}") for line in lines for name in ("MIT", "BSD-3-Clause")]
    texts += [(name, KNOWN[name].replace(" copyright", "\n copyright").replace(" COPYRIGHT", "\n COPYRIGHT")) for name in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC")]
    got = scan_licences(frame("name string, text string", *texts), known_digests(spark)).collect()
    assert [(r.name, r.text) for r in got if r.licences != [r.name]] == []
    kept = ["CC BY 4.0", "CC BY-NC 4.0", "c by itself", "(b) x\n(c) You must retain the notices"]
    nothing = hashlib.sha256(b"").hexdigest()
    assert all(r.digest != nothing for r in scan_licences(frame("text string", *((k,) for k in kept)), known_digests(spark)).collect())
    items = scan_licences(frame("text string", (kept[-1],), (kept[-1].replace("\n", " "),)), known_digests(spark)).collect()
    assert items[0].digest == items[1].digest
    cc = known_digests(spark, {"CC-BY-4.0": "CC BY 4.0"})
    assert scan_licences(frame("text string", ("prose\nCC BY 4.0\nmore",)), cc).first().notices == ["CC-BY-4.0"]


def test_known_licences_are_told_apart(spark):
    rows = known_digests(spark).collect()
    assert len({r.digest for r in rows}) == len(rows)


def test_spellings_are_looked_for_wherever_they_can_be(one):
    texts = ["Sub-Licensed under https://x", "the judgement, a favour; non-exclusive", "fulfill 5 per cent (wilful)", "copyright owners", "nothing", "merchantibility organises"]

    def every(text):
        out = F.translate(F.coalesce(text, F.lit("")), licences.UPPER + "\r", licences.LOWER + "\n")
        out = F.regexp_replace(F.regexp_replace(out, licences.COPYRIGHT_LINE, "\n"), licences.RIGHTS_LINE, "\n")
        out = F.regexp_replace(out, r"[\x01-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+", " ")
        for pattern, form in licences.SPELLINGS:
            out = F.regexp_replace(out, pattern, form.replace("\\", "$"))
        return out

    texts += list(licences.known_texts().values()) + ["\n".join(["(C) 2020 X", "C 2019 by me", "vitamin c 2001", "_c 2001 x", "\xe9c 2002", "ALL RIGHTS RESERVED."])]
    assert one(texts, licences.canonical) == one(texts, every)


def test_licence_scan_of_clashing_columns(spark, frame):
    docs = frame("_text_id int, text string, text_id int, lines int, unit int, Digest int", (1, "MIT", 2, 3, 4, 5))
    (r,) = licences.scan_licences(docs, licences.known_digests(spark)).collect()
    assert (r._text_id, r.text_id, r.lines, r.unit) == (1, 2, 3, 4) and len(r.digest) == 64
