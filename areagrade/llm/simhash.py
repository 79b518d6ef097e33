"""SimHash near-duplicates: fingerprints, joined with themselves by walking a binary trie in pairs.

Two nodes of a trie are visited together. Their fixed bits differ in some number of places; beyond
the error budget nothing below them can link, so the pair is left. Otherwise the wider node is
replaced by its two children. A node and itself become its children with themselves and with each
other. Two single fingerprints that stay within the budget are a link.

To spread this over tasks, a fingerprint is dealt under four rotations by its first 16 bits: two
that differ in at most three bits agree on one of the four quarters, so the topmost levels of each
rotated trie are walked without any error, and a task holds whole subtries. A subtrie that is too
large for a task is walked in Spark first, four levels a step, as a table of node pairs with their
counts, until each pair that is left is small enough; each such pair is then a unit of its own.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from areagrade.llm.columns import Apart
from areagrade.llm.graph import components
from areagrade.llm.wordhash import _LOWER, Words, word_slices
from areagrade.llm.workers import importable
from areagrade.session import materialise

SHINGLE = 3
SEED = 42
BUDGET = 3
TURNS, ROOT = 4, 16  # rotations, and the bits of one that agree
STEP = 4  # levels of a large subtrie that Spark walks at a time
UNIT = 1 << 16  # fingerprints of a unit
PAIRS = 1 << 18  # node pairs visited at a time
READ_ROWS = 1 << 17
ADDED = ("fingerprint", "component_id")

_LANES = np.uint64(0x0101010101010101)


def bit_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of the values of each range have each of the 64 bits, the lowest first.

    Eight counters of a byte are added at once, so ranges are cut into runs of at most 255.
    """
    length = np.diff(bounds)
    runs = -(-length // 255)
    of = np.repeat(np.arange(len(length)), runs)
    first = np.concatenate([[0], np.cumsum(runs)])
    start = bounds[:-1][of] + 255 * (np.arange(len(of)) - first[of])
    out = np.zeros((len(length), 64), dtype=np.int64)
    if not len(of):
        return out
    filled = np.flatnonzero(length)
    for bit in range(8):
        lanes = np.add.reduceat((values >> np.uint64(bit)) & _LANES, start)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[filled, bit::8] = np.add.reduceat(counts, first[:-1][filled], axis=0)
    return out


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of the texts of a slice, and the bounds of each text's.

    A shingle is ``size`` lower-cased words with one blank between; of fewer words, all of them.
    """
    import xxhash

    length = words.end - words.start
    place = np.concatenate([[0], np.cumsum(length + 1)])
    line = np.full(place[-1], 32, dtype=np.uint8)
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    line[np.repeat(place[:-1], length) + inside] = _LOWER[words.data[np.repeat(words.start, length) + inside]]
    line = line.tobytes()
    n = np.where(words.count > 0, np.maximum(words.count - size + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    first = words.offset[:-1][text] + np.arange(bounds[-1]) - bounds[:-1][text]
    last = np.minimum(first + size, words.offset[1:][text]) - 1
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    starts, ends = place[first].tolist(), (place[last] + length[last]).tolist() if len(last) else []
    return np.array([hashed(line[a:b]) for a, b in zip(starts, ends)], dtype=np.uint64), bounds


def fingerprints(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without ``text`` and with ``print``: a bit is set if more than half of the shingles' hashes have it."""
    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for words in word_slices(batch.column(at)):
                values, bounds = shingle_hashes(words)
                most = bit_sums(values, bounds) * 2 > np.diff(bounds)[:, None]
                found.append(np.packbits(most, axis=1, bitorder="little").view("<u8").ravel())
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            prints = pa.array(np.concatenate(found).astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*kept, prints], names=[*names, "print"])

    return rows.mapInArrow(run, StructType([*(f for f in rows.schema.fields if f.name != text), StructField("print", LongType())]))


class Tries:
    """The compressed binary tries of ranges of keys, each sorted and without repetition.

    A node has a key below it, its width (the bits its keys do not all share, counted from the
    lowest) and its range; one of two children or more has ``left`` and ``right``.
    """

    def __init__(self, keys: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.keys = keys
        lows, highs, widths, lefts, made = [low], [high], [], [], len(low)
        while len(low):
            apart = keys[low] ^ keys[high - 1]
            for s in (1, 2, 4, 8, 16, 32):
                apart |= apart >> np.uint64(s)
            width = np.bitwise_count(apart).astype(np.int64)
            inner = np.flatnonzero(width)
            left = np.full(len(low), -1)
            left[inner] = made + 2 * np.arange(len(inner))
            widths.append(width)
            lefts.append(left)
            a, b = low[inner], high[inner]
            bit = np.uint64(1) << (width[inner] - 1).astype(np.uint64)
            one, end = a.copy(), b - 1  # the first key with the bit lies behind one, up to end
            while (open_ := end - one > 1).any():
                middle = (one + end) // 2
                has = keys[middle] & bit > 0
                end = np.where(open_ & has, middle, end)
                one = np.where(open_ & ~has, middle, one)
            low, high = np.stack([a, end], axis=1).ravel(), np.stack([end, b], axis=1).ravel()
            lows.append(low)
            highs.append(high)
            made += len(low)
        self.low, self.high, self.left = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lows, highs, lefts))
        self.width = np.concatenate(widths) if widths else np.zeros(0, np.int64)
        self.key = keys[self.low]


def linked(tries: Tries, u: np.ndarray, v: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """The least key, by place, of each key's component of links, walking from the node pairs (u, v).

    Pairs whose keys are all in one component already can add nothing and are left. At most PAIRS
    pairs are looked at together, the deepest first, so few are waiting.
    """
    label = np.arange(len(tries.keys))
    changes = np.arange(len(label))  # places up to here where the label differs from the one before
    waiting = [(u, v)]
    while waiting:
        u, v = waiting.pop()
        if len(u) > PAIRS:
            waiting += [(u[PAIRS:], v[PAIRS:])]
            u, v = u[:PAIRS], v[:PAIRS]
        width = np.maximum(tries.width[u], tries.width[v])
        errors = np.bitwise_count((tries.key[u] ^ tries.key[v]) >> np.minimum(width, 63).astype(np.uint64))
        whole = (changes[tries.high[u] - 1] == changes[tries.low[u]]) & (changes[tries.high[v] - 1] == changes[tries.low[v]])
        done = whole & (label[tries.low[u]] == label[tries.low[v]])
        open_ = ~done & ((errors <= budget) | (u == v))
        u, v, width = u[open_], v[open_], width[open_]
        met = width == 0
        if met.any():
            label = united(label, tries.low[u[met]], tries.low[v[met]])
            changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        same = ~met & (u == v)
        other = ~met & ~same
        a, b = u[other], v[other]
        wider = tries.width[a] >= tries.width[b]
        split, rest = np.where(wider, a, b), np.where(wider, b, a)
        own = tries.left[u[same]]
        for pair in ((own, own + 1), (tries.left[split], rest), (tries.left[split] + 1, rest), (own, own), (own + 1, own + 1)):
            if len(pair[0]):
                waiting.append(pair)
    return label


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking the places a and b; each label is the least place of its component."""
    label = label.copy()
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        while (label != (label := label[label])).any():
            pass


def _turned(value: Column, turn: Column | int) -> Column:
    """64 bits rotated to the left by ``turn`` quarters."""
    by = turn * ROOT
    return F.call_function("shiftleft", value, by).bitwiseOR(F.call_function("shiftrightunsigned", value, 64 - by))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth)


def trie_units(prints: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """(turn, depth, one, two, side, key): the fingerprints of each pair of nodes that is walked as one.

    ``one`` and ``two`` are the nodes' prefixes of ``depth`` bits and may be the same; ``side`` 1 is the
    second one's. No unit has more than ``unit`` fingerprints, but for the two of a pair of leaves.
    """
    turn = F.explode(F.array(*(F.lit(t) for t in range(TURNS)))).alias("turn")
    turned = prints.select("print", turn).select("turn", _turned(F.col("print"), F.col("turn")).alias("key"))
    roots = turned.withColumn("root", _prefix(ROOT))
    sizes = roots.groupBy("turn", "root").agg(F.count("*").alias("n"))
    large = materialise(sizes.where(F.col("n") > unit).select("turn", "root"))
    first = F.lit(ROOT).alias("depth")
    shape = ("turn", "depth", "one", "two", "side", "key")
    if large.isEmpty():
        return roots.select("turn", first, F.col("root").alias("one"), F.col("root").alias("two"), F.lit(0).alias("side"), "key")
    small = roots.join(large, ["turn", "root"], "left_anti")
    small = small.select("turn", first, F.col("root").alias("one"), F.col("root").alias("two"), F.lit(0).alias("side"), "key")
    inside = materialise(roots.join(large, ["turn", "root"], "left_semi"))
    pairs, depth = large.select("turn", F.col("root").alias("one"), F.col("root").alias("two")), ROOT
    while not pairs.isEmpty():
        depth += STEP
        nodes = inside.groupBy("turn", _prefix(depth).alias("node")).agg(F.count("*").alias("n"))
        a, b = (nodes.select("turn", F.shiftrightunsigned("node", STEP).alias(up), F.col("node").alias(f"{up}_"), F.col("n").alias(f"n_{up}")) for up in ("one", "two"))
        met = pairs.join(a, ["turn", "one"]).join(b, ["turn", "two"])
        ordered = (F.col("one") != F.col("two")) | (F.col("one_") <= F.col("two_"))
        met = met.where(ordered & (F.bit_count(F.col("one_").bitwiseXOR(F.col("two_"))) <= budget))
        alone = F.col("one_") == F.col("two_")
        met = met.where(~alone | (F.col("n_one") > 1))  # one fingerprint has no pair with itself
        n = F.when(alone, F.col("n_one")).otherwise(F.col("n_one") + F.col("n_two"))
        met = materialise(met.select("turn", F.col("one_").alias("one"), F.col("two_").alias("two"), n.alias("n")))
        fit = (F.col("n") <= unit) | F.lit(depth >= 64)
        sides = F.when(F.col("one") == F.col("two"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
        units = met.where(fit).select("turn", "one", "two", F.explode(sides).alias("side"))
        units = units.withColumn("node", F.when(F.col("side") == 0, F.col("one")).otherwise(F.col("two")))
        rows = inside.withColumn("node", _prefix(depth)).join(units, ["turn", "node"]).withColumn("depth", F.lit(depth))
        small = small.unionByName(rows.select(*shape))
        pairs = met.where(~fit).select("turn", "one", "two")
    return small


def walked(units: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(u, v): fingerprints, each with the least one of its component in a unit; no link of a unit is lost.

    Units meet in their order in a partition; a task holds READ_ROWS rows and one unit at a time.
    """

    def edges(turn, depth, one, two, side, key):
        new_unit = np.ones(len(key), dtype=bool)
        new_unit[1:] = (turn[1:] != turn[:-1]) | (depth[1:] != depth[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        new = new_unit.copy()
        new[1:] |= side[1:] != side[:-1]
        low = np.flatnonzero(new)
        tries = Tries(key, low, np.append(low[1:], len(key)))
        begins = new_unit[low]
        u = np.flatnonzero(begins)
        last = np.append(u[1:], len(low)) - 1  # its second side, or itself
        label = linked(tries, u, last, budget)
        at = np.flatnonzero(label != np.arange(len(label)))
        by = (turn * ROOT).astype(np.uint64)
        back = (key >> by) | (key << ((np.uint64(64) - by) % np.uint64(64)))
        back = np.where(by == 0, key, back)
        return pa.RecordBatch.from_arrays([pa.array(back[i].view(np.int64)) for i in (at, label[at])], names=["u", "v"])

    def run(batches):
        held, size = None, 0
        waiting = []
        for batch in batches:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
            if size < READ_ROWS:
                continue
            held = [np.concatenate(x) for x in zip(*waiting)]
            # All but the last unit, which may go on.
            same = np.ones(len(held[0]), dtype=bool)
            for column in held[:4]:
                same &= column == column[-1]
            cut = int(np.argmax(same)) if same.any() else 0
            if cut:
                yield edges(*(c[:cut] for c in held[:5]), held[5][:cut].view(np.uint64))
            waiting = [[c[cut:] for c in held]]
            size = len(waiting[0][0])
        if waiting:
            held = [np.concatenate(x) for x in zip(*waiting)]
            if len(held[0]):
                yield edges(*held[:5], held[5].view(np.uint64))

    unit = ("turn", "depth", "one", "two")
    # Keys in the order of numbers without a sign.
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))
    dealt = units.repartition(*unit).withColumn("order", unsigned).sortWithinPartitions(*unit, "side", "order").drop("order")
    return dealt.mapInArrow(run, "u long, v long")


def near_prints(prints: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """(u, root) of each of the different fingerprints ``print`` that is linked to others, but the roots."""
    if not 0 <= budget < TURNS:
        raise ValueError(f"{TURNS} rotations find at most {TURNS - 1} errors")
    return components(walked(trie_units(prints, budget, unit), budget))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kept: list[str] | None = None, unit: int = UNIT) -> DataFrame:
    """The ``kept`` columns (default: all) with ``fingerprint`` and ``component_id`` of each row.

    Fingerprints link at BUDGET or fewer differing bits; ``component_id`` is the least id that links
    lead to from the row. Texts without words, null ones too, have fingerprint zero and link like
    any other. Rows with equal ids or texts count each; null ids take part, but give no name unless
    nothing else does (then null). An empty table gives no rows. Columns of the two names are replaced.

    Texts are read once and not shuffled; copies are one fingerprint from there on.
    """
    importable(docs.sparkSession)
    apart = Apart(docs, ADDED)
    wanted = {k: c for k, c in apart.kept.items() if kept is None or c in kept}
    rows = apart.rows.select(*wanted, F.col(apart.of(doc_id)).alias("id"), F.col(apart.of(text)).alias("body"))
    rows = materialise(fingerprints(rows, "body"))
    prints = materialise(rows.groupBy("print").agg(F.min("id").alias("least")))
    roots = near_prints(prints.select("print"), unit=unit)
    named = prints.join(roots.withColumnRenamed("u", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("print", "component_id")
    own = [F.col(k).alias(c) for k, c in wanted.items()]
    return rows.join(named, "print").select(*own, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return near_duplicates(docs, kept=["doc_id"])
