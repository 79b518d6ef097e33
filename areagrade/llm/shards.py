"""Sharding: k-d tree partitioning at distributed weighted medians.

Everything here is DataFrame code; no Python runs on the executors. The driver sees a few
rows per open tree node and search step, of which there are fewer than shards.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BINS = 1024
LEAST = -(1 << 61)  # stands for null


@dataclass
class Cut:
    """The search for the cut of a node: descends in ``order``, from coarse bins to one value."""

    order: list[str]
    ends: dict[str, tuple[int, int]]
    want: int
    keys: list[int] = field(default_factory=list)
    done: bool = False

    def __post_init__(self):
        self.low, self.high = self.ends[self.order[0]]

    @property
    def axis(self) -> str:
        return self.order[len(self.keys)]

    @property
    def step(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def below(self) -> Column:
        """Rows below the cut: the keys are compared in turn, the last one excludes."""
        last = len(self.keys) - 1
        out = F.col(self.order[last]) < self.keys[last]
        for name, key in reversed(list(zip(self.order, self.keys[:last]))):
            out = (F.col(name) < key) | ((F.col(name) == key) & out)
        return out

    def searched(self) -> Column:
        """Rows in which the cut is still looked for."""
        out = F.col(self.axis).between(self.low, self.high)
        for name, key in zip(self.order, self.keys):
            out = out & (F.col(name) == key)
        return out

    def descend(self, number: int, weight: int, to: int, slack: int) -> None:
        """Go into bin ``number``, of that weight and cumulated weight, or end at an edge of it."""
        before = to - weight
        first = self.low + number * self.step
        last = min(self.high, first + self.step - 1)
        nearer_edge = first if self.want - before <= to - self.want else last + 1
        if weight > slack and first < last:
            self.low, self.high, self.want = first, last, self.want - before
        elif weight > slack and len(self.keys) + 1 < len(self.order):
            self.keys.append(first)
            self.low, self.high = self.ends[self.axis]
            self.want -= before
        else:
            self.keys.append(nearer_edge)
            self.done = True


def kd_shards(
    rows: DataFrame, size: Column, dims: list[Column], ties: list[Column], shards: int, tolerance: float = 0.01
) -> DataFrame:
    """Adds ``size``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    A node that stands for n shards is split at the share (n // 2) / n of its bytes along its
    widest dimension, until every node is one shard. ``dims`` are whole numbers, null counts
    as the least; the width of a node is its range as a share of the whole table's, ties go to
    the first dimension. The cut is found by histograms of at most BINS bins per node, for all
    nodes of a level at once. The search goes on inside the bin that holds the cut, then along
    ``ties`` (whole numbers; the last should tell rows apart) among rows of one value. It ends
    at the nearer edge of a bin that weighs at most ``tolerance`` of a shard's target. So rows
    that are equal in ``dims`` and in a prefix of ``ties`` stay together unless they weigh
    more; a hot value is cut by the next coordinate, and no shard outgrows the others.

    ``rows`` is written once as a checkpoint and read in each step: pass ids and sizes, not
    texts. Rows that are equal in all coordinates stay in one shard. With fewer distinct rows
    than shards, some shards are empty; an empty table gives no rows. Columns of the three
    names are replaced, all others stay.
    """
    kept = [c for c in rows.columns if c not in ("size", "shard", "slot")]
    dim_names, tie_names = [f"_d{i}" for i in range(len(dims))], [f"_t{i}" for i in range(len(ties))]
    coordinates = dict(zip(dim_names + tie_names, [*dims, *ties]))
    points = rows.select(
        *kept,
        size.cast("long").alias("_size"),
        *(F.coalesce(c.cast("long"), F.lit(LEAST)).alias(n) for n, c in coordinates.items()),
    ).checkpoint()
    ends = [F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in coordinates]
    total = points.agg(F.sum("_size").alias("w"), F.count("*").alias("n"), *ends).first()
    spans = {c: (total[c].high - total[c].low) or 1 if total["n"] else 1 for c in dim_names}
    slack = int((total["w"] or 0) / shards * tolerance)
    cuts: dict[int, Cut] = {}
    width = {1: shards}

    def node(k: int = 1) -> Column:
        return F.when(cuts[k].below(), node(2 * k)).otherwise(node(2 * k + 1)) if k in cuts else F.lit(k)

    while total["n"] and any(n > 1 for n in width.values()):
        at = points.withColumn("_node", node())
        opened = {}
        of_open = F.col("_node").isin([k for k, n in width.items() if n > 1])
        for row in at.where(of_open).groupBy("_node").agg(F.sum("_size").alias("w"), *ends).collect():
            k = row["_node"]
            axis = max(dim_names, key=lambda c: (row[c].high - row[c].low) / spans[c])
            bounds = {c: (row[c].low, row[c].high) for c in coordinates}
            opened[k] = Cut([axis, *tie_names], bounds, row["w"] * (width[k] // 2) // width[k])
        live = opened
        while live := {k: c for k, c in live.items() if not c.done}:
            _search_step(at, live, slack)
        cuts |= opened
        width = {k: n for k, n in width.items() if n == 1} | {
            c: m for k, n in width.items() if n > 1 for c, m in ((2 * k, n // 2), (2 * k + 1, n - n // 2))
        }
    number = {k: i for i, k in enumerate(sorted(width, key=lambda k: bin(k)[3:]))}

    def leaf(k: int = 1) -> Column:
        return F.when(cuts[k].below(), leaf(2 * k)).otherwise(leaf(2 * k + 1)) if k in cuts else F.lit(number.get(k, 0))

    placed = points.select(*kept, F.col("_size").alias("size"), *tie_names, leaf().alias("shard"))
    return _with_slots(placed, tie_names, total["n"]).select(*kept, "size", "shard", "slot")


def _search_step(at: DataFrame, live: dict[int, Cut], slack: int) -> None:
    number, want, inside = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(False)
    for k, cut in live.items():
        here = F.col("_node") == k
        number = F.when(here, F.expr(f"({cut.axis} - {cut.low}L) div {cut.step}L")).otherwise(number)
        want = F.when(here, F.lit(cut.want)).otherwise(want)
        inside = inside | (here & cut.searched())
    bins = at.where(inside).groupBy("_node", number.alias("_bin")).agg(F.sum("_size").alias("_w"))
    summed = bins.withColumn("_to", F.sum("_w").over(Window.partitionBy("_node").orderBy("_bin")))
    found = summed.where((F.col("_to") >= want) & (F.col("_to") - F.col("_w") < want)).collect()
    for row in found:
        live[row["_node"]].descend(row["_bin"], row["_w"], row["_to"], slack)
    for k in set(live) - {row["_node"] for row in found}:  # nothing is wanted below
        live[k].keys.append(live[k].low)
        live[k].done = True


def _with_slots(placed: DataFrame, order: list[str], n: int, rows_per_task: int = 50_000) -> DataFrame:
    """Number the rows of each shard: in blocks dealt by hash, then the blocks' counts are summed."""
    blocks = n // rows_per_task + 1
    dealt = placed.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    starts = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(*order, "size"))
    numbered = dealt.withColumn("_number", inside)
    return numbered.join(starts, ["shard", "_block"]).withColumn("slot", F.col("_start") + F.col("_number") - 1)


def op7_kd_shards(spark: SparkSession, sf: str) -> DataFrame:
    """24 shards of near equal bytes by size, line count and bytes beyond ASCII: a text's own
    metadata, so equal texts meet unless a group outweighs the tolerance."""
    from areagrade.sources.tables import read_table

    text = F.coalesce("text", F.lit(""))
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n")))
    rows = read_table(spark, sf, "documents").select(
        "doc_id",
        F.octet_length(text).cast("long").alias("bytes"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        lines.alias("lines"),
        (F.octet_length(text) - F.char_length(text)).alias("beyond_ascii"),
    )
    placed = kd_shards(
        rows,
        F.col("bytes") + 8,
        [F.col("bytes"), F.col("lines"), F.col("beyond_ascii")],
        [F.col("text_crc32"), F.col("doc_id")],
        24,
    )
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
