"""Tiered top-N per key, ranked rows to fixed slots, global top and bottom lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areagrade.functions.labels import category_label
from areagrade.functions.numeric import percent
from areagrade.operators.categories import TOTAL

Tiers = Sequence[tuple[int, int]]


def rank_limit(tiers: Tiers) -> int:
    """Ranks that must be kept to fill every slot and to tell every tier apart."""
    return max(max(found, keep) for found, keep in tiers)


def tier_size(found: Column, tiers: Tiers) -> Column:
    """How many categories to keep, from how many were found (exact up to the rank limit)."""
    size = None
    for least, keep in sorted(tiers, reverse=True):
        condition = found >= least
        size = F.when(condition, keep) if size is None else size.when(condition, keep)
    return size.otherwise(0)


def ranked_categories(freq: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """The ``limit`` most frequent categories per key with their ``rank``; ties by category.

    The literal limit lets Spark cut each partition to ``limit`` rows per key
    before the shuffle, so a key with very many categories is never gathered.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("category"))
    return freq.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def tiered_top(
    freq: DataFrame, keys: Sequence[str], tiers: Tiers, ignored: Sequence[str] = ()
) -> DataFrame:
    """(keys, rank, category, n): the top categories, as many as the key's tier allows.

    Tiers need the number of distinct categories only up to the largest
    threshold, so they are read off the ranked rows, already in place.
    """
    candidates = freq.filter(~F.col("category").isin(*ignored)) if ignored else freq
    ranked = ranked_categories(candidates.select(*keys, "category", "n"), keys, rank_limit(tiers))
    found = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (
        ranked.withColumn("_found", found)
        .filter(F.col("rank") <= tier_size(F.col("_found"), tiers))
        .select(*keys, "rank", "category", "n")
    )


def tiered_slots(
    profile: DataFrame,
    keys: Sequence[str],
    tiers: Mapping[str, Tiers],
    sums: Sequence[str] = (),
    count: str = "records",
    ignored: Sequence[str] = (),
) -> DataFrame:
    """One row per key from a category profile: the count, the sums and the top of each kind.

    Every kind in ``tiers`` becomes an array of (rank, category, n) in rank
    order, cut to the key's tier. All kinds share one ranking, and only ranked
    rows, a handful per key, are gathered into the arrays.
    """
    if ignored:
        profile = profile.filter((F.col("kind") == TOTAL) | ~F.col("category").isin(*ignored))
    limit = max(rank_limit(each) for each in tiers.values())
    ranked = ranked_categories(profile, [*keys, "kind"], limit)
    is_total = F.col("kind") == TOTAL
    entry = F.struct("rank", "category", "n")
    gathered = ranked.groupBy(*keys).agg(
        F.max(F.when(is_total, F.col("n"))).alias(count),
        *(F.max(F.when(is_total, F.col(name))).alias(name) for name in sums),
        *(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(kind) for kind in tiers),
    )
    cut = [
        F.slice(F.col(kind), F.lit(1), tier_size(F.size(kind), kind_tiers)).alias(kind)
        for kind, kind_tiers in tiers.items()
    ]
    return gathered.select(*keys, count, *sums, *cut)


def spread_slots(df: DataFrame, kinds: Mapping[str, int], total: Mapping[str, str], empty: str = "") -> DataFrame:
    """Replace each array of a kind by its fixed slots ``<kind>_<i>``, labelled ``category: n: share%``.

    ``kinds`` gives the number of slots, ``total`` the denominator column of
    each kind. Unused slots take ``empty``.
    """

    def labels(kind: str) -> Column:
        base = F.col(total[kind])
        return F.transform(kind, lambda slot: category_label(slot["category"], slot["n"], percent(slot["n"], base)))

    labelled = df.withColumns({kind: labels(kind) for kind in kinds})
    slots = [
        F.coalesce(F.get(kind, F.lit(i)), F.lit(empty)).alias(f"{kind}_{i + 1}")
        for kind, size in kinds.items()
        for i in range(size)
    ]
    return labelled.select(*(name for name in df.columns if name not in kinds), *slots)


def top_k(df: DataFrame, metric: str, k: int = 10, tie: str = "area") -> DataFrame:
    """The ``k`` rows with the highest metric; per-partition heaps, no full sort."""
    return df.orderBy(F.desc_nulls_last(metric), F.asc(tie)).limit(k)


def bottom_k(df: DataFrame, metric: str, k: int = 10, tie: str = "area") -> DataFrame:
    return df.orderBy(F.asc_nulls_last(metric), F.asc(tie)).limit(k)
