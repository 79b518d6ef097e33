"""Spreading a measure over several areas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areagrade.functions.numeric import whole_div
from areagrade.functions.text import is_filled


def _share(measure: str, weight: Column, parts: Column | int, exact: bool) -> Column:
    """``weight`` of ``parts`` equal parts: each part truncated, or exactly as a double."""
    if exact:
        return F.col(measure) * weight / parts
    return weight * whole_div(F.col(measure), parts)


def split_area_cells(
    df: DataFrame,
    area: str = "area",
    measures: Sequence[str] = ("volume", "samples"),
    drop_mark: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Rows whose area cell names several areas (``a;b``, ``a: b``) become one row per area.

    Each takes an equal share of the measures, truncated unless ``exact``. Rows
    whose cell contains ``drop_mark`` repeat another row and are dropped.
    Row-local.
    """
    if drop_mark is not None:
        df = df.filter(~F.col(area).contains(drop_mark))
    trimmed = F.regexp_replace(F.col(area), r"^[;:\s]+|[;:\s]+$", "")
    parts = df.withColumn("_areas", F.split(trimmed, r"\s*[;:][;:\s]*"))
    named = F.size("_areas")
    shares = {
        name: F.when(named == 1, F.col(name)).otherwise(_share(name, F.lit(1), named, exact)) for name in measures
    }
    return parts.withColumns(shares).withColumn(area, F.explode("_areas")).drop("_areas")


def apportion_by_position(
    df: DataFrame, areas: Sequence[str], measures: Sequence[str], output: str = "area", exact: bool = False
) -> DataFrame:
    """Spread measures over the areas named in several columns of a row.

    Every column carries one n-th. An area named w times gets w times the
    truncated n-th (w n-ths as a double if ``exact``), an area named in all
    columns gets the measure whole.
    Row-local: no shuffle and no row ids; other columns are carried along.
    """
    n = len(areas)
    shares = []
    for i, area in enumerate(areas):
        repeated = reduce(add, (F.col(area).eqNullSafe(F.col(other)).cast("int") for other in areas))
        seen = [F.col(area).eqNullSafe(F.col(earlier)) for earlier in areas[:i]]
        weight = repeated if not seen else F.when(reduce(lambda a, b: a | b, seen), 0).otherwise(repeated)
        shares.append(F.struct(F.col(area).alias("area"), weight.alias("weight")))
    others = [name for name in df.columns if name not in {*areas, *measures}]
    spread = df.select(*others, *measures, F.explode(F.array(*shares)).alias("_share"))
    weight = F.col("_share.weight")
    return spread.filter(weight > 0).select(
        *others,
        F.col("_share.area").alias(output),
        *(
            F.when(weight == n, F.col(name)).otherwise(_share(name, weight, n, exact)).alias(name)
            for name in measures
        ),
    )


def one_area_per_street(gazetteer: DataFrame) -> DataFrame:
    """A street listed with several areas keeps the smallest, so that lookups cannot multiply rows.

    Entries without a street or an area resolve nothing and are dropped.
    """
    entries = gazetteer.filter(is_filled(F.col("street")) & is_filled(F.col("area")))
    return entries.groupBy("street").agg(F.min("area").alias("area"))


def resolve_areas(df: DataFrame, gazetteer: DataFrame, streets: Mapping[str, str]) -> DataFrame:
    """Look up each street column (``column -> output``); rows with any miss are dropped.

    Equi-joins without hints: Spark broadcasts the gazetteer while it measures
    below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, with
    skewed streets split by AQE. ``gazetteer`` has one row per street.
    """
    for column, output in streets.items():
        entry = gazetteer.select(F.col("street").alias(column), F.col("area").alias(output))
        df = df.join(entry, column, "inner")
    return df
