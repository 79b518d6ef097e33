"""Traffic exposure per area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.functions.numeric import wide_sum
from areagrade.functions.text import area_key, ordinal_street
from areagrade.operators.apportion import (
    apportion_by_position,
    one_area_per_street,
    resolve_areas,
    split_area_cells,
)
from areagrade.operators.measures import first_record_rollup, ratio_over_period
from areagrade.schemas import DUPLICATE_AREA_MARK, HOUR_COLUMNS, SEGMENT_COUNTS, STREET_ALIASES, WINDOW_DAYS
from areagrade.sources.staged import Staged, stage_records

STREETS = ("roadway", "from_street", "to_street")
TOO_LARGE = "sum"  # why a count record is refused whose volume does not fit in BIGINT
_AREAS = {"from_street": "from_area", "to_street": "to_area", "roadway": "roadway_area"}


def stage_counts(spark: SparkSession, path: str | list[str]) -> Staged:
    """Count records with their ``volume``, read and summed once; refused for their form or as TOO_LARGE."""
    volume = {"volume": wide_sum(F.col(name) for name in HOUR_COLUMNS)}
    fits = {TOO_LARGE: F.col("volume").isNotNull()}
    return stage_records(spark, path, SEGMENT_COUNTS, derived=volume, checks=fits, kept=["segment_id", "record_id", *STREETS, "volume"])


def segment_volume(
    counts: DataFrame, hours: Sequence[str] = HOUR_COLUMNS, order_by: Sequence[str] = ("record_id",)
) -> DataFrame:
    """Hourly counts per record to one row per segment: streets, volume, samples.

    Street names are normalised on the segments, which are fewer than the records.
    A missing name becomes empty. The names pass through an ``inline`` of one
    element: the optimizer would copy their expressions into the NULL checks of
    every join they are a key of. Records whose volume does not fit in BIGINT are
    left out; :func:`segment_rejects` returns them.
    """
    volume = F.struct(wide_sum(F.col(name) for name in hours).alias("volume"))
    # Through an inline as well: a filter over a plain column would work the sum out twice.
    summed = counts.select("segment_id", *order_by, *STREETS, F.inline(F.array(volume)))
    return segment_names(summed.filter(F.col("volume").isNotNull()), order_by)


def segment_names(records: DataFrame, order_by: Sequence[str] = ("record_id",)) -> DataFrame:
    """Records with their volume to one row per segment, as :func:`segment_volume` returns it."""
    segments = first_record_rollup(records, "segment_id", order_by, STREETS, "volume")
    named = F.struct(*(F.coalesce(ordinal_street(F.col(name), STREET_ALIASES), F.lit("")).alias(name) for name in STREETS))
    return segments.select("segment_id", F.inline(F.array(named)), "volume", "samples")


def segment_rejects(counts: DataFrame, hours: Sequence[str] = HOUR_COLUMNS) -> DataFrame:
    """The count records that :func:`segment_volume` leaves out."""
    return counts.filter(wide_sum(F.col(name) for name in hours).isNull())


def area_volume(segments: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Segment volumes spread over the areas of their three streets, not yet merged per area."""
    located = resolve_areas(segments, one_area_per_street(gazetteer), _AREAS)
    spread = apportion_by_position(located, tuple(_AREAS.values()), ("volume", "samples"))
    return spread.select("area", "volume", "samples")


def annual_exposure(volumes: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(area, exposure): mean volume per sample over the period, areas in shared cells split first."""
    split = split_area_cells(volumes, drop_mark=DUPLICATE_AREA_MARK)
    keyed = split.withColumn("area", area_key(F.col("area"))).filter(F.col("area").isNotNull())
    return ratio_over_period(keyed, ["area"], "volume", "samples", days, "exposure")
