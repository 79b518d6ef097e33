"""Service-request statistics per area."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areagrade.functions.temporal import in_window, with_parsed_time
from areagrade.functions.text import area_key, is_filled, keyword_match
from areagrade.operators.categories import category_profile, profile_totals
from areagrade.operators.ranking import spread_slots, tiered_slots
from areagrade.schemas import (
    REQUEST_EXCLUDE,
    REQUEST_INCLUDE,
    REQUEST_TIME_FORMATS,
    TIER_ONE,
    TIERS_FIVE,
    TIERS_THREE,
    WINDOW_END,
    WINDOW_START,
)

_KINDS = {"complaint": ["category"], "descriptor": ["descriptor"], "city": ["city"]}


def prepare_requests(
    records: DataFrame,
    start: datetime = WINDOW_START,
    end: datetime = WINDOW_END,
    formats: Sequence[str] = REQUEST_TIME_FORMATS,
    include: str = REQUEST_INCLUDE,
    exclude: str | None = REQUEST_EXCLUDE,
) -> DataFrame:
    """Requests of the closed window on the wanted subject, with an area and a city."""
    wanted = (
        is_filled(F.col("area")) & is_filled(F.col("city")) & keyword_match(F.col("category"), include, exclude)
    )
    timed = with_parsed_time(records.filter(wanted), [F.col("created_at")], formats)
    return timed.filter(in_window(F.col("moment"), start, end)).select(
        area_key(F.col("area")).alias("area"), F.upper("category").alias("category"), "descriptor", "city"
    )


def request_profile(requests: DataFrame, weight: str | None = None) -> DataFrame:
    """Request count, complaints, descriptors and cities per area, from one pass.

    ``weight`` names a column with the number of requests a row stands for, for
    input that was counted before it was joined.
    """
    return category_profile(requests, ["area"], _KINDS, weight=weight)


def request_stats(profile: DataFrame) -> DataFrame:
    """One row per area: request count, top complaints and descriptors, most frequent city."""
    slots = tiered_slots(
        profile,
        ["area"],
        {"complaint": TIERS_THREE, "descriptor": TIERS_FIVE, "city": TIER_ONE},
        count="requests",
    )
    slots = slots.withColumn("city", F.get("city", F.lit(0))["category"])
    spread = spread_slots(
        slots, {"complaint": 3, "descriptor": 5}, {"complaint": "requests", "descriptor": "requests"}
    )
    return spread.select(
        "area",
        "requests",
        *(f"complaint_{i}" for i in range(1, 4)),
        *(f"descriptor_{i}" for i in range(1, 6)),
        "city",
    )


def request_totals(profile: DataFrame) -> DataFrame:
    """All totals in one descending list: the request count, complaints and descriptors."""
    return profile_totals(profile.filter(F.col("kind") != "city"), "requests", [])
