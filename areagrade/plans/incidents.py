"""Incident statistics per area."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areagrade.functions.numeric import filled_count
from areagrade.functions.temporal import in_window, with_parsed_time
from areagrade.functions.text import area_key, is_filled
from areagrade.operators.categories import category_profile, profile_totals
from areagrade.operators.measures import share_labels
from areagrade.operators.ranking import spread_slots, tiered_slots
from areagrade.schemas import (
    CASUALTY_COLUMNS,
    FACTOR_COLUMNS,
    IGNORED_CATEGORIES,
    INCIDENT_TIME_FORMATS,
    TIERS_FIVE,
    VEHICLE_COLUMNS,
    WINDOW_END,
    WINDOW_START,
)

_RENAMED = {"persons_injured": "injured", "persons_killed": "killed"}
CASUALTY_PARTS = {
    "injured": ("pedestrians_injured", "cyclists_injured", "motorists_injured"),
    "killed": ("pedestrians_killed", "cyclists_killed", "motorists_killed"),
}
SUMS = ("vehicles", *(_RENAMED.get(name, name) for name in CASUALTY_COLUMNS))


def prepare_incidents(
    records: DataFrame,
    start: datetime = WINDOW_START,
    end: datetime = WINDOW_END,
    formats: Sequence[str] = INCIDENT_TIME_FORMATS,
) -> DataFrame:
    """Records of the closed window with a readable time and an area, pruned to what is counted."""
    located = records.filter(is_filled(F.col("area")))
    timed = with_parsed_time(located, [F.col("date"), F.col("time")], formats)
    return timed.filter(in_window(F.col("moment"), start, end)).select(
        area_key(F.col("area")).alias("area"), *CASUALTY_COLUMNS, *FACTOR_COLUMNS, *VEHICLE_COLUMNS
    )


def incident_profile(
    incidents: DataFrame,
    factors: Sequence[str] = FACTOR_COLUMNS,
    vehicles: Sequence[str] = VEHICLE_COLUMNS,
) -> DataFrame:
    """Casualty sums, vehicle slots and both category kinds per area, from one pass.

    Statistics and totals both start from it; materialise it when both are wanted.
    """
    sums = {"vehicles": filled_count(F.col(name) for name in vehicles)}
    sums |= {_RENAMED.get(name, name): F.col(name) for name in CASUALTY_COLUMNS}
    return category_profile(incidents, ["area"], {"factor": factors, "vehicle": vehicles}, sums)


def incident_stats(profile: DataFrame, share_of: str = "vehicles") -> DataFrame:
    """One row per area: counts, casualty shares and the top factors and vehicle types.

    Factor shares divide by ``share_of``, by default the vehicles, as vehicle
    shares do.
    """
    slots = tiered_slots(
        profile,
        ["area"],
        {"factor": TIERS_FIVE, "vehicle": TIERS_FIVE},
        sums=SUMS,
        count="incidents",
        ignored=IGNORED_CATEGORIES,
    )
    spread = spread_slots(slots, {"factor": 5, "vehicle": 5}, {"factor": share_of, "vehicle": "vehicles"})
    labels = {}
    for total, parts in CASUALTY_PARTS.items():
        labels |= share_labels(total, parts)
    order = [f"{part}_label" for pair in zip(*CASUALTY_PARTS.values()) for part in pair]
    return spread.select(
        "area",
        "incidents",
        "vehicles",
        "injured",
        "killed",
        *(labels[name].alias(name) for name in order),
        *(f"factor_{i}" for i in range(1, 6)),
        *(f"vehicle_{i}" for i in range(1, 6)),
    )


def incident_totals(profile: DataFrame) -> DataFrame:
    """All totals in one descending list: metrics, factors and vehicle types."""
    return profile_totals(profile, "incidents", SUMS)
