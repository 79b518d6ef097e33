"""The rated scorecard and its reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from areagrade.operators.ranking import bottom_k, top_k
from areagrade.operators.scorecard import join_areas, metric_summary, renamed, with_rates, with_rating
from areagrade.schemas import RATE_COLUMNS, RATED_NAMES, SCORECARD, SCORECARD_NAMES, SUMMARY_NAMES


def scorecard(exposure: DataFrame, incidents: DataFrame, requests: DataFrame, scale: int = 1000) -> DataFrame:
    """Areas known to all three sources with their rates: the 27 declared columns."""
    return with_rates(join_areas(exposure, incidents, requests), scale).to(SCORECARD)


def rated_scorecard(card: DataFrame, k: int = 1) -> DataFrame:
    """The scorecard with the rating in third place: 28 columns.

    The card feeds both the bounds and the rows: pass it materialised.
    """
    return with_rating(card, k).select(*RATED_NAMES)


def reports(card: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    """Name -> frame: the summary and, for each rate, the ``k`` highest and lowest areas.

    Nine reports read ``card``: pass it materialised.
    """
    named = {"summary": renamed(metric_summary(card), SUMMARY_NAMES)}
    for metric in RATE_COLUMNS:
        named[f"top_{metric}"] = renamed(top_k(card, metric, k), SCORECARD_NAMES)
        named[f"bottom_{metric}"] = renamed(bottom_k(card, metric, k), SCORECARD_NAMES)
    return named
