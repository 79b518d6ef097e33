"""Join of the three statistics, rates, summaries and the sigma-band rating."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areagrade.functions.numeric import rate
from areagrade.schemas import RATE_COLUMNS, RATINGS

MOMENT_DIGITS = 6


def join_areas(*stats: DataFrame, key: str = "area") -> DataFrame:
    """Areas present in every frame. Each has one row per area, already spread by
    the area, so large inputs join in place and small ones are broadcast by size."""
    return reduce(lambda left, right: left.join(right, key, "inner"), stats)


def with_rates(df: DataFrame, scale: int = 1000) -> DataFrame:
    """Incidents per ``scale`` of volume, casualties per 1000 incidents, vehicles per incident."""
    incidents = F.col("incidents")
    return df.withColumns(
        {
            "incident_rate": rate(incidents, F.col("exposure"), scale),
            "injury_rate": rate(F.col("injured"), incidents, 1000),
            "death_rate": rate(F.col("killed"), incidents, 1000),
            "vehicles_per_incident": rate(F.col("vehicles"), incidents),
        }
    )


def exact_moments(metric: str) -> tuple[Column, Column]:
    """Mean and sample deviation that do not depend on the order or partitions of the rows.

    Values count to MOMENT_DIGITS places. Sums of them and of their squares are whole numbers in
    units of the last place, which add up exactly; only the last steps are in floating point.
    NULL without values, a NULL deviation of a single one. Sums that do not fit in 38 digits
    give way to Spark's own moments.
    """
    return _moments(_sums(metric).__getitem__)


def _sums(metric: str) -> dict[str, Column]:
    """What a metric's moments are worked out from; each adds up over partitions."""
    unit = F.lit(10**MOMENT_DIGITS).cast("decimal(20,0)")
    value = F.col(metric)
    whole = F.try_multiply(value.try_cast(f"decimal(32,{MOMENT_DIGITS})"), unit).try_cast("decimal(38,0)")
    squares = F.try_multiply(whole, whole).try_cast("decimal(38,0)")
    sums = {"n": F.count(whole), "known": F.count(value), "total": F.try_sum(whole), "squares": F.try_sum(squares)}
    return sums | {"mean": F.avg(value), "deviation": F.stddev_samp(value)}


def _moments(of: Callable[[str], Column]) -> tuple[Column, Column]:
    n, total = of("n").cast("decimal(38,0)"), of("total")
    spread = F.try_subtract(F.try_multiply(n, of("squares")), F.try_multiply(total, total)).cast("double")
    all_fit = (of("n") == of("known")) & spread.isNotNull()
    count = n.cast("double")
    mean = F.when(all_fit, total.cast("double") / count / 10.0**MOMENT_DIGITS).otherwise(of("mean"))
    variance = F.try_divide(spread, count * (count - 1))
    return mean, F.when(all_fit, F.sqrt(variance) / 10.0**MOMENT_DIGITS).otherwise(of("deviation"))


def _moment_row(df: DataFrame, metrics: Sequence[str], *others: Column) -> DataFrame:
    """One row with ``<metric>_mean`` and ``<metric>_stddev`` and the other aggregates.

    The sums come first and the arithmetic on them after, which keeps the generated code small.
    """
    sums = [F.struct(*(value.alias(name) for name, value in _sums(metric).items())).alias(f"_{metric}") for metric in metrics]
    row = df.agg(*sums, *others)
    moments = []
    for metric in metrics:
        mean, deviation = _moments(lambda name, metric=metric: F.col(f"_{metric}.{name}"))
        moments += [mean.alias(f"{metric}_mean"), deviation.alias(f"{metric}_stddev")]
    return row.select(*moments, *(name for name in row.columns if name not in {f"_{metric}" for metric in metrics}))


def metric_summary(df: DataFrame, metrics: Sequence[str] = RATE_COLUMNS, digits: int | None = None) -> DataFrame:
    """(statistic, <metrics>): count, mean, sample stddev, min and max, in one aggregation."""
    plain = {"count": F.count, "min": F.min, "max": F.max}
    others = [function(metric).alias(f"{metric}_{name}") for name, function in plain.items() for metric in metrics]

    def value(name: str, metric: str) -> Column:
        number = F.col(f"{metric}_{name}").cast("double")
        return number if digits is None else F.round(number, digits)

    rows = [
        F.struct(F.lit(name).alias("statistic"), *(value(name, metric).alias(metric) for metric in metrics))
        for name in ("count", "mean", "stddev", "min", "max")
    ]
    return _moment_row(df, metrics, *others).select(F.inline(F.array(*rows)))


def sigma_bounds(
    df: DataFrame, metrics: Sequence[str] = RATE_COLUMNS, bands: Sequence[int] = (1,), digits: int = 4
) -> DataFrame:
    """(metric, k, mean, stddev, lower, upper): mean +- k sample deviations, all rounded."""
    rows = []
    for metric in metrics:
        mean, deviation = (F.round(f"{metric}_{name}", digits) for name in ("mean", "stddev"))
        for k in bands:
            rows.append(
                F.struct(
                    F.lit(metric).alias("metric"),
                    F.lit(k).alias("k"),
                    mean.alias("mean"),
                    deviation.alias("stddev"),
                    F.round(mean - k * deviation, digits).alias("lower"),
                    F.round(mean + k * deviation, digits).alias("upper"),
                )
            )
    return _moment_row(df, metrics).select(F.inline(F.array(*rows)))


def with_rating(df: DataFrame, k: int = 1, digits: int = 4, names: Sequence[str] = RATINGS) -> DataFrame:
    """Add ``rating``: the incident band, moved one step where both casualty rates agree.

    Bands are +1 above, -1 below and 0 within mean +- k deviations (strict). The
    rating is the incident band, plus one if injury and death rates are both
    above, minus one if both are below, held within -1..1. A row without one of the
    rates, or a table without one of the bounds, has no rating. The bounds reach the
    rows as a scalar subquery of one row; ``df`` is read twice, so pass a
    materialised frame.
    """
    watched = ("incident_rate", "injury_rate", "death_rate")
    bounds = _moment_row(df, watched).select(F.struct(*(_bounds(metric, k, digits).alias(metric) for metric in watched)).alias("bounds"))
    rated = df.withColumn("_bounds", bounds.scalar())
    above = {metric: F.col(metric) > F.col(f"_bounds.{metric}.upper") for metric in watched}
    below = {metric: F.col(metric) < F.col(f"_bounds.{metric}.lower") for metric in watched}
    band = F.when(above["incident_rate"], 1).when(below["incident_rate"], -1).otherwise(0)
    both = F.when(above["injury_rate"] & above["death_rate"], 1)
    both = both.when(below["injury_rate"] & below["death_rate"], -1).otherwise(0)
    safe, ok, hazardous = names
    rating = F.when(band + both > 0, hazardous).when(band + both < 0, safe).otherwise(ok)
    known = F.lit(True)
    for metric in watched:
        known = known & F.col(metric).isNotNull() & F.col(f"_bounds.{metric}.upper").isNotNull()
    return rated.withColumn("rating", F.when(known, rating)).drop("_bounds")


def _bounds(metric: str, k: int, digits: int) -> Column:
    mean, deviation = (F.round(f"{metric}_{name}", digits) for name in ("mean", "stddev"))
    return F.struct(
        F.round(mean - k * deviation, digits).alias("lower"), F.round(mean + k * deviation, digits).alias("upper")
    )


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Project to report names, in the given order."""
    return df.select(*(F.col(column).alias(name) for column, name in names.items()))
