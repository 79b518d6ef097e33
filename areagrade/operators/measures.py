"""Keyed measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from areagrade.functions.labels import count_label
from areagrade.functions.numeric import percent, whole_div

TEXT_BYTES = 15  # as many as a decimal of 38 digits holds beside their number


def keyed_sums(
    df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], count: str | None = None
) -> DataFrame:
    """Row count and sums per key. One shuffle, after partial sums on each mapper,
    so a key holding most of the rows costs one row per map task."""
    aggregates = [F.sum(value).alias(name) for name, value in sums.items()]
    if count:
        aggregates.insert(0, F.count(F.lit(1)).alias(count))
    return df.groupBy(*keys).agg(*aggregates)


def rolled_up_sums(
    df: DataFrame,
    foreign_key: str,
    dimension: DataFrame,
    keys: Sequence[str],
    sums: Mapping[str, Column],
    count: str | None = None,
) -> DataFrame:
    """Sums per attribute of a dimension, summed by the foreign key before the join.

    ``dimension`` has the foreign key's name for its own unique key. The first
    sum's shuffle also serves the join, records cross the network once, and a
    foreign key with most of the records is one row per map task.
    """
    by_foreign_key = keyed_sums(df, [foreign_key], sums, count)
    names = [*([count] if count else []), *sums]
    return keyed_sums(
        by_foreign_key.join(dimension, foreign_key, "inner"), keys, {name: F.col(name) for name in names}
    )


def share_columns(total: str, parts: Sequence[str]) -> dict[str, Column]:
    """``<part>_pct``: each part's share of the total in percent, 0 when the total is 0."""
    return {f"{part}_pct": percent(F.col(part), F.col(total)) for part in parts}


def share_labels(total: str, parts: Sequence[str]) -> dict[str, Column]:
    """``<part>_label``: each part with its share, as ``20: 9.0%``."""
    return {f"{part}_label": count_label(F.col(part), percent(F.col(part), F.col(total))) for part in parts}


def modal_value(freq: DataFrame, keys: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """The most frequent value per key, ties by value, from a (keys, value, n) frequency.

    A minimum over (-n, value): partial results combine before the shuffle, so
    no key's values are ever gathered in one place.
    """
    best = F.min(F.struct((-F.col(n)).alias("order"), F.col(value).alias("value")))
    return freq.groupBy(*keys).agg(best.alias("_best")).select(*keys, F.col("_best.value").alias(value))


def first_record_rollup(
    df: DataFrame,
    key: str,
    order_by: Sequence[str],
    attributes: Sequence[str],
    volume: str,
    samples: str = "samples",
) -> DataFrame:
    """Per key: attributes of the first record, total volume, number of records.

    "First" is by ``order_by``, then by the attributes themselves, NULLs first, and so does
    not depend on how the rows are partitioned.

    Records are first counted by key and by all that decides but the first order column, of
    which a group keeps the least. That value, a sum and a count have a fixed width, so this is a
    hash aggregation that combines on the mappers, whatever order the records are in: a
    segment whose records agree on the attributes is one row from there on, however many it
    has. Only such rows are compared as a whole.
    """
    least, apart = _fixed_width(df, order_by[0])
    decided = {f"_by_{i}": value for i, value in enumerate([*apart, *map(F.col, order_by[1:])])}
    groups = (
        df.select(key, *(value.alias(name) for name, value in decided.items()), *attributes, least.alias("_least"), volume)
        .groupBy(key, *decided, *attributes)
        .agg(F.min("_least").alias("_least"), F.sum(volume).alias(volume), F.count(F.lit(1)).alias(samples))
    )
    first = F.min(F.struct("_least", *decided, *(F.col(name).alias(f"_{name}") for name in attributes)))
    return (
        groups.groupBy(key)
        .agg(first.alias("_first"), F.sum(volume).alias(volume), F.sum(samples).alias(samples))
        .select(key, *(F.col(f"_first._{name}").alias(name) for name in attributes), volume, samples)
    )


def _fixed_width(df: DataFrame, name: str) -> tuple[Column, list[Column]]:
    """A column as a value of fixed width in the same order, and what else tells its values apart.

    A text is its first 15 bytes and their number, as one decimal, with the rest of it apart. NULL
    stays NULL and a group of its own, for a minimum skips it.
    """
    column, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, StringType):
        data = F.encode(column, "UTF-8")
        digits = F.rpad(F.hex(F.substring(data, 1, TEXT_BYTES)), 2 * TEXT_BYTES, "0")
        high, low = (F.conv(part, 16, 10).cast("decimal(20,0)") for part in (F.substring(digits, 1, 14), F.substring(digits, 15, 16)))
        size = F.least(F.octet_length(column), F.lit(TEXT_BYTES))
        code = (high * F.lit(str(1 << 64)).cast("decimal(20,0)") + low) * F.lit(16).cast("decimal(2,0)") + size
        return code.cast("decimal(38,0)"), [F.substring(data, TEXT_BYTES + 1, 1 << 30)]
    if isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType, BooleanType)):
        return column, [column.isNotNull()]
    return F.lit(0), [column]


def ratio_over_period(
    df: DataFrame, keys: Sequence[str], volume: str, samples: str, days: int, output: str = "volume"
) -> DataFrame:
    """Volume per sample, truncated, times ``days``; NULL for a key without samples.

    Rows that lack one of the two count for neither.
    """
    both = F.col(volume).isNotNull() & F.col(samples).isNotNull()
    per_sample = whole_div(F.sum(F.when(both, F.col(volume))), F.sum(F.when(both, F.col(samples))))
    return df.groupBy(*keys).agg((per_sample * F.lit(days).cast("bigint")).alias(output))
