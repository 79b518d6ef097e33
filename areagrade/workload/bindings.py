"""The three sources of the scorecard, derived from the star-schema tables.

Incidents are line items in the nation of their supplier, requests are events in
the nation of their customer, exposure is order value in the nation of its
customer. Areas take their five-digit spelling on the dimension side, before
any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.functions.text import area_key
from areagrade.operators.measures import keyed_sums
from areagrade.sources.tables import read_table

FACTORS = ("factor_1", "factor_2", "factor_3")
VEHICLES = ("vehicle_1", "vehicle_2")
RATE_SCALE = 1_000_000  # the exposure is money, so incidents per thousand would round to nothing


def _area(key: str) -> Column:
    return area_key(F.col(key).cast("string")).alias("area")


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "supplier").select("s_suppkey", _area("s_nationkey"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").select("c_custkey", _area("c_nationkey"), "c_mktsegment")


def incident_lines(
    spark: SparkSession, sf: str, with_factors: bool = True, with_vehicles: bool = True
) -> DataFrame:
    """Incident records with the supplier in place of the area; the tables behind
    unused category columns are not read."""
    lines = read_table(spark, sf, "lineitem")
    injured = F.col("l_returnflag") == "R"
    killed = injured & (F.col("l_discount") >= 0.09)
    group = (
        F.when(F.col("l_linestatus") == "F", "pedestrians")
        .when(F.col("l_linenumber") <= 3, "cyclists")
        .otherwise("motorists")
    )
    columns = {"persons_injured": injured, "persons_killed": killed}
    for name in ("pedestrians", "cyclists", "motorists"):
        columns[f"{name}_injured"] = injured & (group == name)
        columns[f"{name}_killed"] = killed & (group == name)
    selected = [F.col("l_suppkey").alias("s_suppkey")]
    selected += [value.cast("int").alias(name) for name, value in columns.items()]
    if with_vehicles:
        parts = read_table(spark, sf, "part").select("p_partkey", "p_type", "p_brand")
        lines = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        selected += [F.col("p_type").alias("vehicle_1"), F.col("p_brand").alias("vehicle_2")]
    if with_factors:
        orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        selected += [
            F.col("o_orderpriority").alias("factor_1"),
            F.col("l_returnflag").alias("factor_2"),
            F.nullif(F.col("l_linestatus"), F.lit("O")).alias("factor_3"),
        ]
    return lines.select(*selected)


def incidents(spark: SparkSession, sf: str, with_factors: bool = True, with_vehicles: bool = True) -> DataFrame:
    """Incident records with their area."""
    lines = incident_lines(spark, sf, with_factors, with_vehicles)
    return lines.join(suppliers(spark, sf), "s_suppkey").drop("s_suppkey")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with a ``weight``: equal events of one user are counted before the
    join, so a user with most of the events is a handful of rows in the shuffle."""
    events = read_table(spark, sf, "events")
    counted = keyed_sums(events, ["user_id", "event_type", "props"], {}, count="weight")
    return _located_requests(spark, sf, counted).select(
        "area",
        F.col("event_type").alias("category"),
        F.col("props").alias("descriptor"),
        F.col("c_mktsegment").alias("city"),
        "weight",
    )


def request_counts(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`requests` where neither category nor descriptor matters: one row per user."""
    counted = keyed_sums(read_table(spark, sf, "events"), ["user_id"], {}, count="weight")
    return _located_requests(spark, sf, counted).select("area", F.col("c_mktsegment").alias("city"), "weight")


def _located_requests(spark: SparkSession, sf: str, counted: DataFrame) -> DataFrame:
    return counted.join(customers(spark, sf), F.col("user_id") == F.col("c_custkey"))


def volumes(spark: SparkSession, sf: str) -> DataFrame:
    """Order value and number of orders, summed per customer before the join with its area."""
    orders = read_table(spark, sf, "orders")
    value = F.col("o_totalprice").cast("decimal(18,2)")
    summed = keyed_sums(orders, ["o_custkey"], {"volume": value}, count="samples")
    return summed.join(customers(spark, sf), F.col("o_custkey") == F.col("c_custkey")).select(
        "area", "volume", "samples"
    )


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    """Streets named after nations, each in the area of its region."""
    nation = read_table(spark, sf, "nation")
    number = F.col("n_nationkey").cast("string")
    return nation.select(
        F.concat(F.lit("NATION "), number, F.lit(" ST")).alias("street"), _area("n_regionkey")
    )


def segment_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Count records per order line: three streets named from numbers on the line
    (quantities of 25 and more name no nation) and four hourly cells, one of them text."""
    lines = read_table(spark, sf, "lineitem")

    def street(number: Column) -> Column:
        return F.concat(F.lit("NATION "), number.cast("int").cast("string"), F.lit(" ST"))

    return lines.select(
        F.col("l_orderkey").cast("string").alias("segment_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        street(F.col("l_quantity")).alias("roadway"),
        street(F.col("l_linenumber")).alias("from_street"),
        street(F.round(F.col("l_discount") * 100, 0)).alias("to_street"),
        F.col("l_linenumber").cast("string").alias("hour_00"),
        F.col("l_returnflag").alias("hour_01"),
        F.col("l_quantity").cast("int").cast("string").alias("hour_02"),
        F.concat(F.lit(" "), F.col("l_partkey").cast("string")).alias("hour_03"),
    )


SEGMENT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")
SEGMENT_HOURS = ("hour_00", "hour_01", "hour_02", "hour_03")
