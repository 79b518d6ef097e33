"""One function per query: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from areagrade.functions.numeric import filled_count, wide_sum
from areagrade.functions.temporal import in_window, with_parsed_time
from areagrade.functions.text import (
    area_key,
    capitalised,
    is_filled,
    keyword_match,
    kind_by_case,
    not_ignored,
    numeric_key,
    ordinal_street,
)
from areagrade.operators.apportion import (
    apportion_by_position,
    one_area_per_street,
    resolve_areas,
    split_area_cells,
)
from areagrade.operators.categories import (
    category_frequency,
    category_profile,
    category_totals,
    two_level_totals,
)
from areagrade.operators.measures import (
    first_record_rollup,
    keyed_sums,
    modal_value,
    ratio_over_period,
    rolled_up_sums,
    share_columns,
    share_labels,
)
from areagrade.operators.profiles import ProfileTable
from areagrade.operators.ranking import bottom_k, spread_slots, tiered_slots, tiered_top, top_k
from areagrade.operators.scorecard import join_areas, metric_summary, renamed, sigma_bounds, with_rates, with_rating
from areagrade.plans import exposure as exposure_plan
from areagrade.plans.incidents import SUMS as INCIDENT_SUMS
from areagrade.plans.incidents import (
    CASUALTY_PARTS,
    incident_profile,
    incident_stats,
    incident_totals,
    prepare_incidents,
)
from areagrade.plans.requests import prepare_requests, request_profile, request_stats, request_totals
from areagrade.plans.scorecard import rated_scorecard, scorecard
from areagrade.schemas import (
    CASUALTY_COLUMNS,
    FACTOR_COLUMNS,
    RATE_COLUMNS,
    RATED_NAMES,
    REQUEST_TIME_FORMATS,
    SCORECARD_NAMES,
    STREET_ALIASES,
    SUMMARY_NAMES,
    TIERS_FIVE,
    VEHICLE_COLUMNS,
    WINDOW_DAYS,
)
from areagrade.session import materialise, scratch_path
from areagrade.sources.delimited import (
    drop_header_lines,
    merge_surplus_cells,
    parse_lines,
    read_delimited,
    realign_by_number,
    sampled,
)
from areagrade.sources.sinks import ReportSet, read_manifest, read_ordered, write_ordered, write_report
from areagrade.sources.staged import Staged, stage_positions, stage_records
from areagrade.sources.tables import read_table
from areagrade.workload import bindings as b

Query = Callable[[SparkSession, str], DataFrame]

# --- statistics per area ------------------------------------------------------


def _sums_by_area(spark: SparkSession, sf: str, lines: DataFrame, sums, count: str | None = None) -> DataFrame:
    return rolled_up_sums(lines, "s_suppkey", b.suppliers(spark, sf), ["area"], sums, count)


def incident_measures(spark: SparkSession, sf: str) -> DataFrame:
    sums = {"vehicles": filled_count(F.col(name) for name in b.VEHICLES)}
    sums |= {name: F.col(name) for name in CASUALTY_COLUMNS}
    return _sums_by_area(spark, sf, b.incident_lines(spark, sf, with_factors=False), sums, "incidents")


def slot_occupancy(spark: SparkSession, sf: str) -> DataFrame:
    slots = {"factors": b.FACTORS, "vehicles": b.VEHICLES}
    sums = {name: filled_count(F.col(slot) for slot in columns) for name, columns in slots.items()}
    return _sums_by_area(spark, sf, b.incident_lines(spark, sf), sums)


def casualty_shares(spark: SparkSession, sf: str) -> DataFrame:
    lines = b.incident_lines(spark, sf, with_factors=False, with_vehicles=False)
    sums = _sums_by_area(spark, sf, lines, {name: F.col(name) for name in CASUALTY_COLUMNS})
    shares = {}
    for total, parts in CASUALTY_PARTS.items():
        shares |= share_columns(f"persons_{total}", parts) | share_labels(f"persons_{total}", parts)
    return sums.withColumns(shares)


def type_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return category_frequency(b.incidents(spark, sf, with_factors=False), ["area"], {"vehicle": b.VEHICLES})


def factor_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return category_frequency(b.incidents(spark, sf, with_vehicles=False), ["area"], {"factor": b.FACTORS})


def all_category_totals(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"factor": b.FACTORS, "vehicle": b.VEHICLES}
    return category_totals(b.incidents(spark, sf), kinds)


def category_totals_two_level(spark: SparkSession, sf: str) -> DataFrame:
    return two_level_totals(factor_frequency(spark, sf), "area")


def _top_with_shares(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Tiered top categories of one kind with their share of all vehicles."""
    sums = {"vehicles": filled_count(F.col(name) for name in b.VEHICLES)}
    kinds = {"vehicle": b.VEHICLES} if kind == "vehicle" else {"factor": b.FACTORS}
    records = b.incidents(spark, sf, with_factors=kind == "factor")
    profile = category_profile(records, ["area"], kinds, sums)
    slots = tiered_slots(profile, ["area"], {kind: TIERS_FIVE}, sums=["vehicles"])
    return spread_slots(slots, {kind: 5}, {kind: "vehicles"}).drop("records")


def top_types_tiered(spark: SparkSession, sf: str) -> DataFrame:
    return _top_with_shares(spark, sf, "vehicle")


def top_factors_tiered(spark: SparkSession, sf: str) -> DataFrame:
    return _top_with_shares(spark, sf, "factor")


def top_types_long(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranking kept long, with one type ignored."""
    return tiered_top(type_frequency(spark, sf), ["area"], TIERS_FIVE, ignored=["PROMO"])


def _tier_case(spark: SparkSession, sf: str, records: DataFrame, column: str) -> DataFrame:
    profile = category_profile(records, ["area"], {"status": [column]})
    slots = tiered_slots(profile, ["area"], {"status": TIERS_FIVE})
    return spread_slots(slots, {"status": 5}, {"status": "records"})


def tier_one_only(spark: SparkSession, sf: str) -> DataFrame:
    lines = read_table(spark, sf, "lineitem")
    records = lines.join(b.suppliers(spark, sf), F.col("l_suppkey") == F.col("s_suppkey"))
    return _tier_case(spark, sf, records, "l_linestatus")


def tier_three(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders")
    records = orders.join(b.customers(spark, sf), F.col("o_custkey") == F.col("c_custkey"))
    return _tier_case(spark, sf, records, "o_orderstatus")


def modal_city(spark: SparkSession, sf: str) -> DataFrame:
    freq = category_frequency(b.request_counts(spark, sf), ["area"], {"city": ["city"]}, weight="weight")
    return modal_value(freq.select("area", F.col("category").alias("city"), "n"), ["area"], "city")


def incident_stats_by_area(spark: SparkSession, sf: str) -> DataFrame:
    return incident_stats(_incident_profile(spark, sf))


def incident_totals_list(spark: SparkSession, sf: str) -> DataFrame:
    return incident_totals(_incident_profile(spark, sf))


def stored_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Incident statistics from profiles that were stored batch by batch, one batch twice."""
    kept = ProfileTable(spark, scratch_path(spark, "profiles"), ["n", *INCIDENT_SUMS])
    records = b.incidents(spark, sf)
    kept.add("N", incident_profile(records.where("factor_2 = 'A'"), b.FACTORS, b.VEHICLES))
    for flag in ("A", "N", "R"):
        kept.add(flag, incident_profile(records.where(F.col("factor_2") == flag), b.FACTORS, b.VEHICLES))
    return incident_stats(kept.read())


def request_stats_by_area(spark: SparkSession, sf: str) -> DataFrame:
    return request_stats(request_profile(b.requests(spark, sf), weight="weight"))


def request_totals_list(spark: SparkSession, sf: str) -> DataFrame:
    return request_totals(request_profile(b.requests(spark, sf), weight="weight"))


def _incident_profile(spark: SparkSession, sf: str) -> DataFrame:
    return incident_profile(b.incidents(spark, sf), b.FACTORS, b.VEHICLES)


# --- exposure -------------------------------------------------------------------


def annual_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return ratio_over_period(b.volumes(spark, sf), ["area"], "volume", "samples", WINDOW_DAYS, "exposure")


def split_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's cell names its customer and its clerk's status in one of four ways."""
    orders = read_table(spark, sf, "orders")
    first, second = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    cell = (
        F.when(F.col("o_orderstatus") == "F", F.concat(first, F.lit(";"), second))
        .when(F.col("o_orderstatus") == "O", F.concat(first, F.lit(": "), second))
        .when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("NY "), first))
        .otherwise(first)
    )
    cells = orders.select(
        cell.alias("area"),
        F.floor("o_totalprice").cast("bigint").alias("volume"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("samples"),
    )
    return split_area_cells(cells, drop_mark="NY")


def segment_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return exposure_plan.segment_volume(b.segment_counts(spark, sf), b.SEGMENT_HOURS, b.SEGMENT_ORDER)


def first_line_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup on typed columns: first line's flags, quantity and lines per order."""
    lines = read_table(spark, sf, "lineitem").withColumn("volume", F.col("l_quantity").cast("bigint"))
    return first_record_rollup(lines, "l_orderkey", b.SEGMENT_ORDER, ["l_returnflag", "l_linestatus"], "volume")


def wide_numeric_sum(spark: SparkSession, sf: str) -> DataFrame:
    counts = b.segment_counts(spark, sf)
    # Cells of every second segment are padded with zeros to more digits than a number holds.
    padded = F.col("segment_id").cast("bigint") % 2 == 0
    whole = (F.col(name).rlike("^[0-9]+$") for name in b.SEGMENT_HOURS)
    cells = [F.when(padded & w, F.lpad(name, 22, "0")).otherwise(F.col(name)) for name, w in zip(b.SEGMENT_HOURS, whole)]
    return counts.select("segment_id", wide_sum(cells).alias("volume"))


def street_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part")
    size = F.col("p_size")
    west = F.when(size == 1, F.lit("AVE OF THE AMER")).otherwise(
        F.concat(F.lit("WEST "), size.cast("string"), F.lit(" ST"))
    )
    east = F.concat(F.lit("E "), (size + 90).cast("string"), F.lit(" ST & "), size.cast("string"), F.lit(" AVE"))
    return part.select(
        "p_partkey",
        ordinal_street(west, STREET_ALIASES).alias("west"),
        ordinal_street(east, STREET_ALIASES).alias("east"),
    )


def _named_three_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with the nation of the customer, the nation of the supplier and a number as areas."""
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    supplier = read_table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    # Orders meet their customers first, so that the lines are shuffled for two joins and not three.
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return (
        read_table(spark, sf, "lineitem")
        .join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "l_orderkey",
            F.col("c_nationkey").alias("a"),
            F.col("s_nationkey").alias("b"),
            F.col("l_quantity").cast("int").alias("c"),
            F.floor(F.col("l_quantity") * 10).cast("bigint").alias("volume"),
            F.col("l_linenumber").cast("bigint").alias("samples"),
        )
    )


def three_way_apportion(spark: SparkSession, sf: str) -> DataFrame:
    return apportion_by_position(_named_three_ways(spark, sf), ("a", "b", "c"), ("volume", "samples"))


def three_way_apportion_exact(spark: SparkSession, sf: str) -> DataFrame:
    records = _named_three_ways(spark, sf).drop("samples")
    return apportion_by_position(records, ("a", "b", "c"), ("volume",), exact=True)


def location_lookup(spark: SparkSession, sf: str) -> DataFrame:
    gazetteer = one_area_per_street(b.gazetteer(spark, sf))
    streets = {"roadway": "roadway_area", "from_street": "from_area", "to_street": "to_area"}
    records = b.segment_counts(spark, sf).select("segment_id", *streets)
    return resolve_areas(records, gazetteer, streets)


def _area_volume(spark: SparkSession, sf: str) -> DataFrame:
    gazetteer = b.gazetteer(spark, sf).withColumn("street", ordinal_street(F.col("street")))
    return exposure_plan.area_volume(segment_rollup(spark, sf), gazetteer)


def area_volume(spark: SparkSession, sf: str) -> DataFrame:
    return _area_volume(spark, sf)


def street_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return exposure_plan.annual_exposure(_area_volume(spark, sf))


# --- cleaning and sources ---------------------------------------------------------


def date_window(spark: SparkSession, sf: str) -> DataFrame:
    window = in_window(F.col("o_orderdate"), datetime(1996, 1, 1), datetime(1997, 12, 31, 23, 59))
    orders = read_table(spark, sf, "orders")
    return orders.filter(window & is_filled(F.col("o_orderstatus"))).select(
        "o_orderkey", "o_orderdate", "o_orderstatus"
    )


def parse_or_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Times written as quantity:line; quantities of 24 and more are no hour."""
    lines = read_table(spark, sf, "lineitem")
    date = F.date_format("l_shipdate", "MM/dd/yyyy")
    hour = F.col("l_quantity").cast("int").cast("string")
    time = F.concat(hour, F.lit(":"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"))
    timed = with_parsed_time(lines, [date, time], ["MM/dd/yyyy H:mm"])
    return timed.select("l_orderkey", "l_linenumber", "moment")


PREPARED_INCIDENTS = (datetime(1996, 1, 1), datetime(1998, 12, 31, 23, 59))
PREPARED_REQUESTS = (datetime(2024, 1, 5), datetime(2024, 1, 20, 12, 0))


def prepared_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as raw incident records: dates as text in two formats, some hours that are
    none, some blank areas; prepared as the incident job does."""
    key, line = F.col("l_suppkey"), F.col("l_linenumber")
    us, iso = F.date_format("l_shipdate", "MM/dd/yyyy"), F.date_format("l_shipdate", "yyyy-MM-dd")
    columns = {
        "area": F.when(key % 10 == 0, F.lit("  ")).otherwise(key.cast("string")),
        "date": F.when(F.col("l_orderkey") % 2 == 0, us).otherwise(iso),
        "time": F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(":"), F.lpad(line.cast("string"), 2, "0")),
    }
    columns |= {name: ((line + i) % 3).cast("int") for i, name in enumerate(CASUALTY_COLUMNS)}
    columns |= {name: F.concat("l_returnflag", F.lit(str(i))) for i, name in enumerate(FACTOR_COLUMNS)}
    columns |= {name: F.concat("l_linestatus", F.lit(str(i))) for i, name in enumerate(VEHICLE_COLUMNS)}
    records = read_table(spark, sf, "lineitem").select(*(value.alias(name) for name, value in columns.items()))
    return prepare_incidents(records, *PREPARED_INCIDENTS)


def prepared_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw requests: times as text in all six formats or none, other subjects and
    blank places among them; prepared as the request job does."""
    event = F.col("event_id")
    created = F.lit("someday")
    for i, fmt in enumerate(REQUEST_TIME_FORMATS):
        created = F.when(event % 7 == i, F.date_format("ts", fmt.replace("[.SSS]", ".SSS"))).otherwise(created)
    subject = F.when(event % 3 == 0, " Street").when(event % 3 == 1, " Street Noise").otherwise(" Road")
    records = read_table(spark, sf, "events").select(
        created.alias("created_at"),
        F.concat("event_type", subject).alias("category"),
        F.col("props").alias("descriptor"),
        F.when(event % 13 != 0, F.col("user_id").cast("string")).alias("area"),
        F.when(event % 11 == 0, F.lit(" ")).otherwise(F.concat(F.lit("City "), F.col("user_id") % 5)).alias("city"),
    )
    return prepare_requests(records, *PREPARED_REQUESTS)


def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part")
    return part.filter(keyword_match(F.col("p_name"), "r", "red")).select(
        "p_partkey", F.upper("p_name").alias("upper_name"), capitalised(F.upper("p_name")).alias("plain_name")
    )


def key_normalise(spark: SparkSession, sf: str) -> DataFrame:
    customer = read_table(spark, sf, "customer")
    raw = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "))
    padded = area_key(raw)
    return customer.select("c_custkey", padded.alias("area"), numeric_key(padded).alias("number")).withColumn(
        "name_number", numeric_key(F.col("area").substr(F.lit(2), F.lit(9)))
    )


def _naive_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Comma-joined part rows in which some names hold one to five commas, split without regard to them."""
    part = read_table(spark, sf, "part")
    name = (
        F.when(F.col("p_type") == "PROMO", F.translate("p_name", " ", ","))
        .when(F.col("p_type") == "LARGE", F.concat(F.translate("p_name", " ", ","), F.lit(",extra")))
        .when(F.col("p_type") == "SMALL", F.concat(F.translate("p_name", " ", ","), F.lit(",a,b,c,d")))
        .otherwise(F.col("p_name"))
    )
    line = F.concat_ws(",", F.col("p_partkey"), F.col("p_type"), name, F.col("p_brand"), F.col("p_size"), F.lit("end"))
    return part.select("p_partkey", F.split(line, ",").alias("cells"))


def fallback_projection(spark: SparkSession, sf: str) -> DataFrame:
    columns = realign_by_number(F.col("cells"), text_at=2, number_at=4, others={"last": 5, "brand": 3})
    return _naive_cells(spark, sf).select("p_partkey", *(value.alias(name) for name, value in columns.items()))


def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = _naive_cells(spark, sf).select("p_partkey", merge_surplus_cells(F.col("cells"), 6, 2).alias("cells"))
    names = ("partkey", "type", "name", "brand", "size", "last")
    return cells.select("p_partkey", *(F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)))


def case_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Types and brands in one column, told apart by their letter case; one type ignored."""
    part = read_table(spark, sf, "part")
    both = part.select("p_partkey", "p_type", "p_brand").unpivot(
        ["p_partkey"], ["p_type", "p_brand"], "origin", "category"
    )
    kept = both.filter(not_ignored(F.col("category"), ["PROMO"]))
    kind = kind_by_case(F.col("category"), "vehicle", "factor")
    return kept.groupBy(kind.alias("kind"), "category").agg(F.count(F.lit(1)).alias("n"))


def _customer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as delimited lines, one header line per nation among them. Names hold a comma and quotes; names of customers in debt are left
    unquoted and so break their line."""
    customer = read_table(spark, sf, "customer")
    name = F.concat(F.col("c_name"), F.lit(', "'), F.col("c_mktsegment"), F.lit('"'))
    quoted = F.concat(F.lit('"'), F.regexp_replace(name, '"', '""'), F.lit('"'))
    cell = F.when(F.col("c_acctbal") < 0, name).otherwise(quoted)
    balance = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), cell, F.col("c_nationkey").cast("string"), balance)
    header = F.lit(",".join(DELIMITED.fieldNames()))
    headers = read_table(spark, sf, "nation").select(header.alias("line"))
    return customer.select(line.alias("line")).unionByName(headers)


def _delimited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return parse_lines(drop_header_lines(_customer_lines(spark, sf), "line", "custkey"), "line", DELIMITED)


DELIMITED = StructType(
    [
        StructField("custkey", LongType()),
        StructField("name", StringType()),
        StructField("nationkey", IntegerType()),
        StructField("balance", DoubleType()),
    ]
)


def delimited_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _delimited(spark, sf)[0]


def delimited_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return _delimited(spark, sf)[1]


def _staged_customers(spark: SparkSession, sf: str) -> Staged:
    """The same lines as files, read once; customers of every fifth nation are refused by a check."""
    path = scratch_path(spark, "customers-lines")
    write_report(_customer_lines(spark, sf), path, fmt="text")
    return stage_records(spark, path, DELIMITED, header=False, checks={"nation": F.col("nationkey") % 5 > 0})


def staged_records(spark: SparkSession, sf: str) -> DataFrame:
    with _staged_customers(spark, sf) as staged:
        return materialise(staged.records)


def staged_rejects(spark: SparkSession, sf: str) -> DataFrame:
    with _staged_customers(spark, sf) as staged:
        both = [staged.rejects(reason).withColumn("reason", F.lit(reason)) for reason in ("parse", "nation")]
        return materialise(both[0].unionByName(both[1]))


def file_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in files of three columns, suppliers in files of four, read together by position."""
    customer = read_table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    supplier = read_table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    paths = [scratch_path(spark, "customers-csv"), scratch_path(spark, "suppliers-csv")]
    for df, path in zip((customer, supplier), paths):
        write_report(df, path)
    with stage_positions(spark, paths, {"key": 0, "name": 1, "nation": 2}) as staged:
        return materialise(staged.records)


def multiline_records(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose names hold line breaks, commas and quotes, written as CSV and read back."""
    customer = read_table(spark, sf, "customer")
    name = F.concat("c_name", F.lit(',\n"'), "c_mktsegment", F.lit('"\nend'))
    path = scratch_path(spark, "customers-csv")
    write_report(customer.select(F.col("c_custkey").alias("custkey"), name.alias("name"), "c_nationkey", "c_acctbal"), path)
    with stage_records(spark, path, DELIMITED, multiline=True) as staged:
        return materialise(staged.records)


def ordered_totals(spark: SparkSession, sf: str) -> DataFrame:
    """All category totals written in order, over as many files as that takes, and numbered as they are read."""
    totals = all_category_totals(spark, sf)
    path = scratch_path(spark, "totals-csv")
    write_ordered(totals, path, [F.desc("n"), "kind", "category"])
    return read_ordered(spark, path, totals.schema)


def published_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Two reports published as a set, found by its manifest and read back."""
    folder = scratch_path(spark, "reports")
    frequencies = {"types": type_frequency(spark, sf), "factors": factor_frequency(spark, sf)}
    with ReportSet(spark, f"{folder}/manifest") as reports:
        for name, df in frequencies.items():
            reports.write(df, f"{folder}/{name}", fmt="parquet")
    names = [path.rpartition("/")[2] for path in read_manifest(spark, f"{folder}/manifest")]
    read = [spark.read.parquet(f"{folder}/{name}").withColumn("report", F.lit(name)) for name in names]
    return read[0].unionByName(read[1])


def sampled_scan(spark: SparkSession, sf: str) -> DataFrame:
    return sampled(read_table(spark, sf, "lineitem"), 0.05, ["l_orderkey", "l_linenumber"], seed=7)


def csv_sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    records = delimited_lines(spark, sf)
    path = scratch_path(spark, "customers-csv")
    write_report(records, path)
    return read_delimited(spark, path, records.schema)


def json_sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    records = incident_measures(spark, sf)
    path = scratch_path(spark, "measures-json")
    write_report(records, path, fmt="json")
    return spark.read.json(path, schema=records.schema)


def text_reexport(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events")
    lines = events.select(F.concat_ws("|", "event_id", "user_id", "event_type", "props").alias("line"))
    path = scratch_path(spark, "events-text")
    write_report(lines, path, fmt="text")
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- scorecard ----------------------------------------------------------------------


def rates(spark: SparkSession, sf: str) -> DataFrame:
    measures = incident_measures(spark, sf).select(
        "area",
        "incidents",
        "vehicles",
        F.col("persons_injured").alias("injured"),
        F.col("persons_killed").alias("killed"),
    )
    asked = keyed_sums(b.request_counts(spark, sf), ["area"], {"requests": F.col("weight")})
    return with_rates(join_areas(annual_exposure(spark, sf), measures, asked), b.RATE_SCALE)


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return metric_summary(rates(spark, sf), digits=6)


def summary_report(spark: SparkSession, sf: str) -> DataFrame:
    return renamed(summary(spark, sf), SUMMARY_NAMES)


def bounds(spark: SparkSession, sf: str) -> DataFrame:
    return sigma_bounds(rates(spark, sf), bands=(1, 2, 3))


def rating(spark: SparkSession, sf: str) -> DataFrame:
    return with_rating(materialise(rates(spark, sf))).select("area", "rating", *RATE_COLUMNS)


def rating_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Some areas have no samples and so no incident rate: they get no rating, the others as ever."""
    known = F.when(~F.col("area").like("%1"), F.col("incident_rate"))
    return with_rating(materialise(rates(spark, sf).withColumn("incident_rate", known))).select("area", "rating", *RATE_COLUMNS)


def _card(spark: SparkSession, sf: str) -> DataFrame:
    exposure = exposure_plan.annual_exposure(b.volumes(spark, sf))
    return scorecard(exposure, incident_stats_by_area(spark, sf), request_stats_by_area(spark, sf), b.RATE_SCALE)


def flagship_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    return rated_scorecard(materialise(_card(spark, sf)))


def scorecard_report(spark: SparkSession, sf: str) -> DataFrame:
    """The rated scorecard under its report names."""
    return renamed(flagship_scorecard(spark, sf), RATED_NAMES)


def named_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """The unrated scorecard: 27 columns of declared types under their report names."""
    return renamed(_card(spark, sf), SCORECARD_NAMES)


def _extreme(metric: str, pick: Callable[..., DataFrame]) -> Query:
    return lambda spark, sf: pick(rates(spark, sf), metric, 10)


QUERIES: dict[str, Query] = {
    "flagship_scorecard": flagship_scorecard,
    "scorecard_report": scorecard_report,
    "named_scorecard": named_scorecard,
    "incident_stats": incident_stats_by_area,
    "incident_totals": incident_totals_list,
    "stored_profiles": stored_profiles,
    "request_stats": request_stats_by_area,
    "request_totals": request_totals_list,
    "incident_measures": incident_measures,
    "slot_occupancy": slot_occupancy,
    "casualty_shares": casualty_shares,
    "type_frequency": type_frequency,
    "factor_frequency": factor_frequency,
    "category_totals": all_category_totals,
    "category_totals_two_level": category_totals_two_level,
    "top_types_tiered": top_types_tiered,
    "top_factors_tiered": top_factors_tiered,
    "top_types_long": top_types_long,
    "tier_one_only": tier_one_only,
    "tier_three": tier_three,
    "modal_city": modal_city,
    "annual_exposure": annual_exposure,
    "split_cells": split_cells,
    "segment_rollup": segment_rollup,
    "first_line_rollup": first_line_rollup,
    "wide_numeric_sum": wide_numeric_sum,
    "street_ordinals": street_ordinals,
    "three_way_apportion": three_way_apportion,
    "three_way_apportion_exact": three_way_apportion_exact,
    "location_lookup": location_lookup,
    "area_volume": area_volume,
    "street_exposure": street_exposure,
    "date_window": date_window,
    "parse_or_drop": parse_or_drop,
    "prepared_incidents": prepared_incidents,
    "prepared_requests": prepared_requests,
    "keyword_filter": keyword_filter,
    "key_normalise": key_normalise,
    "fallback_projection": fallback_projection,
    "merged_cells": merged_cells,
    "case_kind": case_kind,
    "delimited_lines": delimited_lines,
    "delimited_rejects": delimited_rejects,
    "staged_records": staged_records,
    "staged_rejects": staged_rejects,
    "file_widths": file_widths,
    "multiline_records": multiline_records,
    "ordered_totals": ordered_totals,
    "published_reports": published_reports,
    "sampled_scan": sampled_scan,
    "csv_sink_roundtrip": csv_sink_roundtrip,
    "json_sink_roundtrip": json_sink_roundtrip,
    "text_reexport": text_reexport,
    "rates": rates,
    "metric_summary": summary,
    "summary_report": summary_report,
    "sigma_bounds": bounds,
    "rating": rating,
    "rating_unknown": rating_unknown,
    **{f"top_k_{metric}": _extreme(metric, top_k) for metric in RATE_COLUMNS},
    **{f"bottom_k_{metric}": _extreme(metric, bottom_k) for metric in RATE_COLUMNS},
}
