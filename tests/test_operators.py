import pytest
from pyspark.sql import functions as F

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
    profile_totals,
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
from areagrade.operators.ranking import bottom_k, rank_limit, spread_slots, tiered_slots, tiered_top, top_k
from areagrade.operators.profiles import ProfileTable
from areagrade.operators.scorecard import exact_moments, join_areas, metric_summary, renamed, sigma_bounds, with_rates, with_rating
from areagrade.schemas import TIER_ONE, TIERS_FIVE, TIERS_THREE
from tests.conftest import tuples

SLOTS = "area string, a string, b string, hurt int"


@pytest.fixture(scope="module")
def records(frame):
    return frame(
        SLOTS,
        ("x", "VAN ", "BUS", 1),
        ("x", "VAN", "", 0),
        ("x", None, "VAN", 2),
        ("y", None, None, 5),
        ("y", "  ", "BUS", 0),
    )


def test_category_frequency_counts_filled_slots(records):
    freq = category_frequency(records, ["area"], {"v": ["a", "b"]})
    assert tuples(freq) == [("x", "v", "BUS", 1), ("x", "v", "VAN", 3), ("y", "v", "BUS", 1)]


def test_category_frequency_keeps_kinds_apart(records):
    freq = category_frequency(records, [], {"first": ["a"], "second": ["b"]})
    assert tuples(freq) == [("first", "VAN", 2), ("second", "BUS", 2), ("second", "VAN", 1)]


def test_weighted_equals_repeated(frame, records):
    repeated = records.unionByName(records).unionByName(records)
    weighted = records.withColumn("w", F.lit(3))
    kinds = {"v": ["a", "b"]}
    assert tuples(category_frequency(weighted, ["area"], kinds, "w")) == tuples(
        category_frequency(repeated, ["area"], kinds)
    )


def test_category_profile_has_one_total_row_per_key(records):
    profile = category_profile(records, ["area"], {"v": ["a", "b"]}, {"hurt": F.col("hurt")})
    totals = profile.filter("kind = 'total'").select("area", "category", "n", "hurt")
    assert tuples(totals) == [("x", None, 3, 3), ("y", None, 2, 5)]
    rest = profile.filter("kind <> 'total'").select("area", "kind", "category", "n")
    assert tuples(rest) == tuples(category_frequency(records, ["area"], {"v": ["a", "b"]}))


def test_totals(records):
    freq = category_frequency(records, ["area"], {"v": ["a", "b"]})
    listed = category_totals(records, {"v": ["a", "b"]})
    assert [tuple(r) for r in listed.collect()] == [("v", "VAN", 3), ("v", "BUS", 2)]
    assert set(tuples(two_level_totals(freq, "area"))) == {
        (None, "BUS", 2),
        (None, "VAN", 3),
        ("x", "BUS", 1),
        ("x", "VAN", 3),
        ("y", "BUS", 1),
    }


def test_profile_totals_list_metrics_and_categories(records):
    profile = category_profile(records, ["area"], {"v": ["a", "b"]}, {"hurt": F.col("hurt")})
    assert [tuple(r) for r in profile_totals(profile, "records", ["hurt"]).collect()] == [
        ("metric", "hurt", 8),
        ("metric", "records", 5),
        ("v", "VAN", 3),
        ("v", "BUS", 2),
    ]


def _freq(frame, counts):
    rows = [(area, "v", f"c{i}", n) for area, ns in counts.items() for i, n in enumerate(ns)]
    return frame("area string, kind string, category string, n bigint", *rows)


@pytest.mark.parametrize(
    ("found", "five", "three", "one"),
    [(0, 0, 0, 0), (1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 3, 1), (4, 3, 3, 1), (5, 5, 3, 1), (9, 5, 3, 1)],
)
def test_tiers(frame, found, five, three, one):
    freq = _freq(frame, {"x": range(20, 20 - found, -1), "other": [1]})
    for tiers, expected in ((TIERS_FIVE, five), (TIERS_THREE, three), (TIER_ONE, one)):
        kept = tiered_top(freq, ["area"], tiers).filter("area = 'x'").orderBy("rank")
        assert [tuple(r) for r in kept.collect()] == [("x", i + 1, f"c{i}", 20 - i) for i in range(expected)]


def test_rank_limit_covers_thresholds_and_sizes():
    assert rank_limit(TIERS_FIVE) == 5 and rank_limit(TIERS_THREE) == 3 and rank_limit(((10, 2),)) == 10


def test_ties_are_broken_by_category(frame):
    freq = _freq(frame, {"x": [3, 7, 7, 1]})
    assert [r.category for r in tiered_top(freq, ["area"], TIERS_FIVE).orderBy("rank").collect()] == ["c1", "c2", "c0"]


def test_ignored_categories_do_not_count_for_the_tier(frame):
    freq = _freq(frame, {"x": [9, 5, 4]})
    kept = tiered_top(freq, ["area"], TIERS_FIVE, ignored=["c0"])
    assert tuples(kept) == [("x", 1, "c1", 5)]


def test_slots_of_several_kinds(frame):
    df = frame(
        "area string, v1 string, v2 string, f string",
        ("x", "VAN", "BUS", "Fog"),
        ("x", "VAN", "TAXI", "UNKNOWN"),
        ("y", None, "", None),
    )
    profile = category_profile(df, ["area"], {"vehicle": ["v1", "v2"], "factor": ["f"]}, {"seen": F.lit(2)})
    slots = tiered_slots(
        profile,
        ["area"],
        {"vehicle": TIERS_FIVE, "factor": TIERS_FIVE},
        sums=["seen"],
        ignored=["UNKNOWN"],
    )
    spread = spread_slots(slots, {"vehicle": 3, "factor": 2}, {"vehicle": "seen", "factor": "records"})
    assert spread.columns == [
        "area", "records", "seen", "vehicle_1", "vehicle_2", "vehicle_3", "factor_1", "factor_2"
    ]
    assert tuples(spread) == [
        ("x", 2, 4, "VAN: 2: 50.0%", "BUS: 1: 25.0%", "TAXI: 1: 25.0%", "Fog: 1: 50.0%", ""),
        ("y", 1, 2, "", "", "", "", ""),
    ]


def test_modal_value_ties_by_name(frame):
    freq = frame(
        "area string, city string, n bigint", ("x", "B", 2), ("x", "A", 2), ("x", "C", 1), ("y", "Z", 1), ("y", "Q", 4)
    )
    assert tuples(modal_value(freq, ["area"], "city")) == [("x", "A"), ("y", "Q")]


def test_first_record_rollup(frame):
    df = frame(
        "seg string, id int, roadway string, volume bigint",
        ("s", 3, "C", 10),
        ("s", 1, "B", 20),
        ("s", 1, "A", 30),
        ("t", 9, None, 1),
    )
    rolled = first_record_rollup(df, "seg", ["id"], ["roadway"], "volume")
    assert tuples(rolled) == [("s", "A", 60, 3), ("t", None, 1, 1)]


@pytest.mark.parametrize("kind", ["int", "string", "decimal(30,2)", "date", "timestamp", "boolean", "double", "binary"])
def test_first_record_equals_the_least_of_all(spark, kind):
    """Against a minimum over whole records, NULLs and ties among them, for every kind of first order column."""
    texts = ["", "a", "a\0", "ab", "é", "a" * 15, "a" * 15 + "b", "a" * 15 + "\0", "a" * 16, "b" * 40, "~", "日本語日本語", "10", "9"]
    number = F.pmod(F.xxhash64("id"), F.lit(len(texts)))
    text = F.get(F.array(*map(F.lit, texts)), number.cast("int"))
    of_kind = {
        "string": text,
        "binary": F.encode(text, "UTF-8"),
        "date": F.date_add(F.lit("2024-01-01").cast("date"), number.cast("int")),
        "timestamp": F.timestamp_seconds(number),
        "boolean": number % 2 == 0,
    }
    first = F.when(F.col("id") % 11 != 0, of_kind[kind] if kind in of_kind else (number - 3).cast(kind))
    df = spark.range(900).select(
        F.when(F.col("id") % 17 != 0, F.col("id") % 60).alias("seg"),
        first.alias("rank"),
        F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3))).alias("second"),
        F.when(F.col("id") % 7 != 0, F.concat(F.lit("r"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)))).alias("roadway"),
        (F.col("id") + 1).alias("volume"),
    )
    least = F.min(F.struct("rank", "second", "roadway")).alias("m")
    want = df.groupBy("seg").agg(least, F.sum("volume"), F.count("*")).select("seg", "m.roadway", "sum(volume)", "count(1)")
    assert tuples(first_record_rollup(df.repartition(5), "seg", ["rank", "second"], ["roadway"], "volume")) == tuples(want)


def test_ratio_over_period_truncates_and_guards(frame):
    df = frame("area string, v bigint, s bigint", ("x", 10, 3), ("x", 9, 3), ("y", 5, 0), ("z", 7, 7))
    assert tuples(ratio_over_period(df, ["area"], "v", "s", 731)) == [("x", 3 * 731), ("y", None), ("z", 731)]


def test_keyed_sums_and_shares(frame):
    df = frame("area string, hurt int, foot int", ("x", 4, 1), ("x", 0, 0), ("y", 0, 0))
    sums = keyed_sums(df, ["area"], {"hurt": F.col("hurt"), "foot": F.col("foot")}, count="n")
    assert tuples(sums) == [("x", 2, 4, 1), ("y", 1, 0, 0)]
    columns = share_columns("hurt", ["foot"]) | share_labels("hurt", ["foot"])
    shares = sums.select("area", *(column.alias(name) for name, column in columns.items()))
    assert tuples(shares) == [("x", 25.0, "1: 25.0%"), ("y", 0.0, "0: 0.0%")]


def test_rolled_up_sums_equal_sums_after_the_join(frame):
    df = frame("fk int, v int", (1, 5), (1, 6), (2, 7), (3, 100), (None, 9))
    dimension = frame("fk int, area string", (1, "x"), (2, "x"), (4, "y"))
    rolled = rolled_up_sums(df, "fk", dimension, ["area"], {"v": F.col("v"), "w": F.col("v") * 2}, count="n")
    assert tuples(rolled) == [("x", 3, 18, 36)]
    joined = keyed_sums(df.join(dimension, "fk"), ["area"], {"v": F.col("v"), "w": F.col("v") * 2}, count="n")
    assert tuples(rolled) == tuples(joined)


CELLS = {
    ("11220;11204", 39295, 7): [("11220", 19647, 3), ("11204", 19647, 3)],
    ("11218; 11232", 19466, 6): [("11218", 9733, 3), ("11232", 9733, 3)],
    ("10309:10312", 45001, 1): [("10309", 22500, 0), ("10312", 22500, 0)],
    ("10001", 7, 1): [("10001", 7, 1)],
    (" 10002 ", 8, 2): [("10002", 8, 2)],
    ("1;2:3", 10, 3): [("1", 3, 1), ("2", 3, 1), ("3", 3, 1)],
    ("4;", 10, 3): [("4", 10, 3)],
    ("NY 10026", 12496, 6): [],
}


def test_split_area_cells(frame):
    df = frame("area string, volume bigint, samples bigint", *CELLS)
    expected = sorted((row for rows in CELLS.values() for row in rows), key=repr)
    assert tuples(split_area_cells(df, drop_mark="NY")) == expected


APPORTIONED = {
    ("a", "a", "a"): [("a", 100, 7)],
    ("a", "a", "b"): [("a", 66, 4), ("b", 33, 2)],
    ("a", "b", "a"): [("a", 66, 4), ("b", 33, 2)],
    ("b", "a", "a"): [("a", 66, 4), ("b", 33, 2)],
    ("a", "b", "c"): [("a", 33, 2), ("b", 33, 2), ("c", 33, 2)],
}


@pytest.mark.parametrize("areas", APPORTIONED)
def test_apportion_three_ways(frame, areas):
    df = frame("id int, p string, q string, r string, v bigint, s bigint", (1, *areas, 100, 7))
    got = tuples(apportion_by_position(df, ("p", "q", "r"), ("v", "s")))
    assert got == [(1, *row) for row in APPORTIONED[areas]]


def test_apportion_never_exceeds_the_input(spark):
    df = spark.range(500).selectExpr(
        "id", "id % 3 as p", "id % 4 as q", "id % 5 as r", "(id * 37) % 101 as v", "id % 4 as s"
    )
    spread = apportion_by_position(df, ("p", "q", "r"), ("v", "s")).groupBy("id").agg(
        F.sum("v").alias("v2"), F.sum("s").alias("s2")
    )
    joined = df.join(spread, "id")
    assert joined.count() == 500
    assert joined.filter("v2 > v or v - v2 > 2 or s2 > s").count() == 0


def test_exact_shares_add_up(frame):
    rows = [("a", "a", "b", 100), ("a", "b", "c", 100), ("c", "c", "c", 100)]
    df = frame("p string, q string, r string, v bigint", *rows)
    got = tuples(apportion_by_position(df, ("p", "q", "r"), ("v",), exact=True))
    assert [area for area, _ in got] == ["a", "a", "b", "b", "c", "c"]
    assert sum(v for _, v in got) == pytest.approx(300) and ("a", pytest.approx(200 / 3)) in got
    cells = frame("area string, volume bigint, samples bigint", ("x;y", 5, 3))
    assert tuples(split_area_cells(cells, exact=True)) == [("x", 2.5, 1.5), ("y", 2.5, 1.5)]


def test_apportion_two_ways(frame):
    df = frame("p string, q string, v bigint", ("a", "b", 7), ("a", "a", 7))
    assert tuples(apportion_by_position(df, ("p", "q"), ("v",))) == [("a", 3), ("a", 7), ("b", 3)]


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_lookup_drops_misses_whatever_the_join(spark, frame, threshold):
    gazetteer = frame("street string, area string", ("A", "1"), ("B", "2"), ("B", "0"), ("", "9"), ("?", None))
    df = frame("id int, f string, t string", (1, "A", "B"), (2, "A", "?"), (3, None, "A"), (4, "B", "B"), (5, "", "A"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = resolve_areas(df, one_area_per_street(gazetteer), {"f": "fa", "t": "ta"})
        assert tuples(found.select("id", "fa", "ta")) == [(1, "1", "0"), (4, "0", "0")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


CARD = "area string, incident_rate double, injury_rate double, death_rate double, vehicles_per_incident double"


def test_join_keeps_common_areas(frame):
    a, b = frame("area string, x int", ("1", 1), ("2", 2)), frame("area string, y int", ("2", 3), ("3", 4))
    c = frame("area string, z int", ("2", 5))
    assert tuples(join_areas(a, b, c)) == [("2", 2, 3, 5)]


def test_rates_round_and_guard(frame):
    df = frame(
        "incidents bigint, injured bigint, killed bigint, vehicles bigint, exposure bigint",
        (583, 233, 3, 1171, 731_000),
        (1, 0, 0, 0, 0),
    )
    got = with_rates(df).select("incident_rate", "injury_rate", "death_rate", "vehicles_per_incident").collect()
    assert [tuple(r) for r in got] == [(0.8, 399.66, 5.15, 2.01), (None, 0.0, 0.0, 0.0)]


def test_summary_has_all_statistics(frame):
    df = frame(CARD, ("a", 1.0, 2.0, 3.0, 4.0), ("b", 3.0, 2.0, 1.0, None))
    got = {r.statistic: tuple(r)[1:] for r in metric_summary(df, digits=4).collect()}
    assert got == {
        "count": (2.0, 2.0, 2.0, 1.0),
        "mean": (2.0, 2.0, 2.0, 4.0),
        "stddev": (1.4142, 0.0, 1.4142, None),
        "min": (1.0, 2.0, 1.0, 4.0),
        "max": (3.0, 2.0, 3.0, 4.0),
    }


def test_sigma_bounds(frame):
    df = frame(CARD, ("a", 1.0, 2.0, 3.0, 4.0), ("b", 3.0, 2.0, 1.0, 4.0))
    got = {(r.metric, r.k): (r.lower, r.upper) for r in sigma_bounds(df, bands=(1, 2)).collect()}
    assert got[("incident_rate", 1)] == (0.5858, 3.4142)
    assert got[("incident_rate", 2)] == (-0.8284, 4.8284)
    assert got[("injury_rate", 1)] == (2.0, 2.0)
    assert len(got) == 8


def _levels(frame, a, i, d):
    """Rate one area against a population whose mean is 10 and whose spread is known."""
    base = [(f"p{n}", v, v, v, 1.0) for n, v in enumerate([8.0, 9.0, 10.0, 11.0, 12.0] * 40)]
    rated = with_rating(frame(CARD, ("t", a, i, d, 1.0), *base))
    return rated.filter("area = 't'").first().rating


HI, MID, LO = 14.0, 10.0, 6.0
RATINGS = {
    (HI, HI, HI): "Hazardous",
    (HI, LO, LO): "Ok",
    (HI, MID, LO): "Hazardous",
    (HI, HI, LO): "Hazardous",
    (MID, HI, HI): "Hazardous",
    (MID, LO, LO): "Safe",
    (MID, HI, LO): "Ok",
    (MID, MID, MID): "Ok",
    (LO, HI, HI): "Ok",
    (LO, LO, LO): "Safe",
    (LO, MID, HI): "Safe",
    (LO, MID, MID): "Safe",
}


@pytest.mark.parametrize("rates", RATINGS)
def test_rating_table(frame, rates):
    assert _levels(frame, *rates) == RATINGS[rates]


def test_values_on_a_bound_are_in_the_middle(frame):
    # two values: mean 2, deviation 1.4142; equal values have both bounds on the value
    rated = with_rating(frame(CARD, ("a", 5.0, 1.0, 1.0, 1.0), ("b", 5.0, 3.0, 3.0, 1.0)))
    assert tuples(rated.select("area", "rating")) == [("a", "Ok"), ("b", "Ok")]


def test_top_and_bottom_break_ties_by_area(frame):
    df = frame("area string, m double", ("c", 1.0), ("a", 1.0), ("b", 2.0), ("d", None), ("e", 0.0))
    assert [r.area for r in top_k(df, "m", 3).collect()] == ["b", "a", "c"]
    assert [r.area for r in bottom_k(df, "m", 4).collect()] == ["e", "a", "c", "b"]


def test_renamed_projects_in_order(frame):
    df = renamed(frame("a int, b int, c int", (1, 2, 3)), {"c": "Last One", "a": "First"})
    assert df.columns == ["Last One", "First"] and tuples(df) == [(3, 1)]


@pytest.mark.parametrize("low, high", [(0, 1), (1e6, 1e6 + 3), (-5e-3, 5e-3)])
def test_moments_are_exact_whatever_the_partitions(spark, low, high):
    import random
    from decimal import Decimal, localcontext

    r = random.Random(low)
    values = [round(r.uniform(low, high), 6) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "incident_rate double")
    found = set()
    for partitions in (1, 2, 7):
        mean, deviation = exact_moments("incident_rate")
        found.add(tuple(df.repartition(partitions).agg(mean, deviation).first()))
    with localcontext() as context:
        context.prec = 60
        exact = [Decimal(repr(v)) for v in values]
        mean = sum(exact) / len(exact)
        deviation = (sum((v - mean) ** 2 for v in exact) / (len(exact) - 1)).sqrt()
    ((one, two),) = found
    assert one == pytest.approx(float(mean), rel=1e-15) and two == pytest.approx(float(deviation), rel=1e-14)


def test_moments_of_few_and_of_large_values(spark, frame):
    mean, deviation = exact_moments("x")
    assert tuple(frame("x double").agg(mean, deviation).first()) == (None, None)
    assert tuple(frame("x double", (2.5,), (None,)).agg(mean, deviation).first()) == (2.5, None)
    large = frame("x double", (1e30,), (3e30,)).agg(mean, deviation).first()
    assert large[0] == pytest.approx(2e30) and large[1] == pytest.approx(2**0.5 * 1e30)


def test_stored_profiles_merge_to_the_profile_of_all(spark, frame, tmp_path):
    kinds = {"factor": ["a", "b"]}
    rows = [(f"z{i % 3}" if i % 7 else None, "f" + str(i % 4) if i % 5 else None, "g" if i % 2 else " ", i) for i in range(60)]
    df = frame("area string, a string, b string, hurt int", *rows)
    profile = lambda part: category_profile(part, ["area"], kinds, {"hurt": F.col("hurt")})
    table = ProfileTable(spark, str(tmp_path / "profiles"), ["n", "hurt"])
    with pytest.raises(KeyError):
        table.read()
    table.add("2012", profile(df.where("hurt < 20")))
    table.add("2013", profile(df))  # replaced below
    table.add("2013", profile(df.where("hurt >= 20 and hurt < 50")))
    table.add("2014-01", profile(df.where("hurt >= 50")))
    assert table.periods() == ["2012", "2013", "2014-01"]
    assert tuples(table.read()) == tuples(profile(df))
    assert tuples(table.read("2012", "2014-01")) == tuples(profile(df.where("hurt < 20 or hurt >= 50")))
    with pytest.raises(KeyError):
        table.read("2015")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        table.add("2012", profile(df.withColumn("hurt", F.col("hurt") / F.lit(0))))
    assert tuples(table.read()) == tuples(profile(df)) and len(list((tmp_path / "profiles").iterdir())) == 3
