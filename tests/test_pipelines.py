"""The jobs on small hand-written files, against expectations worked out by hand or by brute force."""

import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from areagrade.plans.exposure import annual_exposure, area_volume, segment_volume
from areagrade.plans.incidents import incident_profile, incident_stats, incident_totals, prepare_incidents
from areagrade.plans.job import main, run
from areagrade.plans.requests import prepare_requests, request_profile, request_stats, request_totals
from areagrade.schemas import AREA_VOLUME, CASUALTY_COLUMNS, HOUR_COLUMNS, INCIDENTS, REQUEST_POSITIONS
from areagrade.sources.delimited import read_delimited, read_positions
from tests.conftest import tuples


def incident(date="07/04/2012", time="9:30", area="11201", location="", counts=(), factors=(), vehicles=()):
    counts = tuple(counts) + (0,) * (8 - len(counts))
    factors = tuple(factors) + ("",) * (5 - len(factors))
    vehicles = tuple(vehicles) + ("",) * (5 - len(vehicles))
    cells = [date, time, "BROOKLYN", area, "", "", location, "", "", "", *counts, *factors, "1", *vehicles]
    return ",".join(str(cell) for cell in cells)


HEADER = ",".join(INCIDENTS.fieldNames())
INCIDENT_LINES = [
    HEADER,
    incident(location='"(40.7, -73.9)"', counts=(2, 1, 1, 0, 0, 0, 1, 1), factors=("Fog",), vehicles=("VAN", "BUS ")),
    incident(date="01/01/2012", time="0:00", factors=("Unspecified", "Fog"), vehicles=("VAN", "UNKNOWN")),
    incident(date="12/31/2013", time="23:59", vehicles=("TAXI",)),
    incident(date="12/31/2011", time="23:59", vehicles=("VAN",)),
    incident(date="01/01/2014", time="0:00", vehicles=("VAN",)),
    incident(area="", vehicles=("VAN",)),
    incident(area="     ", vehicles=("VAN",)),
    incident(date="sometime", vehicles=("VAN",)),
    incident(counts=("x",), vehicles=("VAN",)),
    incident(vehicles=("VAN",)) + ",surplus",
    incident(area="83"),
]


@pytest.fixture(scope="module")
def incident_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "incidents.csv"
    path.write_text("\n".join(INCIDENT_LINES) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def incident_rows(spark, incident_file):
    return prepare_incidents(read_delimited(spark, incident_file, INCIDENTS))


def test_incident_stats(incident_rows):
    stats = {row.area: row for row in incident_stats(incident_profile(incident_rows)).collect()}
    assert set(stats) == {"11201", "00083"}
    row = stats["11201"]
    assert (row.incidents, row.vehicles, row.injured, row.killed) == (3, 5, 2, 1)
    assert row.pedestrians_injured_label == "1: 50.0%" and row.motorists_killed_label == "1: 100.0%"
    assert [row[f"factor_{i}"] for i in range(1, 6)] == ["Fog: 2: 40.0%", "", "", "", ""]
    assert [row[f"vehicle_{i}"] for i in range(1, 4)] == ["VAN: 2: 40.0%", "BUS: 1: 20.0%", "TAXI: 1: 20.0%"]
    empty = stats["00083"]
    assert (empty.incidents, empty.vehicles, empty.vehicle_1, empty.cyclists_killed_label) == (1, 0, "", "0: 0.0%")


def test_incident_totals(incident_rows):
    totals = {(r.kind, r.category): r.n for r in incident_totals(incident_profile(incident_rows)).collect()}
    assert totals[("metric", "incidents")] == 4 and totals[("metric", "vehicles")] == 5
    assert totals[("vehicle", "UNKNOWN")] == 1 and totals[("factor", "Unspecified")] == 1
    assert totals[("factor", "Fog")] == 2


def request(
    created="07/04/2012 01:02:03 PM", category="Street Condition", descriptor="Pothole", area="11201", city="NY"
):
    cells = [str(i) for i in range(20)]
    for name, value in (("created_at", created), ("category", category), ("descriptor", descriptor), ("area", area)):
        cells[REQUEST_POSITIONS[name]] = value
    cells[REQUEST_POSITIONS["city"]] = city
    return ",".join(cells)


REQUEST_LINES = [
    ",".join(f"h{i}" for i in range(20)),
    request(),
    request(descriptor='"Rough, Pitted or Cracked Roads"', city="BROOKLYN"),
    request(descriptor='"No Parking, Standing, Stopping"', city="BROOKLYN"),
    request(descriptor="", city="NY"),
    request(category="Street Light Condition", city="AKRON"),
    request(category="Noise - Street/Sidewalk"),
    request(category="Sewer"),
    request(created="whenever"),
    request(created="01/01/2014 12:00:00 AM"),
    request(area=""),
    request(city=""),
    request(area="00000", descriptor="Cave-in", city="QUEENS"),
]


@pytest.fixture(scope="module")
def request_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "requests.csv"
    path.write_text("\n".join(REQUEST_LINES) + "\n")
    return str(path)


def test_request_stats(spark, request_file):
    requests = prepare_requests(read_positions(spark, request_file, REQUEST_POSITIONS))
    profile = request_profile(requests)
    stats = {row.area: row for row in request_stats(profile).collect()}
    assert set(stats) == {"11201", "00000"}
    row = stats["11201"]
    assert row.requests == 5 and row.city == "BROOKLYN"  # tied with NY, smaller name
    assert [row[f"complaint_{i}"] for i in (1, 2, 3)] == ["STREET CONDITION: 4: 80.0%", "", ""]
    assert [row[f"descriptor_{i}"] for i in (1, 2, 3, 4)] == [
        "Pothole: 2: 40.0%",
        "No Parking, Standing, Stopping: 1: 20.0%",
        "Rough, Pitted or Cracked Roads: 1: 20.0%",
        "",
    ]
    totals = {(r.kind, r.category): r.n for r in request_totals(profile).collect()}
    assert totals[("metric", "requests")] == 6 and totals[("complaint", "STREET CONDITION")] == 5
    assert not any(kind == "city" for kind, _ in totals)


def segment(record, seg, streets, hours):
    return (str(record), seg, *streets, "NB", "d", *hours, *([None] * (24 - len(hours))))


def test_segments_to_areas(frame):
    schema = "record_id string, segment_id string, roadway string, from_street string, to_street string, "
    schema += "direction string, date string, " + ", ".join(f"{h} string" for h in HOUR_COLUMNS)
    counts = frame(
        schema,
        segment(1, "s1", ("AVE OF THE AMER", "WEST 14 ST", "WEST 15 ST"), ["10", " 20", ""]),
        segment(2, "s1", ("OTHER", "OTHER", "OTHER"), ["70", "x"]),
        segment(3, "s2", ("1 AVE", "E 2 ST", "E 3 ST"), ["7"]),
        segment(4, "s3", ("NOWHERE", "E 2 ST", "E 3 ST"), ["9"]),
        segment(5, "s4", (None, "E 2 ST", "E 3 ST"), ["9"]),
    )
    segments = segment_volume(counts)
    assert tuples(segments)[0] == ("s1", "AVE OF THE AMERICAS", "WEST 14th ST", "WEST 15th ST", 100, 2)
    gazetteer = frame(
        "street string, area string",
        ("AVE OF THE AMERICAS", "10011"),
        ("WEST 14th ST", "10011"),
        ("WEST 15th ST", "10012"),
        ("1st AVE", "10003"),
        ("E 2nd ST", "10003"),
        ("E 3rd ST", "10003"),
    )
    volumes = area_volume(segments, gazetteer)
    assert tuples(volumes) == [("10003", 7, 1), ("10011", 66, 0), ("10012", 33, 0)]
    assert tuples(annual_exposure(volumes)) == [("10003", 7 * 731), ("10011", None), ("10012", None)]


def test_exposure_does_not_depend_on_splits(spark, frame):
    """Sums per area must merge the same way over any number of partitions."""
    rows = [(f"{10000 + i % 7}" + (f";{10000 + i % 5}" if i % 3 == 0 else ""), i * 13, 6 + i % 4) for i in range(300)]
    expected = defaultdict(lambda: [0, 0])
    for cell, volume, samples in rows:
        areas = cell.split(";")
        for area in areas:
            expected[area][0] += volume // len(areas)
            expected[area][1] += samples // len(areas)
    wanted = sorted((area, v // s * 731) for area, (v, s) in expected.items())
    df = frame("area string, volume bigint, samples bigint", *rows)
    for partitions in (1, 2, 7):
        assert tuples(annual_exposure(df.repartition(partitions))) == wanted


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_statistics_do_not_depend_on_splits(spark, partitions):
    types = F.array(*map(F.lit, ["VAN", "BUS", "TAXI", ""]))
    vehicles = [F.element_at(types, ((F.col("id") * k) % 4 + 1).cast("int")) for k in (1, 3, 5)]
    df = spark.range(400).select(
        (F.col("id") % 6).cast("string").alias("area"),
        *((F.col("id") % (i + 2)).cast("int").alias(name) for i, name in enumerate(CASUALTY_COLUMNS)),
        *(F.lit("Fog").alias(f"factor_{i}") for i in range(1, 6)),
        *(column.cast("string").alias(f"vehicle_{i}") for i, column in enumerate(vehicles, 1)),
        *(F.lit(None).cast("string").alias(f"vehicle_{i}") for i in (4, 5)),
    )
    first = tuples(incident_stats(incident_profile(df.coalesce(1))))
    assert tuples(incident_stats(incident_profile(df.repartition(partitions)))) == first


def test_hot_area_against_brute_force(spark):
    """A third of the rows in one area, with more categories than fit any list."""
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("area"),
        F.concat(F.lit("Street "), (F.col("id") * F.col("id") % 977).cast("string")).alias("category"),
        F.concat(F.lit("d"), (F.col("id") % 11).cast("string")).alias("descriptor"),
        F.concat(F.lit("C"), (F.col("id") % 4).cast("string")).alias("city"),
    )
    counts, cities, totals = defaultdict(Counter), defaultdict(Counter), Counter()
    for row in df.collect():
        totals[row.area] += 1
        counts[row.area][row.category] += 1
        cities[row.area][row.city] += 1
    for row in request_stats(request_profile(df.repartition(5))).collect():
        found = sorted(counts[row.area].items(), key=lambda pair: (-pair[1], pair[0]))
        keep = 3 if len(found) >= 3 else 1
        assert row.requests == totals[row.area]
        labels = [row[f"complaint_{i}"].rsplit(": ", 1)[0] for i in range(1, keep + 1)]
        assert labels == [f"{category}: {n}" for category, n in found[:keep]]
        assert row.city == min(cities[row.area].items(), key=lambda pair: (-pair[1], pair[0]))[0]


def test_hot_key_join_is_split(spark):
    """Without broadcast, a street with most of the rows is split by the adaptive join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    from areagrade.operators.apportion import resolve_areas

    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        streets = spark.range(30_000).select(
            "id", F.when(F.col("id") % 10 > 0, "HOT").otherwise(F.col("id").cast("string")).alias("f")
        )
        gazetteer = spark.range(0, 30_000, 10).select(F.col("id").cast("string").alias("street"))
        gazetteer = gazetteer.union(gazetteer.limit(1).select(F.lit("HOT"))).withColumn("area", F.col("street"))
        found = resolve_areas(streets.repartition(8), gazetteer, {"f": "fa"})
        assert len(found.collect()) == 30_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture(scope="module")
def volume_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "volumes.csv"
    path.write_text("Zip_code, Sample_traffic_volume, Number_of_Samples\n11201,26598,12\n11201;83,500,4\n")
    return str(path)


def test_whole_run(spark, incident_file, request_file, volume_file, tmp_path):
    output = str(tmp_path / "out")
    rated = run(spark, incident_file, request_file, volume_file, output)
    (row,) = rated.collect()
    exposure = (26598 + 250) // 14 * 731
    assert (row.city, row.area, row.incidents, row.requests) == ("BROOKLYN", "11201", 3, 5)
    assert row.incident_rate == round(3 / exposure * 1000, 2)
    written = {path.name for path in (tmp_path / "out").iterdir()}
    assert written == {
        "incident_stats", "incident_totals", "incident_rejects", "request_rejects", "volume_rejects",
        "request_stats", "request_totals", "exposure",
        "rated_scorecard", "summary",
        *(f"{end}_{m}" for end in ("top", "bottom")
          for m in ("incident_rate", "injury_rate", "death_rate", "vehicles_per_incident")),
    }
    (report,) = (tmp_path / "out" / "rated_scorecard").glob("part-*.csv")
    header = report.read_text().splitlines()[0].split(",")
    assert header[:4] == ["City", "Zip_Code", "Safety_classifier", "Accidents_per_1000_veh"] and len(header) == 28
    (stats,) = (tmp_path / "out" / "incident_stats").glob("part-*.csv")
    assert stats.read_text().startswith("Zip_code,Total_accidents,Total_vehicles_in_accidents,")
    (top,) = (tmp_path / "out" / "top_death_rate").glob("part-*.json")
    assert json.loads(top.read_text())["Deaths_Per_1000_Accidents"] == 333.33
    rejects = spark.read.text(f"{output}/incident_rejects")
    assert rejects.count() == 2
    for totals in ("incident_totals", "request_totals"):
        (part,) = (tmp_path / "out" / totals).glob("part-*.csv")
        rows = [line.rsplit(",", 2) for line in part.read_text().splitlines()[1:]]
        counts = [int(next(cell for cell in row if cell.isdigit())) for row in rows]
        assert counts == sorted(counts, reverse=True)


def test_run_without_output_gives_the_same(spark, incident_file, request_file, volume_file, tmp_path):
    with_files = run(spark, incident_file, request_file, volume_file, str(tmp_path / "out"))
    assert tuples(run(spark, incident_file, request_file, volume_file)) == tuples(with_files)


def test_command_line_volumes(spark, tmp_path):
    header = "ID,Segment ID,Roadway Name,From,To,Direction,Date," + ",".join(f"{h}:00" for h in range(24))
    cells = ["1", "s1", "1 AVE", "E 2 ST", "E 3 ST", "NB", "01/01/2012", *map(str, range(24))]
    (tmp_path / "counts.csv").write_text(header + "\n" + ",".join(cells) + "\n")
    (tmp_path / "gaz.csv").write_text("street,area\n1st AVE,10003\nE 2nd ST,10003\nE 3rd ST,10009\n")
    main(["volume", str(tmp_path / "counts.csv"), str(tmp_path / "gaz.csv"), str(tmp_path / "out")])
    volumes = read_delimited(spark, str(tmp_path / "out"), AREA_VOLUME)
    assert tuples(volumes) == [("10003", 184, 0), ("10009", 92, 0)]
