import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from areagrade.schemas import INCIDENTS
from areagrade.session import materialise, scratch_path, shared_folder
from areagrade.sources.delimited import (
    drop_header_lines,
    merge_surplus_cells,
    parse_lines,
    persisted,
    read_delimited,
    read_position_rejects,
    read_positions,
    read_rejects,
    realign_by_number,
    sampled,
)
from areagrade.sources.sinks import write_report
from tests.conftest import tuples

SCHEMA = StructType(
    [StructField("id", IntegerType()), StructField("name", StringType()), StructField("n", IntegerType())]
)
LINES = [
    "id,name,n",
    '1,"a, b",10',
    "2,plain,20",
    "3,too,many,30",
    "4,short",
    "5,bad,x",
    '6,"say ""hi""",60',
    "7,,70",
]


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(LINES) + "\n")
    return str(path)


def test_quote_aware_scan_and_rejects(spark, csv_file):
    good = read_delimited(spark, csv_file, SCHEMA)
    assert tuples(good) == [(1, "a, b", 10), (2, "plain", 20), (6, 'say "hi"', 60), (7, None, 70)]
    assert good.count() == 4
    assert tuples(good.select("name").where("name is null")) == [(None,)]
    rejects = read_rejects(spark, csv_file, SCHEMA)
    assert tuples(rejects) == [(line,) for line in LINES[3:6]]


def test_every_line_is_kept_or_rejected(spark, csv_file):
    good, rejects = read_delimited(spark, csv_file, SCHEMA), read_rejects(spark, csv_file, SCHEMA)
    assert good.count() + rejects.count() == len(LINES) - 1
    # the same rows whatever columns are used
    assert good.select("name").count() == len(good.select("id").collect()) == good.count()


def test_scan_reads_folders_with_a_header_per_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(f"id,name,n\n{i},x,{i}\n")
    assert tuples(read_delimited(spark, str(tmp_path), SCHEMA)) == [(0, "x", 0), (1, "x", 1), (2, "x", 2)]


def test_read_positions(spark, csv_file):
    picked = read_positions(spark, csv_file, {"count": 2, "key": 0})
    assert picked.columns == ["count", "key"]
    assert ("10", "1") in tuples(picked)


def test_parse_lines_carries_other_columns(frame):
    lines = frame("src string, line string", ("a", '1,"x, y",2'), ("b", "1,x,y,2"))
    good, rejects = parse_lines(lines, "line", SCHEMA)
    assert tuples(good) == [("a", 1, "x, y", 2)]
    assert tuples(rejects) == [("b", "1,x,y,2")]


def test_header_lines_are_dropped_anywhere(frame):
    lines = frame("line string", ("DATE,ZIP CODE",), ("1",), ("DATE,ZIP CODE",))
    assert tuples(drop_header_lines(lines, "line", "ZIP CODE")) == [("1",)]


def test_merge_surplus_cells(frame):
    df = frame("t string", ("0,1,2,3",), ("0,1a,1b,2,3",), ("0,1a,1b,1c,2,3",), ("0,1",))
    cells = merge_surplus_cells(F.split("t", ","), 4, 1)
    merged = [r[0] for r in df.select(cells).collect()]
    assert merged == [["0", "1", "2", "3"], ["0", "1a,1b", "2", "3"], ["0", "1a,1b,1c", "2", "3"], None]


def test_merge_restores_the_location_field(frame):
    """A location with a comma shifts everything after it; both widths read alike."""
    width = len(INCIDENTS)
    at = INCIDENTS.fieldNames().index("location")
    plain = ",".join(f"v{i}" for i in range(width))
    split = ",".join('"(40.7, -73.9)"' if i == at else f"v{i}" for i in range(width))
    df = frame("t string", (plain,), (split,))
    cells = df.select(merge_surplus_cells(F.split("t", ","), width, at).alias("c"))
    last, location = cells.select(F.get("c", F.lit(width - 1))), cells.select(F.get("c", F.lit(at)))
    assert [r[0] for r in last.collect()] == [f"v{width - 1}"] * 2
    assert [r[0] for r in location.collect()] == [f"v{at}", '"(40.7, -73.9)"']


def test_realign_by_number(frame):
    df = frame(
        "t string",
        ("k,Pothole,Street,11201,BROOKLYN",),
        ("k,Rough,Pitted,Street,11202,BROOKLYN",),
        ("k,A,B,C,Street,11203,QUEENS",),
        ("k,A,B,C,D,E,F,Street,11204,QUEENS",),
        ("k,Pothole,Street,,BROOKLYN",),
        ("k",),
        (None,),
    )
    columns = realign_by_number(F.split("t", ","), text_at=1, number_at=3, others={"city": 4})
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in columns.items())).collect()]
    assert got == [
        ("Pothole", "11201", "BROOKLYN"),
        ("Rough,Pitted", "11202", "BROOKLYN"),
        ("A,B,C", "11203", "QUEENS"),
        ("A,B,C,D,E,F", "11204", "QUEENS"),
        (None, None, None),
        (None, None, None),
        (None, None, None),
    ]


def test_sample_is_a_repeatable_subset(spark):
    df = spark.range(2000)
    part = sampled(df, 0.1, ["id"], seed=3)
    assert 100 < part.count() < 320
    for n in (1, 2, 7):
        assert tuples(part) == tuples(sampled(df.repartition(n), 0.1, ["id"], seed=3))
    assert part.subtract(df).count() == 0


def test_persisted_releases(spark):
    with persisted(spark.range(10)) as kept:
        assert kept.count() == 10
        assert kept.storageLevel.useMemory and kept.storageLevel.useDisk
    assert not kept.storageLevel.useMemory


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_sinks_read_back(spark, frame, tmp_path, fmt):
    df = frame("id int, name string, n int", (1, 'a, "b"', 2), (2, None, 3))
    path = str(tmp_path / fmt)
    write_report(df, path, fmt)
    if fmt == "csv":
        back = read_delimited(spark, path, SCHEMA)
    else:
        back = spark.read.format(fmt).schema(SCHEMA).load(path)
    assert tuples(back) == tuples(df)


def test_csv_report_has_header_once_per_file(frame, tmp_path):
    df = frame("area string, n int", ("a", 1), ("a", 1), ("b", 2)).repartition(2)
    write_report(df, str(tmp_path / "out"), single=True, order_by=["n", "area"])
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text().splitlines() == ["area,n", "a,1", "a,1", "b,2"]


def test_reports_stay_split_whatever_their_size(spark, tmp_path):
    write_report(spark.range(100).repartition(4), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 4


def test_json_keeps_nulls_and_text_is_raw(spark, frame, tmp_path):
    write_report(frame("a string, b int", (None, 1)), str(tmp_path / "j"), "json", single=True)
    (part,) = (tmp_path / "j").glob("part-*.json")
    assert json.loads(part.read_text()) == {"a": None, "b": 1}
    write_report(frame("line string", ("x,1",), ('"y"',)), str(tmp_path / "t"), "text")
    assert tuples(spark.read.text(str(tmp_path / "t"))) == [('"y"',), ("x,1",)]


def test_sinks_do_not_overwrite_silently(frame, tmp_path):
    df = frame("a int", (1,))
    write_report(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="already exists"):
        write_report(df, str(tmp_path / "o"))


def test_materialise_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder.rstrip("/") in shared_folder(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = materialise(spark.range(5).selectExpr("id % 2 as k").groupBy("k").count())
    assert tuples(df) == [(0, 3), (1, 2)]
    assert "ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_read_without_blanks_and_missing_ones_rejected(frame):
    schema = StructType(
        [StructField("area", StringType()), StructField("volume", LongType(), nullable=False), StructField("x", DoubleType())]
    )
    lines = ["a , 500, 1.5", "b,600 ,", "c,,1", "d,  ,1", "e,1.5,1", "f,99999999999999999999,1", "g,00000000000000000000007,-.5", "h,1", "i,1,2,3", "j,1,x"]
    good, rejects = parse_lines(frame("line string", *((x,) for x in lines)), "line", schema)
    assert sorted(map(tuple, good.collect())) == [("a ", 500, 1.5), ("b", 600, None), ("g", 7, -0.5)]
    assert sorted(r.line[0] for r in rejects.collect()) == list("cdefhij")


def test_rows_of_another_width_are_rejects(spark, tmp_path):
    (tmp_path / "p.csv").write_text('k,"t, u",n\n1,"a, b",3\n1,2\n1,2,3,4\n')
    assert tuples(read_positions(spark, str(tmp_path), {"n": 2, "k": 0})) == [("3", "1")]
    assert sorted(r.record for r in read_position_rejects(spark, str(tmp_path)).collect()) == ["1,2", "1,2,3,4"]
