"""Inputs that are read once, reports that appear together."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from areagrade.plans.job import run, write_area_volume
from areagrade.session import shared_folder
from areagrade.sources.delimited import read_delimited, read_rejects
from areagrade.sources.sinks import ReportSet, read_manifest, read_ordered, write_ordered
from areagrade.sources.staged import joined_records, landed_lines, stage_positions, stage_records
from tests.conftest import tuples

SCHEMA = StructType([StructField("id", IntegerType()), StructField("name", StringType()), StructField("n", IntegerType())])
LINES = ["id,name,n", '1,"a, b",10', "2,plain,20", "3,too,many,30", "4,short", "5,bad,x", '6,"say ""hi""",60', "7,,70", "id,name,n", "  "]


@pytest.fixture
def csv_file(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("\n".join(LINES) + "\n")
    return str(path)


@pytest.fixture
def splits(spark):
    """Files read in splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum")
    before = {name: spark.conf.get(name, None) for name in names}

    def of(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")

    yield of
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_records_and_rejects_of_one_reading(spark, csv_file):
    checks = {"small": F.col("n") > 15, "even": F.col("n") % 20 == 0}
    with stage_records(spark, csv_file, SCHEMA, derived={"twice": F.col("n") * 2}, checks=checks, kept=["id", "twice"]) as staged:
        assert tuples(staged.records) == [(2, 40), (6, 120)]
        assert tuples(staged.rejects()) == [(line,) for line in LINES[3:6]]
        assert tuples(staged.rejects("small")) == [('1,"a, b",10',)] and tuples(staged.rejects("even")) == [("7,,70",)]
        folder = staged._folder
        assert folder.exists()
    assert not folder.exists()


def test_staged_equals_the_lazy_readers(spark, csv_file):
    with stage_records(spark, csv_file, SCHEMA) as staged:
        assert tuples(staged.records) == tuples(read_delimited(spark, csv_file, SCHEMA))
        assert tuples(staged.rejects()) == tuples(read_rejects(spark, csv_file, SCHEMA))


@pytest.mark.parametrize("size", [1 << 20, 12])
def test_each_file_has_its_own_header_and_width(spark, splits, tmp_path, size):
    splits(size)
    three = ["a,b,c", "1,2,3", "1,2,3,4", "a,b,c", 'x,"y, z",', "h1,h2,h3,h4"]
    four = ["h1,h2,h3,h4", "5,6,7,8", "5,6,7", "a,b,c", "1,2,3,4", 'q"u,1,2,3']
    (tmp_path / "three.csv").write_text("\n".join(three))
    (tmp_path / "four.csv").write_text("\n\n".join(four) + "\n")
    (tmp_path / "none.csv").write_text("")
    with stage_positions(spark, str(tmp_path), {"last": 2, "first": 0}) as staged:
        assert tuples(staged.records) == sorted([("3", "1"), (None, "x"), ("7", "5"), ("3", "1")], key=repr)
        assert tuples(staged.rejects()) == sorted([(three[2],), (three[5],), (four[2],), (four[3],), (four[5],)])
    with stage_records(spark, [str(tmp_path / "three.csv"), str(tmp_path / "four.csv")], SCHEMA) as staged:
        assert tuples(staged.records) == [(1, "2", 3), (5, "6", 7)]


def test_staging_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    with stage_records(spark, str(tmp_path), SCHEMA) as one, stage_positions(spark, str(tmp_path), {"x": 0}, multiline=True) as two:
        assert one.records.collect() == one.rejects().collect() == two.records.collect() == two.rejects().collect() == []
    with stage_positions(spark, str(tmp_path), {"x": 0}, header=False) as staged:
        assert staged.records.collect() == []


def test_headerless_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,2\n3\n4,5\n")
    with stage_positions(spark, str(tmp_path), {"x": 1}, header=False) as staged:
        assert tuples(staged.records) == [("2",), ("5",)] and tuples(staged.rejects()) == [("3",)]


def quoted_rows(seed, n=300):
    r = random.Random(seed)
    cell = lambda: "".join(r.choice(['a', 'é', ',', '"', '\n', ' ', 'b']) for _ in range(r.randint(0, 12)))
    return [(str(i), cell(), str(i * 3)) for i in range(n)]


def delimited(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("size", [1 << 20, 400])
def test_quoted_records_span_lines_and_splits(spark, splits, tmp_path, size):
    splits(size)
    files = {f"{i}.csv": quoted_rows(i, n) for i, n in enumerate((120, 1, 40))}
    for name, rows in files.items():
        (tmp_path / name).write_text(delimited([("id", "na\nme", "n"), *rows]))
    with stage_records(spark, str(tmp_path), SCHEMA, multiline=True) as staged:
        wanted = sorted(((int(i), name or None, int(n)) for rows in files.values() for i, name, n in rows), key=repr)
        # a cell that only has quotes around nothing is empty, blank lines inside a cell are not kept
        tidy = lambda name: "\n".join(x for x in (name or "").split("\n") if x.strip(" "))
        assert sorted(((i, tidy(name), n) for i, name, n in staged.records.collect()), key=repr) == sorted(((i, tidy(name), n) for i, name, n in wanted), key=repr)
        assert staged.rejects().collect() == []
    with stage_positions(spark, str(tmp_path), {"n": 2}, multiline=True) as staged:
        assert tuples(staged.records) == sorted([(n,) for rows in files.values() for _, _, n in rows])


@pytest.mark.parametrize("size", [1 << 20, 11])
def test_quotes_that_close_nothing_stay_single(spark, splits, tmp_path, size):
    splits(size)
    (tmp_path / "a.csv").write_text('1,"x\ny",2\n3,z,4\n5,"open,6\n7,w,8\n')
    (tmp_path / "b.csv").write_text('1,"a\n' + "b\n" * 30 + 'c",2\n3,d,4\n')
    lines = landed_lines(spark, str(tmp_path)).checkpoint()
    joined = joined_records(lines, most_lines=20).select("_line")
    want = ['1,"x\ny",2', "3,z,4", '5,"open,6', "7,w,8", '1,"a', *["b"] * 30, 'c",2', "3,d,4"]
    assert tuples(joined) == sorted([(w,) for w in want], key=repr)


@pytest.mark.parametrize("partitions", [1, 5])
def test_ordered_reports_keep_their_order_over_files(spark, tmp_path, partitions):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == 1).lower())
    try:
        df = spark.range(500).select((F.col("id") * 7 % 20).alias("n"), F.concat(F.lit('c,"'), "id").alias("name"))
        path = str(tmp_path / "out")
        write_ordered(df.repartition(3), path, [F.desc("n"), "name"])
        files = sorted((tmp_path / "out").glob("part-*.csv"))
        assert len(files) >= min(partitions, 2)
        read = [line for file in files for line in list(csv.reader(io.StringIO(file.read_text()), doublequote=True))[1:]]
        wanted = [(r.n, r.name) for r in df.orderBy(F.desc("n"), "name").collect()]
        assert [(int(n), name) for n, name in read] == wanted
        places = read_ordered(spark, path, df.schema).collect()
        assert [(r.n, r.name) for r in sorted(places, key=lambda r: r.place)] == wanted and {r.place for r in places} == set(range(1, 501))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ordered_report_of_nothing(spark, frame, tmp_path):
    df = frame("a string, n int")
    write_ordered(df, str(tmp_path / "out"), ["a"])
    assert read_ordered(spark, str(tmp_path / "out"), df.schema).collect() == []


def test_a_set_appears_whole(spark, frame, tmp_path):
    df, out = frame("a string", ("x",)), str(tmp_path / "out")
    with ReportSet(spark, f"{out}_manifest") as reports:
        reports.write(df, f"{out}/one")
        reports.write(df, f"{out}/two", fmt="json")
        assert not (tmp_path / "out").exists()
    assert read_manifest(spark, f"{out}_manifest") == [f"{out}/one", f"{out}/two"]
    assert tuples(spark.read.json(f"{out}/two")) == [("x",)]
    assert {p.name for p in tmp_path.iterdir() if p.suffix != ".crc"} == {"out", "out_manifest"}
    with pytest.raises(FileExistsError):
        ReportSet(spark, f"{out}_manifest")


def test_a_set_that_fails_leaves_nothing(spark, frame, tmp_path):
    df, out = frame("a string", ("x",)), str(tmp_path / "out")
    with pytest.raises(ZeroDivisionError), ReportSet(spark, f"{out}_manifest") as reports:
        reports.write(df, f"{out}/one")
        raise ZeroDivisionError
    assert [p for p in tmp_path.iterdir() if p.suffix != ".crc"] == []
    with pytest.raises(FileNotFoundError):
        read_manifest(spark, f"{out}_manifest")


def test_a_set_killed_while_it_appears_is_made_anew(spark, frame, tmp_path, monkeypatch):
    df, out = frame("a string", ("x",)), str(tmp_path / "out")
    (tmp_path / "out" / "kept").mkdir(parents=True)

    class Killed(BaseException):
        pass

    from areagrade.sources import files

    moves = []

    def dies(self, other):
        moves.append(other.path)
        if other.path.endswith("/two"):
            raise Killed
        return moved(self, other)

    moved = files.Folder.move_to
    monkeypatch.setattr(files.Folder, "move_to", dies)
    with pytest.raises(Killed), ReportSet(spark, f"{out}_manifest") as reports:
        for name in ("one", "two", "three"):
            reports.write(df, f"{out}/{name}")
    monkeypatch.undo()
    assert (tmp_path / "out" / "one").exists() and not (tmp_path / "out_manifest").exists()
    with ReportSet(spark, f"{out}_manifest") as reports:
        for name in ("one", "two", "three"):
            reports.write(df, f"{out}/{name}")
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"one", "two", "three", "kept"}
    assert {p.name for p in tmp_path.iterdir() if p.suffix != ".crc"} == {"out", "out_manifest"}


def scans_since(spark, first, path):
    """How often the executions from number ``first`` on read the path as text."""
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.executionsList().apply(i).physicalPlanDescription() for i in range(first, store.executionsCount())]
    return sum(plan.count(f"[file:{path}]") for plan in plans)


@pytest.fixture
def whole_paths(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_jobs_read_each_input_once(spark, whole_paths, tmp_path):
    header = "ID,Segment ID,Roadway Name,From,To,Direction,Date," + ",".join(f"{h}:00" for h in range(24))
    cells = ["1", "s1", "1 AVE", "E 2 ST", "E 3 ST", "NB", "01/01/2012", *map(str, range(24))]
    huge = [*cells[:7], *["9" * 18] * 24]
    (tmp_path / "counts.csv").write_text("\n".join([header, ",".join(cells), ",".join(huge), "short,line"]))
    (tmp_path / "gaz.csv").write_text("street,area\n1st AVE,10003\nE 2nd ST,10003\nE 3rd ST,10009\nnothing\n")
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    write_area_volume(spark, str(tmp_path / "counts.csv"), str(tmp_path / "gaz.csv"), str(tmp_path / "out"))
    assert [scans_since(spark, first, tmp_path / name) for name in ("counts.csv", "gaz.csv")] == [1, 1]
    rejects = {name: [r.value for r in spark.read.text(str(tmp_path / f"out_{name}_rejects")).collect()] for name in ("count", "sum", "gazetteer")}
    assert rejects == {"count": ["short,line"], "sum": [",".join(huge)] if sum([int("9" * 18)] * 24) > 2**63 else [], "gazetteer": ["nothing"]}
    assert len(read_manifest(spark, str(tmp_path / "out_manifest"))) == 4


def test_a_run_reads_each_input_once_and_leaves_no_scratch(spark, whole_paths, tmp_path):
    row = "01/15/2013,10:05,X,11201,,,,a,b,c,1,0,1,0,0,0,0,0,Fog,,,,,id,VAN,,,,"
    (tmp_path / "i.csv").write_text("h" + "," * 28 + "\n" + row + "\n")
    cells = [""] * 17
    for at, value in {1: "01/15/2013 10:05:00 AM", 5: "Street Light", 6: "out", 8: "11201", 16: "BROOKLYN"}.items():
        cells[at] = value
    (tmp_path / "r.csv").write_text(",".join(f"c{i}" for i in range(17)) + "\n" + ",".join(cells) + "\n")
    (tmp_path / "v.csv").write_text("area,volume,samples\n11201,100,4\n")
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    rated = run(spark, *(str(tmp_path / f"{name}.csv") for name in "irv"), str(tmp_path / "out"))
    assert [scans_since(spark, first, tmp_path / f"{name}.csv") for name in "irv"] == [1, 1, 1]
    assert rated.count() == 1
    from areagrade.sources.files import Folder

    assert not [name for name in Folder(spark, shared_folder(spark)).names() if name.startswith("staged-")]
