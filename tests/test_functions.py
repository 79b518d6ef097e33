from datetime import datetime

import pytest
from pyspark.sql import functions as F

from areagrade.functions.labels import category_label, count_label
from areagrade.functions.numeric import filled_count, percent, rate, whole_div, wide_sum
from areagrade.functions.temporal import format_shape, in_window, parse_timestamp
from areagrade.functions.text import (
    area_key,
    capitalised,
    cleaned,
    is_all_upper,
    is_filled,
    keyword_match,
    kind_by_case,
    not_ignored,
    numeric_key,
    ordinal_street,
    whole_number,
)
from areagrade.schemas import INCIDENT_TIME_FORMATS, REQUEST_TIME_FORMATS, STREET_ALIASES, WINDOW_END, WINDOW_START

def test_cleaned_and_filled(one):
    values = ["a ", "", "   ", None, " b"]
    assert one(values, cleaned) == ["a", None, None, None, "b"]
    assert one(values, is_filled) == [True, False, False, False, True]


def test_keyword_match_is_case_sensitive(one):
    values = ["Street Condition", "Noise - Street/Sidewalk", "street light", "Sewer"]
    assert one(values, keyword_match, "Street", "Noise") == [True, False, False, False]
    assert one(values, keyword_match, "Street") == [True, True, False, False]


def test_area_key_pads_but_never_cuts(one):
    values = ["83", " 11201 ", "00083", "112011234", "11201-1234", "", "     ", "0"]
    assert one(values, area_key) == ["00083", "11201", "00083", "112011234", "11201-1234", None, None, "00000"]


def test_numeric_key_drops_zeros(one):
    assert one(["00083", " 7 ", "0", "x", ""], numeric_key) == ["83", "7", "0", None, None]


def test_whole_number(one):
    values = ["5", " -3 ", "+4", "", "A", "1.5", "99999999999999999999", "9223372036854775807", None]
    assert one(values, whole_number) == [5, -3, 4, None, None, None, None, 9223372036854775807, None]
    # fits the pattern, not the type
    assert one(["9999999999999999999"], whole_number) == [None]


def test_capitalised_only_first_word(one):
    assert one(["NEW YORK", "bronx", "q", ""], capitalised) == ["New york", "Bronx", "Q", ""]


def test_case_kind(one):
    values = ["BUS", "Fatigued/Drowsy", "12 / 3", "SMALL COM VEH(4 TIRES)", ""]
    assert one(values, is_all_upper) == [True, False, False, True, False]
    assert one(values[:2], kind_by_case, "vehicle", "factor") == ["vehicle", "factor"]


def test_not_ignored(one):
    assert one(["UNKNOWN", "BUS", "Unspecified"], not_ignored, ["UNKNOWN", "Unspecified"]) == [False, True, False]


STREETS = {
    "14 ST": "14th ST",
    "WEST 14 ST": "WEST 14th ST",
    "111 ST": "111th ST",
    "112 AVE": "112th AVE",
    "213 ST": "213th ST",
    "21 ST": "21st ST",
    "101 AVE": "101st AVE",
    "122 ST": "122nd ST",
    "1 AVE": "1st AVE",
    "2 AVE": "2nd AVE",
    "3 AVE": "3rd AVE",
    "0 ST": "0th ST",
    "10 AVE": "10th AVE",
    "1 AVE & 2 ST": "1st AVE & 2nd ST",
    "11 12 13 21 22 23": "11th 12th 13th 21st 22nd 23rd",
    "PIER 4A": "PIER 4A",
    "4-5 ST": "4-5 ST",
    "E  5 ST": "E  5th ST",
    " BROADWAY ": "BROADWAY",
    "AVE OF THE AMER": "AVE OF THE AMERICAS",
}


def test_ordinal_street(one):
    assert one(list(STREETS), ordinal_street, STREET_ALIASES) == list(STREETS.values())


def test_ordinals_match_a_direct_rule(one):
    def ending(n):
        if n % 100 in (11, 12, 13):
            return "th"
        return {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")

    numbers = range(0, 300)
    assert one([f"{n}" for n in numbers], ordinal_street) == [f"{n}{ending(n)}" for n in numbers]


def test_wide_sum_skips_what_is_no_number(frame):
    df = frame("a string, b string, c string", ("1", " 2 ", "x"), ("", None, "1.5"), ("-4", "10", "0"))
    assert [r[0] for r in df.select(wide_sum([F.col(c) for c in df.columns])).collect()] == [3, 0, 6]


def test_filled_count(frame):
    df = frame("a string, b string", ("x", " "), (None, "y"), ("x", "y"), (None, ""))
    assert [r[0] for r in df.select(filled_count([F.col("a"), F.col("b")])).collect()] == [1, 1, 2, 0]


def test_division_guards(frame):
    df = frame("a bigint, b bigint", (7, 2), (7, 0), (0, 5))
    assert [r[0] for r in df.select(whole_div(F.col("a"), F.col("b"))).collect()] == [3, None, 0]
    assert [r[0] for r in df.select(rate(F.col("a"), F.col("b"), 1000)).collect()] == [3500.0, None, 0.0]
    assert [r[0] for r in df.select(percent(F.col("a"), F.col("b"))).collect()] == [350.0, 0.0, 0.0]


def test_labels(frame):
    df = frame("c string, n bigint, t bigint", ("VAN", 27, 1171), ("BUS", 1, 3), (None, 1, 3), ("BUS", 0, 0))
    share = percent(F.col("n"), F.col("t"))
    labels = [r[0] for r in df.select(category_label(F.col("c"), F.col("n"), share)).collect()]
    assert labels == ["VAN: 27: 2.31%", "BUS: 1: 33.33%", None, "BUS: 0: 0.0%"]
    assert [r[0] for r in df.select(count_label(F.col("n"), share)).collect()][:2] == ["27: 2.0%", "1: 33.0%"]


def test_window_is_closed_and_ends_on_the_minute(frame):
    moments = [
        datetime(2011, 12, 31, 23, 59),
        datetime(2012, 1, 1, 0, 0),
        datetime(2013, 12, 31, 23, 59),
        datetime(2013, 12, 31, 23, 59, 1),
        datetime(2014, 1, 1, 0, 0),
    ]
    df = frame("t timestamp_ntz", *((m,) for m in moments))
    kept = [r[0] for r in df.filter(in_window(F.col("t"), WINDOW_START, WINDOW_END)).collect()]
    assert kept == moments[1:3]


def test_parse_timestamp(frame):
    df = frame(
        "d string, t string",
        ("07/04/2012", "0:05"),
        ("07/04/2012", "23:59"),
        ("2012-07-04", "9:30"),
        ("07/04/2012", "24:00"),
        ("13/04/2012", "1:00"),
        ("02/30/2012", "1:00"),
        (None, "1:00"),
        ("", ""),
    )
    moment = parse_timestamp([F.col("d"), F.col("t")], INCIDENT_TIME_FORMATS)
    got = [r[0] for r in df.select(moment).collect()]
    assert got == [datetime(2012, 7, 4, 0, 5), datetime(2012, 7, 4, 23, 59), datetime(2012, 7, 4, 9, 30)] + [None] * 5


def test_parse_request_times(one):
    values = [
        "12/31/2013 11:59:45 PM",
        "01/02/2012 01:02:03 AM",
        "1/2/2012 0:00",
        "01/02/2012",
        "2012-01-02T03:04:05.678",
        "2012-01-02T03:04:05",
        "soon",
        "",
    ]
    assert one(values, lambda t: parse_timestamp([t], REQUEST_TIME_FORMATS)) == [
        datetime(2013, 12, 31, 23, 59, 45),
        datetime(2012, 1, 2, 1, 2, 3),
        None,
        datetime(2012, 1, 2),
        datetime(2012, 1, 2, 3, 4, 5, 678000),
        datetime(2012, 1, 2, 3, 4, 5),
        None,
        None,
    ]


def test_format_shape_rejects_unknown_letters():
    with pytest.raises(ValueError):
        format_shape("MMM d, yyyy")
