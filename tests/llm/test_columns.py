"""Operators on tables whose columns have the names they work with."""

import pytest
from pyspark.sql import functions as F

from areagrade.llm import bpe, leaks, lines, near, ppm

NAMES = (
    "row", "rest", "times", "log", "base", "seen", "tokens", "_id", "_t1", "_t2", "_text", "_text_id", "_lines", "_kept", "_common", "_one", "_k", "_k1", "_k2",
    "k1", "k2", "key", "digest", "root", "part", "no", "unit", "data", "u", "v", "Kept_Text", "IDS", "kept0", "hash",
)
LINE = "one line that many documents share"
WORDS = " ".join(f"w{i}" for i in range(60))
ITEM = "an item of a benchmark that has quite a number of words in it"
TEXTS = [f"{LINE}\nown {i}" for i in range(11)] + [WORDS, WORDS + " more", f"before {ITEM} behind", None, "", "x" * 40_000]


@pytest.fixture(scope="module")
def tables(spark):
    plain = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    return plain, plain.withColumns({name: F.lit(7) for name in NAMES})


def kept_names(df, added=()):
    return [c for c in df.columns if c.lower() not in added]


OPERATORS = {
    "lines": (lambda df: lines.dedup_lines(df), ("kept_text", "n_lines", "n_dropped")),
    "near": (lambda df: near.drop_near_copies(df), ()),
    "bpe": (lambda df: bpe.encode_texts(df, bpe.default_vocabulary()), ("ids",)),
    "leaks": (lambda df: leaks.drop_leaks(df, df.sparkSession.createDataFrame([(1, ITEM)], "item_id int, text string")), ()),
    "ppm": (lambda df: ppm.score_texts(df, "text", F.col("doc_id") > 3, df.columns), ppm.ADDED),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_change_nothing(tables, name):
    operator, added = OPERATORS[name]
    plain, clashing = (operator(df) for df in tables)
    assert plain.columns == ["doc_id", "text", *added]
    assert clashing.columns == [*kept_names(tables[1], added), *added]
    rows = clashing.collect()
    assert all(row[c] == 7 for row in rows for c in kept_names(tables[1], added) if c in NAMES)
    shared = ["doc_id", "text", *(c for c in added)]
    tidy = lambda row: tuple(round(row[c], 9) if isinstance(row[c], float) else row[c] for c in shared)
    assert sorted(map(tidy, rows), key=repr) == sorted(map(tidy, plain.collect()), key=repr)
    assert len(rows) == {"near": len(TEXTS) - 1, "leaks": len(TEXTS) - 1}.get(name, len(TEXTS))
