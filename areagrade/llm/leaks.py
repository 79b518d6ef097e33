"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areagrade.llm.columns import Apart
from areagrade.llm.near import text_key
from areagrade.llm.wordhash import NO_WORD, word_slices
from areagrade.llm.workers import importable

SEED_WORDS = 3
LEAST_SEEDS = 2
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 23  # the filter in front of the join has 2**23 bits, whatever the benchmark's size


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int, int]:
    """Best local alignment of two word sequences: (score, matches, first word, past-last word)."""
    n, m = len(item), len(words)
    table = np.zeros((n + 1, m + 1), dtype=np.int64)
    slope = np.arange(m + 1) * -GAP
    for i in range(1, n + 1):
        pair = np.where(words == item[i - 1], MATCH, MISMATCH)
        row = table[i]
        np.maximum(table[i - 1, 1:] + GAP, table[i - 1, :-1] + pair, out=row[1:])
        np.maximum(row, 0, out=row)
        # A gap of any length along the row, from the best start before it.
        np.maximum(row, np.maximum.accumulate(row + slope) - slope, out=row)
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, end, matches = int(table[i, j]), int(j), 0
    while i and j and table[i, j] > 0:
        same = item[i - 1] == words[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += int(same)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matches, int(j), end


def _item_words(items: DataFrame, text: str) -> DataFrame:
    """(k1, k2, words): each different item text that has words, as hashes of its words."""
    keyed = items.select(*text_key(F.col(text)), F.col(text).alias("_text")).toDF("k1", "k2", "_text")

    def run(batches):
        for batch in batches:
            out = [w.hash[a:b].tobytes() for w in word_slices(batch.column(2), NO_WORD) for a, b in zip(w.offset[:-1], w.offset[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], names=["k1", "k2", "words"])

    return keyed.dropDuplicates(["k1", "k2"]).mapInArrow(run, "k1 long, k2 long, words binary").where("octet_length(words) > 0")


def _grams(rows: DataFrame, text: str, n: int, bits: np.ndarray | None = None) -> DataFrame:
    """(k1, k2, pos, gram) of all n-grams of words, or of those that pass the filter."""

    def run(batches):
        passes = None if bits is None else np.unpackbits(bits, bitorder="little").view(bool)
        mask = np.uint64((1 << FILTER_BITS) - 1)
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for words in word_slices(batch.column(2), NO_WORD):
                gram, at = words.ngrams(n)
                if passes is not None:
                    kept = passes[gram & mask]
                    gram, at = gram[kept], at[kept]
                text_no = words.text[at]
                columns = [*(k[words.first + text_no] for k in keys), at - words.offset[text_no], gram.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "pos", "gram"])

    keyed = rows.select(*text_key(F.col(text)), F.col(text).alias("_text"))
    return keyed.mapInArrow(run, "k1 long, k2 long, pos long, gram long")


def _filter_bits(grams: DataFrame) -> np.ndarray:
    """A bit for the low bits of each gram: at most 2**(FILTER_BITS - 6) rows come to the driver."""
    low = F.col("gram").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    word = F.expr("shiftleft(1L, cast(low % 64 as int))")
    rows = grams.select(low.alias("low")).groupBy(F.expr("low div 64").alias("at")).agg(F.bit_or(word).alias("word")).collect()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for row in rows:
        bits[row["at"]] = row["word"]
    return bits.view(np.uint8)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    threshold: float = THRESHOLD,
    least_seeds: int = LEAST_SEEDS,
) -> DataFrame:
    """(doc_id, item_id, score, matched_words, item_words, first_word, last_word) of each leak.

    Words are runs of letters and digits (and all bytes beyond ASCII), A-Z lower-cased. Every
    word n-gram of an item is a seed, so an edited copy is met by whichever it left whole. Texts
    that share ``least_seeds`` seeds with an item (one, if it has no more) are aligned with it around them;
    ``score`` is the best local alignment's as a share of the whole item's, and ``threshold`` of
    it makes a leak. ``last_word`` is past the last aligned word.

    The texts' n-grams first pass a filter of fixed size built from the items, so only possible
    hits are shuffled; the join is exact. Equal texts are aligned once and each of their rows
    gets the result, rows of equal ids too. A null text has no words; an item without words
    finds nothing; items of equal text are each reported. Empty tables give no rows.
    """
    importable(docs.sparkSession)
    known = _item_words(items, item_text).checkpoint()
    seeds = _grams(items, item_text, SEED_WORDS).distinct().checkpoint()
    hits = _grams(docs, text, SEED_WORDS, _filter_bits(seeds)).distinct()
    hits = hits.join(seeds.select("gram").distinct(), "gram", "left_semi").toDF("gram", "t1", "t2", "at").checkpoint()
    chosen = seeds.withColumn("seeds", F.count("*").over(Window.partitionBy("k1", "k2"))).join(
        known.select("k1", "k2", (F.octet_length("words") / 8).cast("long").alias("n")), ["k1", "k2"]
    )
    met = hits.join(chosen, "gram").select("t1", "t2", "k1", "k2", "n", "seeds", "pos", (F.col("at") - F.col("pos")).alias("shift"))
    pairs = met.groupBy("t1", "t2", "k1", "k2", "n", "seeds", F.floor(F.col("shift") / F.col("n")).alias("region")).agg(
        F.min("shift").alias("low"), F.max("shift").alias("high"), F.collect_set("pos").alias("pos")
    )
    near = pairs.groupBy("t1", "t2", "k1", "k2", "n", "seeds").agg(
        F.collect_list(F.struct("low", "high")).alias("spans"), F.size(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("found")
    )
    near = near.where(F.col("found") >= F.least(F.lit(least_seeds), F.col("seeds"))).join(known, ["k1", "k2"])
    by_text = near.groupBy("t1", "t2").agg(F.collect_list(F.struct("k1", "k2", "words", "spans")).alias("near"))
    t1, t2 = text_key(F.col(text))
    texts = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text).alias("_text"))
    wanted = texts.join(by_text.select("t1", "t2"), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"]).join(by_text, ["t1", "t2"])

    def score(frames):
        for frame in frames:
            out = []
            words = (w.hash[a:b] for w in word_slices(pa.array(frame["_text"], pa.string()), NO_WORD) for a, b in zip(w.offset[:-1], w.offset[1:]))
            for key1, key2, near_items, own in zip(frame["t1"], frame["t2"], frame["near"], words):
                for x in near_items:
                    item = np.frombuffer(x["words"], np.uint64)
                    best = max(_aligned_spans(item, own, x["spans"]))
                    out.append((key1, key2, x["k1"], x["k2"], best[0] / (MATCH * len(item)), best[1], len(item), -best[2], best[3]))
            yield pd.DataFrame(out, columns=["t1", "t2", "k1", "k2", "score", "matched_words", "item_words", "first_word", "last_word"])

    schema = "t1 long, t2 long, k1 long, k2 long, score double, matched_words long, item_words long, first_word long, last_word long"
    leaks = wanted.mapInPandas(score, schema).where(F.col("score") >= threshold).checkpoint()
    i1, i2 = text_key(F.col(item_text))
    named = items.select(F.col(item_id).alias("item_id"), i1.alias("k1"), i2.alias("k2"))
    ids = docs.select(F.col(doc_id).alias("doc_id"), t1.alias("t1"), t2.alias("t2"))
    return ids.join(leaks, ["t1", "t2"]).join(named, ["k1", "k2"]).select(
        "doc_id", "item_id", "score", "matched_words", "item_words", "first_word", "last_word"
    )


def _aligned_spans(item: np.ndarray, own: np.ndarray, spans) -> list[tuple[int, int, int, int]]:
    """The alignment around each span, its first word negative so that the earliest of the best wins."""
    margin = len(item) // 2 + 8
    out = []
    for span in spans:
        low = max(0, span["low"] - margin)
        score, matches, first, end = align(item, own[low : span["high"] + len(item) + margin])
        out.append((score, matches, -(low + first), low + end))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose text holds a leak; all columns stay, whatever their names."""
    apart = Apart(docs, ())
    docs, text = apart.rows, apart.of(text)
    t1, t2 = text_key(F.col(text))
    keyed = docs.withColumns({"_t1": t1, "_t2": t2})
    by_text = docs.select(F.struct(t1, t2).alias("key"), F.col(text).alias("text"))
    leaked = find_leaks(by_text, items, "text", "key", **options).select("doc_id._t1", "doc_id._t2").distinct()
    return keyed.join(leaked, ["_t1", "_t2"], "left_anti").select(*apart.back())


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return find_leaks(docs, read_table(spark, sf, "benchmark").select("item_id", "text"))
