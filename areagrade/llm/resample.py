"""Target-distribution importance resampling, drawn by a distributed radix sort.

Features are hashed into buckets. The log ratio of each bucket's share in the target texts and in
all documents is an array of fixed size, so a document's weight is a mean of array cells. With
Gumbel noise on the weights, the highest scores are a draw without replacement.

The order comes from a least-significant-digit radix sort: rows have positions, dealt into blocks
of equal length. Each pass counts every digit of the composite key per block, adds the counts up
to global offsets, and gives each row its digit's offset plus its place among the block's rows
with that digit. A block is bounded whatever the keys are, so no digit is too common; there is no
sort of all rows by one key and no window over the whole table.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from areagrade.llm.columns import Apart
from areagrade.llm.wordhash import _LOWER, NO_WORD, Words, word_slices
from areagrade.llm.workers import importable
from areagrade.session import materialise

BUCKETS = 10_000
LEAST_WORDS = 20
SHARE = 25  # per cent drawn
SEED = "7:"
BLOCK_BITS = 14  # a block is 16,384 positions
DIGIT_BITS = 9
SHORT = 32  # bytes of words whose checksums are worked out in arrays
ADDED = ("n_features", "weight", "score", "rank")


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (c & np.uint32(1)))
    return c


_CRC = _crc_table()


def _zeros_table() -> np.ndarray:
    """[n][k][b]: a checksum whose byte k is b, others 0, behind n more bytes; it is linear in its bits."""
    byte = np.arange(256, dtype=np.uint32)
    at = np.stack([byte << np.uint32(8 * k) for k in range(4)])
    out = [at]
    for _ in range(SHORT):
        at = _CRC[at & np.uint32(255)] ^ (at >> np.uint32(8))
        out.append(at)
    return np.stack(out)


_ZEROS = _zeros_table()
_ALL = np.uint32(0xFFFFFFFF)


def _one_more(crc: np.ndarray, byte) -> np.ndarray:
    c = crc ^ _ALL
    return _CRC[(c ^ byte) & np.uint32(255)] ^ (c >> np.uint32(8)) ^ _ALL


def word_crcs(words: Words) -> np.ndarray:
    """crc32 of each lower-cased word."""
    data, length = _LOWER[words.data], words.end - words.start
    crc = np.zeros(len(length), dtype=np.uint32)
    at = np.flatnonzero(length <= SHORT)
    for j in range(SHORT):
        at = at[length[at] > j]
        if not len(at):
            break
        crc[at] = _one_more(crc[at], data[words.start[at] + j])
    for i in np.flatnonzero(length > SHORT):
        crc[i] = zlib.crc32(data[words.start[i] : words.end[i]])
    return crc


def joined_crcs(words: Words, crc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """crc32 of each word in ``left``, a blank and the next word, from the checksums of the two."""
    blank = _one_more(crc[left], np.uint32(32))
    length = (words.end - words.start)[left + 1]
    out = crc[left + 1].copy()
    short = np.flatnonzero(length <= SHORT)
    for k in range(4):
        out[short] ^= _ZEROS[length[short], k, (blank[short] >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(length > SHORT):
        word = _LOWER[words.data[words.start[left[i] + 1] : words.end[left[i] + 1]]]
        out[i] = zlib.crc32(word, int(blank[i]))
    return out


def feature_buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every word and every pair of neighbouring words of a slice."""
    crc = word_crcs(words)
    left = np.flatnonzero(words.text[1:] == words.text[:-1])
    every = np.concatenate([crc, joined_crcs(words, crc, left)])
    return (every % np.uint32(BUCKETS)).astype(np.int64), np.concatenate([words.text, words.text[left]])


def bucket_counts(docs: DataFrame, text: str) -> np.ndarray:
    """How many features of all texts fall into each bucket: an array of BUCKETS cells."""

    def run(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for words in word_slices(batch.column(0), NO_WORD):
                total += np.bincount(feature_buckets(words)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the shares, one added to each count."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + BUCKETS)) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(rows: DataFrame, text: str, gain: np.ndarray) -> DataFrame:
    """``rows`` without ``text`` and with ``words``, ``features`` and ``mean``, the floored mean gain."""
    at = rows.columns.index(text)
    cells = gain.astype(np.float64)  # sums below 2**53 are exact

    def run(batches):
        for batch in batches:
            kept = [c for i, c in enumerate(batch.columns) if i != at]
            names = [c for i, c in enumerate(batch.schema.names) if i != at]
            n_words, n, total = [], [], []
            for words in word_slices(batch.column(at), NO_WORD):
                bucket, of = feature_buckets(words)
                m = len(words.count)
                n_words.append(words.count.astype(np.int64))
                n.append(np.bincount(of, minlength=m).astype(np.int64))
                total.append(np.bincount(of, weights=cells[bucket], minlength=m).astype(np.int64))
            n_words, n, total = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_words, n, total))
            found = [pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*names, "words", "features", "mean"])

    fields = [f for f in rows.schema.fields if f.name != text]
    return rows.mapInArrow(run, StructType([*fields, *(StructField(c, LongType()) for c in ("words", "features", "mean"))]))


def _digits(sizes: Sequence[int], bits: int) -> list[tuple[int, int, int]]:
    """(key, shift, width) of every pass, the least significant first; each key lies between 0 and its size."""
    plan = []
    for i in reversed(range(len(sizes))):
        passes = -(-sizes[i].bit_length() // bits)
        width = -(-sizes[i].bit_length() // max(passes, 1))
        plan += [(i, width * k, width) for k in range(passes)]
    return plan or [(0, 0, 1)]  # one pass at least makes the positions gapless


def _distances(rows: DataFrame, keys: Sequence[str]) -> list[tuple[Column, int]]:
    """Each key as its distance from the least value, with the greatest one; before a key with nulls, whether it is null."""
    seen = rows.agg(*(f(c).alias(f"{name}{i}") for i, c in enumerate(keys) for name, f in (("low", F.min), ("high", F.max), ("some", F.count))), F.count("*").alias("n")).first()
    out = []
    for i, c in enumerate(keys):
        low, high = seen[f"low{i}"] or 0, seen[f"high{i}"] or 0
        if seen[f"some{i}"] < seen["n"]:
            out.append((F.col(c).isNull().cast("long"), 1))
        if high - low < 1 << 63:
            away, size = F.col(c) - F.lit(low).cast("long"), high - low
        else:  # with the sign bit turned, numbers without a sign have the same order
            away, size = F.col(c).bitwiseXOR(F.lit(-(1 << 63)).cast("long")), (1 << 64) - 1
        out.append((F.coalesce(away, F.lit(0).cast("long")), size))
    return out


def radix_ranks(rows: DataFrame, row: str, keys: Sequence[str], block_bits: int = BLOCK_BITS, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """(row, rank): ranks from 1 in ascending order of the long columns ``keys``; nulls come last in each.

    The first key counts most. Rows that are equal in all keys get neighbouring ranks in any order.
    There are as many passes as the ranges of the keys have digits; each shuffles the rows by
    (block, digit) and adds up their counts. The blocks' counts are at most 2**digit_bits a block,
    and the prefix sums over them run apart for each digit. No rows give no ranks.
    """
    parts = _distances(rows, keys)
    rows = rows.select(F.col(row).alias("row"), *(c.alias(f"key{i}") for i, (c, _) in enumerate(parts)))
    # Positions to begin with are those in which the rows are written, gapless only within a partition.
    rows = materialise(rows.withColumn("place", F.monotonically_increasing_id()))
    for key, shift, width in _digits([size for _, size in parts], digit_bits):
        digit = F.shiftrightunsigned(f"key{key}", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        dealt = rows.withColumns({"block": F.shiftright("place", block_bits), "digit": digit})
        counts = dealt.groupBy("block", "digit").agg(F.count("*").alias("n"))
        smaller = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        totals = counts.groupBy("digit").agg(F.sum("n").alias("n"))  # at most 2**digit_bits rows
        totals = totals.select("digit", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("base"))
        earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("block", "digit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("within"))
        offsets = offsets.join(totals, "digit").select("block", "digit", (F.col("base") + F.col("within")).alias("offset"))
        among = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place")) - 1
        moved = dealt.withColumn("among", among).join(offsets, ["block", "digit"])
        rows = materialise(moved.select(*rows.columns[:-1], (F.col("offset") + F.col("among")).alias("place")))
    return rows.select("row", (F.col("place") + 1).alias("rank"))


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of Gumbel noise from the SHA-256 of the seed and the id; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    kept: Sequence[str] | None = None,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """The ``kept`` columns (default: all) with n_features, weight, score and rank of each row.

    Of the rows with at least ``least_words`` words, ``share`` per cent with the highest scores are
    drawn (rounded down), ties to the smaller id, null ids last; ``rank`` is their place from 1 and null
    for all others. ``doc_id`` is a whole number. A null or empty text has no features and weight 0.
    Each row counts, repeated ones too: rows with equal id and score are interchangeable. Without
    target texts all buckets gain by their rarity alone; an empty table gives no rows. Columns of
    ``docs`` with one of the four names are replaced.

    Sent to tasks: an array of BUCKETS numbers. Texts are read twice and never shuffled.
    """
    importable(docs.sparkSession)
    apart = Apart(docs, ADDED)
    wanted = {k: c for k, c in apart.kept.items() if kept is None or c in kept}
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    rows = apart.rows.select(*wanted, F.col(apart.of(doc_id)).cast("long").alias("id"), F.col(apart.of(text)).alias("body"))
    score = F.col("mean") + noise(F.col("id"), seed)
    scored = materialise(weighted(rows, "body", gain).withColumns({"score": score, "row": F.monotonically_increasing_id()}))
    known = materialise(scored.where(F.col("words") >= least_words).select("row", (-F.col("score")).alias("high"), "id"))
    ranks = radix_ranks(known, "row", ["high", "id"])
    drawn = ranks.where(F.col("rank") <= known.count() * share // 100)
    own = [F.col(k).alias(c) for k, c in wanted.items()]
    features, weight = F.col("features").alias("n_features"), F.col("mean").alias("weight")
    return scored.join(drawn, "row", "left").select(*own, features, weight, "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return resample(docs, read_table(spark, sf, "benchmark"), kept=["doc_id"])


def _sql_crc_table() -> str:
    step = "SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({})"
    rows = "SELECT i, i AS c FROM range(256) t(i)"
    for _ in range(8):
        rows = step.format(rows)
    return f"SELECT list(c ORDER BY i) AS crc FROM ({rows})"


OP12_SQL = rf"""
WITH crc_table AS MATERIALIZED ({_sql_crc_table()}),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark
), worded AS (
  SELECT side, r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS MATERIALIZED (
  SELECT side, r, f, count(*) AS n FROM (
    SELECT side, r, unnest(w) AS f FROM worded
    UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded
  ) GROUP BY ALL
), hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce(
      list_transform(range(0, octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
      lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), crc_table
), counted AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM features JOIN hashed USING (f) GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
    ((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM counted) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM counted
), weights AS (
  SELECT r, sum(n * gain) AS total, sum(n) AS n_features FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT d.r, d.doc_id, len(d.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(CAST(floor(total::DECIMAL(38, 0) / n_features) AS BIGINT), 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM worded d LEFT JOIN weights USING (r) WHERE d.side = 0
), ranked AS (
  SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE words >= 20
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, weight + noise AS score,
  CASE WHEN rank <= (25 * n) // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
