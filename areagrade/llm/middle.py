"""Fill-in-middle transformation: cuts between units of a text, found by counts of its chunks.

A rolling hash cuts each text into chunks at places that depend on the 32 bytes before them, so
texts that share a passage share its chunks. A chunk's summary (words that it holds a part of,
white space at its two ends, code points) is kept under its content, and a chunk seen before is
not read again. Summaries of neighbours combine: a word that runs across a boundary counts once.
The running count tells the chunk in which a cut lies; only this one is looked into.

A unit is a word with the white space before it; white space at a text's end is one more.
"""

from __future__ import annotations

import re
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from areagrade.llm.columns import Apart
from areagrade.llm.wordhash import buffers, mixed
from areagrade.llm.workers import importable

WINDOW = 32  # bytes that decide on a cut behind them
MEAN_BITS = 10  # chunks of about 1 KiB
LEAST, MOST = 128, 8 << 10  # bytes of a chunk, but for the last of a text
READ = 1 << 20  # bytes hashed at a time
CACHE_BYTES = 32 << 20  # contents that a worker remembers
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42:"
PLAIN_FROM, SPM_BELOW = 50, 80  # per cent
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")

_GEAR = (mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def rolled(data: np.ndarray) -> np.ndarray:
    """At each byte a hash of the WINDOW bytes that end there; of fewer at the start."""
    h = _GEAR[data]
    width = 1
    while width < WINDOW:  # a window of twice the width is two, the earlier one shifted
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(text: np.ndarray) -> list[int]:
    """Where the chunks of a text end, all between two characters; the last is the text's end."""
    n = len(text)
    hits = []
    for low in range(0, n, READ):
        first = max(0, low - WINDOW + 1)
        part = rolled(text[first : low + READ])[low - first :]
        hits.append(np.flatnonzero(part >> np.uint32(32 - MEAN_BITS) == 0) + low + 1)
    ends, last = [], 0
    for at in [*(np.concatenate(hits).tolist() if hits else ()), n]:
        while at - last > MOST:
            last = _between(text, last + MOST)
            ends.append(last)
        if at < n and at - last >= LEAST:
            at = _between(text, at)
        elif at < n:
            continue
        if at > last:
            last = at
            ends.append(last)
    return ends


def _between(text: np.ndarray, at: int) -> int:
    """The last place up to ``at`` that is not inside a character."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


class Summary(NamedTuple):
    words: int  # runs of other than white space
    opens: bool  # begins inside a word
    closes: bool  # ends inside a word
    chars: int

    def __add__(self, other: Summary) -> Summary:
        if not self.chars or not other.chars:
            return self if self.chars else other
        joint = self.closes and other.opens
        return Summary(self.words + other.words - joint, self.opens, other.closes, self.chars + other.chars)


EMPTY = Summary(0, False, False, 0)


def summary(chunk: bytes) -> Summary:
    blank = b" \t\n\x0b\x0c\r"
    return Summary(len(chunk.split()), chunk[0] not in blank, chunk[-1] not in blank, len(chunk.decode()))


class Memo:
    """Summaries by content. The dictionary compares contents, so a clash of hashes cannot mix two up.

    Of two generations the older is forgotten when the younger is full; what is used moves up.
    """

    def __init__(self, most: int = CACHE_BYTES):
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}
        self.most, self.size, self.made = most, 0, 0

    def __call__(self, chunk: bytes) -> Summary:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                found = summary(chunk)
                self.made += 1
            self.size += len(chunk)
            if self.size > self.most // 2:
                self.old, self.young, self.size = self.young, {}, len(chunk)
            self.young[chunk] = found
        return found


class Chunked:
    """A text as its chunks' summaries and the running counts before them."""

    def __init__(self, text: np.ndarray, memo: Memo):
        ends = chunk_ends(text)
        self.chunks = [text[a:b].tobytes() for a, b in zip([0, *ends], ends)]
        self.parts = [memo(c) for c in self.chunks]
        self.before = [EMPTY]
        for part in self.parts:
            self.before.append(self.before[-1] + part)
        self.words = self.before[-1].words
        self.units = self.words + (bool(self.parts) and not self.parts[-1].closes)
        self.starts = np.array([s.words for s in self.before])

    def chars_of(self, units: int) -> int:
        """Code points of the first ``units`` units."""
        if units == 0:
            return 0
        if units > self.words:
            return self.before[-1].chars
        at = int(np.searchsorted(self.starts, units)) - 1  # the chunk in which the last word begins
        carried = self.before[at].closes and self.parts[at].opens
        chunk = self.chunks[at]
        end = next(islice(_WORD.finditer(chunk), units - 1 - int(self.starts[at]) + carried, None)).end()
        while end == len(chunk) and at + 1 < len(self.chunks):  # it may go on in the next one
            at += 1
            chunk, part = self.chunks[at], self.parts[at]
            inside = part.words == 1 and part.opens and part.closes
            end = len(chunk) if inside else _BLANK.search(chunk).start()
        return self.before[at].chars + len(chunk[:end].decode())


def cut_places(docs: DataFrame, text: str, first: str, second: str) -> DataFrame:
    """Adds ``units`` of each text and the code points before two cuts, ``low`` and ``high``.

    ``first`` and ``second`` are numbers whose remainders by units + 1 are the cuts, in units.
    One pass over the rows where they lie: nothing is shuffled, a worker holds a batch and its Memo.
    """
    at = [docs.columns.index(c) for c in (text, first, second)]

    def run(batches):
        memo = Memo()
        for batch in batches:
            data, bounds = buffers(batch.column(at[0]))
            found = []
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                whole = Chunked(data[a:b], memo)
                cuts = sorted(batch.column(k)[i].as_py() % (whole.units + 1) for k in at[1:])
                found.append((whole.units, *(whole.chars_of(c) for c in cuts)))
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "units", "low", "high"])

    added = [StructField(c, LongType()) for c in ("units", "low", "high")]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to every row.

    Four numbers from the SHA-256 of the seed and the id decide on the cuts and the form: "plain"
    leaves the text as it is, "psm" and "spm" put its suffix before the middle. An empty text, or
    one that holds a mark itself, is plain. A null text is the empty one, a null id counts as the
    empty string. Rows with equal ids are cut alike, each by its own text; repeated rows stay, an
    empty table gives no rows, and columns of these five names are replaced.
    """
    importable(docs.sparkSession)
    apart = Apart(docs, ADDED)
    body = F.col(apart.of(text))
    digest = F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col(apart.of(doc_id)).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = apart.rows.withColumn("body", F.coalesce(body, F.lit(""))).withColumn("digest", digest)
    rows = cut_places(rows.withColumns({"h1": h[0], "h2": h[1]}), "body", "h1", "h2")
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("body", F.lit(mark))
    plain = (F.col("body") == "") | marked | (h[2] % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = rows.withColumn("form_", form)
    one = F.lit(1)
    prefix = F.substr("body", one, F.col("low"))
    middle = F.substr("body", F.col("low") + one, F.col("high") - F.col("low"))
    suffix = F.substr("body", F.col("high") + one)
    parts = {"psm": (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), "spm": (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)}
    output = F.col("body")
    for name, order in parts.items():
        joined = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in order))
        output = F.when(F.col("form_") == name, joined).otherwise(output)
    cut = F.col("form_") != "plain"
    return rows.select(
        *apart.back(),
        F.col("units").alias("n"),
        F.col("form_").alias("form"),
        F.when(cut, F.col("low")).alias("prefix_chars"),
        F.when(cut, F.col("high") - F.col("low")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given, from what it made of it.

    The text holds no mark, and no mark begins inside another, so each is found where it was set.
    """
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def around(mark: str, rest: Column) -> tuple[Column, Column]:
        return F.substring_index(rest, mark, 1), F.substring_index(rest, mark, -1)

    prefix, rest = around(SUFFIX, body)
    suffix, middle = around(MIDDLE, rest)
    psm = F.concat(prefix, middle, suffix)
    suffix, rest = around(PREFIX, body)
    prefix, middle = around(MIDDLE, rest)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    made = fill_in_middle(read_table(spark, sf, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS body, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), units AS (
  SELECT doc_id, body, regexp_extract_all(body, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4
  FROM texts
), cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
), made AS (
  SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE body END AS o FROM parts
), marks AS (
  SELECT *, strpos(o, '<P>') AS at_p, strpos(o, '<S>') AS at_s, strpos(o, '<M>') AS at_m FROM made
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'psm' THEN substr(o, 4, at_s - 4) || substr(o, at_m + 3) || substr(o, at_s + 3, at_m - at_s - 3)
                        WHEN 'spm' THEN substr(o, at_p + 3, at_m - at_p - 3) || substr(o, at_m + 3) || substr(o, 4, at_p - 4)
                        ELSE o END) AS restored_sha256
FROM marks
"""
