"""BPE encoding and decoding with tree concatenation of long texts.

A text up to ``piece_chars`` is encoded where it lies. A longer one is cut into pieces that
become rows of their own: between two units of the vocabulary's split pattern, where the
pieces are independent of each other, and inside a unit that is longer than ``unit_bytes`` by
halving its bytes. The pieces are encoded in parallel; the halves of a unit are then joined
pairwise, level by level: a window around each join is encoded anew and grows until its first
and last token are the ones that both sides already have there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from areagrade.llm.columns import Apart
from areagrade.llm.workers import importable

# The split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


ALONE = -1


class Vocabulary:
    """A byte-level BPE vocabulary file with its tokens as bytes."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][m] for m in merged]
        if order != sorted(order):
            raise ValueError(f"the token ids of {path} do not follow its merges")
        self.coder = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.units = regex.compile(PATTERN)
        self.specials = regex.compile("|".join(map(regex.escape, special))) if special else None

    def encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, allowed_special="all").astype("<u4")

    def encode_unit(self, data: bytes) -> list[int]:
        """Merge bytes that lie within one unit."""
        return self.coder._encode_single_piece(data)

    def decode(self, ids: np.ndarray) -> str:
        return self.coder.decode_bytes(ids.tolist()).decode("utf-8", "replace")

    def pieces(self, text: str, piece_chars: int, unit_bytes: int) -> Iterator[tuple[int, bytes]]:
        """(unit number, bytes): 0 and whole units, ALONE and one unit, or a long unit's number and a part of it.

        Whole units end where no white space does: at the end of a text, white space would be
        one unit that may be two before another word.
        """
        at, number = 0, 0
        marks = [*self.specials.finditer(text)] if self.specials else []
        for low, high, end in zip([0, *(m.end() for m in marks)], [*(m.start() for m in marks), len(text)], [*(m.end() for m in marks), len(text)]):
            at = low
            tail = []  # where the units of white space begin that end the open piece
            for m in self.units.finditer(text, low, high):
                unit = m[0]
                if len(unit) * 4 > unit_bytes and len(data := unit.encode()) > unit_bytes:
                    edges = [at, *tail, m.start()]
                    for i, (a, b) in enumerate(zip(edges, edges[1:])):
                        if a < b:
                            yield (0 if i == 0 else ALONE), text[a:b].encode()
                    number += 1
                    yield from ((number, part) for part in halves(data, unit_bytes))
                    at, tail = m.end(), []
                    continue
                if m.start() - at >= piece_chars and not tail:
                    yield 0, text[at : m.start()].encode()
                    at = m.start()
                tail = [*tail, m.start()] if unit[-1].isspace() else []
            if at < end:
                yield 0, text[at:end].encode()


def halves(data: bytes, most: int) -> list[bytes]:
    """Parts of at most ``most`` bytes, as many as a power of two."""
    if len(data) <= most:
        return [data]
    depth = (len(data) // most).bit_length()
    edges = [len(data) * i // (1 << depth) for i in range((1 << depth) + 1)]
    return [data[a:b] for a, b in zip(edges, edges[1:])]


def join_tokens(left: list[int], right: list[int], vocabulary: Vocabulary, window: int = 4) -> list[int]:
    """Tokens of two neighbouring parts of one unit as the whole would be encoded.

    Tokens are the encoding of their bytes if each pair of neighbours is. So a window that
    begins and ends with the tokens the sides have there settles all pairs across the join.
    """
    n = window
    while left and right:
        a, b = max(0, len(left) - n), min(len(right), n)
        joined = vocabulary.encode_unit(vocabulary.coder.decode_bytes(left[a:] + right[:b]))
        if (a == 0 or joined[0] == left[a]) and (b == len(right) or joined[-1] == right[b - 1]):
            return left[:a] + joined + right[b:]
        n *= 2
    return left + right


def joined_parts(parts: list[list[int]], vocabulary: Vocabulary) -> list[int]:
    """Join neighbouring parts pairwise until one is left."""
    while len(parts) > 1:
        pairs = [join_tokens(a, b, vocabulary) for a, b in zip(parts[::2], parts[1::2])]
        parts = pairs + parts[len(parts) & ~1 :]
    return parts[0] if parts else []


@cache
def vocabulary_of(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def _encode_rows(docs: DataFrame, text: str, vocabulary: str) -> DataFrame:
    def run(batches):
        v = vocabulary_of(vocabulary)
        for batch in batches:
            ids = (v.encode(t or "").tobytes() for t in _values(batch, text))
            yield _with_column(batch, "ids", pa.array(ids, pa.binary()))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", BinaryType())]))


def _values(batch: pa.RecordBatch, name: str) -> Iterator:
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(name)))


def encode_texts(
    docs: DataFrame, vocabulary: str, text: str = "text", piece_chars: int = 1 << 15, unit_bytes: int = 1 << 12
) -> DataFrame:
    """Adds ``ids``: the tokens of each text as little-endian unsigned 32-bit integers.

    The same ids as the tokenizers library gives without added special tokens; the special
    token's own string in a text is that token. A null or empty text has no tokens (empty
    binary). Repeated rows stay; an ``ids`` column of ``docs`` is replaced. ``vocabulary`` is
    the path of a byte-level BPE file that every executor can read.

    Each long text is taken once, however many rows have it, and its rows get the ids by a
    digest of the text. All parts of one text meet in one task, as they do in the row itself.
    """
    importable(docs.sparkSession)
    apart = Apart(docs, ("ids",))
    docs, text = apart.rows, apart.of(text)
    is_long = F.coalesce(F.char_length(text), F.lit(0)) > piece_chars
    short = _encode_rows(docs.where(~is_long), text, vocabulary)
    digest = F.sha2(F.col(text), 256).alias("_text_id")
    long_texts = docs.where(is_long).select(digest, F.col(text).alias("_text")).groupBy("_text_id").agg(F.first("_text").alias("_text"))

    def cut(frames):
        v = vocabulary_of(vocabulary)
        for frame in frames:
            for key, value in zip(frame["_text_id"], frame["_text"]):
                rows = [(key, i, unit, data) for i, (unit, data) in enumerate(v.pieces(value, piece_chars, unit_bytes))]
                yield pd.DataFrame(rows, columns=["_text_id", "no", "unit", "data"])

    def encode(frames):
        v = vocabulary_of(vocabulary)
        for frame in frames:
            ids = [(v.encode_unit(d) if u else v.encode(d.decode()).tolist()) for u, d in zip(frame["unit"], frame["data"])]
            yield frame[["_text_id", "no", "unit"]].assign(ids=[np.array(x, "<u4").tobytes() for x in ids])

    def join(frame):
        v = vocabulary_of(vocabulary)
        frame = frame.sort_values("no")
        out, parts, open_unit = [], [], 0
        for unit, ids in [*zip(frame["unit"], frame["ids"]), (0, b"")]:
            if unit != open_unit and parts:
                out.append(np.array(joined_parts(parts, v), "<u4").tobytes())
                parts = []
            open_unit = unit
            if unit > 0:
                parts.append(np.frombuffer(ids, "<u4").tolist())
            else:
                out.append(ids)
        return pd.DataFrame({"_text_id": frame["_text_id"].iloc[:1], "ids": [b"".join(out)]})

    pieces = long_texts.mapInPandas(cut, "_text_id string, no long, unit long, data binary")
    dealt = pieces.repartition("_text_id", "no").mapInPandas(encode, "_text_id string, no long, unit long, ids binary")
    whole = dealt.groupBy("_text_id").applyInPandas(join, "_text_id string, ids binary")
    long_rows = docs.where(is_long).withColumn("_text_id", digest).join(whole, "_text_id").drop("_text_id")
    return short.unionByName(long_rows).select(*apart.back(), "ids")


def decode_ids(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids; bytes that are no UTF-8 become U+FFFD, null ids null."""
    importable(rows.sparkSession)
    rows = rows.drop("decoded")

    def run(batches):
        v = vocabulary_of(vocabulary)
        for batch in batches:
            texts = [None if x is None else v.decode(np.frombuffer(x, "<u4")) for x in _values(batch, ids)]
            yield _with_column(batch, "decoded", pa.array(texts, pa.string()))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = (read_table(spark, sf, "documents") if docs is None else docs).select("doc_id", "text")
    coded = encode_texts(docs, default_vocabulary()).select("doc_id", "ids")
    return decode_ids(coded, default_vocabulary()).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
