"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets verify them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areagrade.llm.columns import Apart
from areagrade.llm.graph import components
from areagrade.llm.wordhash import mixed, word_slices
from areagrade.llm.workers import importable

SIMILARITY = 0.8
NGRAM = 5
RECALL = 0.999
BLOCK = 256  # members of a block when candidates are verified
BLOCK_BYTES = 16 << 20
COLUMNS = 8192


def band_plan(similarity: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands find a pair of that similarity with that probability."""
    for rows in range(most_hashes, 0, -1):
        miss = 1 - similarity**rows
        bands = most_hashes // rows
        if 1 - miss**bands >= recall:
            return next(b for b in range(1, bands + 1) if 1 - miss**b >= recall), rows
    raise ValueError("no banding reaches the recall with so few hashes")


def gram_sets(words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted n-gram sets of a slice of texts, one after the other, and their bounds."""
    gram, at = words.ngrams(n)
    counts = np.bincount(words.text[at], minlength=len(words.count))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(bounds[:-1], bounds[1:]):
        gram[a:b].sort()
    fresh = np.ones(len(gram), dtype=bool)
    fresh[1:] = gram[1:] != gram[:-1]
    fresh[bounds[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return gram[fresh], kept[bounds]


def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(1, k + 1, dtype=np.uint64)
    return mixed(at * np.uint64(0xA0761D6478BD642F)), mixed(at * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def _signed(texts, n: int, bands: int, rows: int) -> tuple[list[bytes | None], list[list[int] | None]]:
    """The 128-bit digest of each text's n-gram set, and a hash for each band; null without words."""
    flip, factor = _seeds(bands * rows)
    digests: list[bytes | None] = []
    hashes: list[list[int] | None] = []
    for words in word_slices(texts):
        gram, bounds = gram_sets(words, n)
        filled = np.flatnonzero(np.diff(bounds))
        starts = bounds[:-1][filled]
        band = np.zeros((len(filled), bands), dtype=np.uint64)
        pair = np.zeros((len(filled), 2), dtype=np.uint64)
        if len(filled):
            for k in range(bands * rows):
                least = np.minimum.reduceat((gram ^ flip[k]) * factor[k], starts)
                band[:, k // rows] = mixed(band[:, k // rows] + least + np.uint64(k + 1))
            pair[:, 0] = np.add.reduceat(mixed(gram ^ np.uint64(0x589965CC75374CC3)), starts)
            pair[:, 1] = np.add.reduceat(mixed(gram + np.uint64(0x1D8E4E27C47D124F)), starts)
        raw, signed = np.ascontiguousarray(pair).tobytes(), band.view(np.int64).tolist()
        at = {int(i): j for j, i in enumerate(filled)}
        for i in range(len(words.count)):
            j = at.get(i)
            digests.append(None if j is None else raw[16 * j : 16 * j + 16])
            hashes.append(None if j is None else signed[j])
    return digests, hashes


def text_key(text: Column) -> list[Column]:
    """128 bits that equal texts share."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("_t1"), F.xxhash64(F.lit("second"), body).alias("_t2")]


def signatures(docs: DataFrame, text: str, doc_id: str, ngram: int, bands: int, rows: int) -> DataFrame:
    """(_id, _t1, _t2, digest, bands) for each row."""
    plain = docs.select(F.col(doc_id).alias("_id"), *text_key(F.col(text)), F.col(text).alias("_text"))

    def run(batches):
        for batch in batches:
            digests, hashes = _signed(batch.column(3), ngram, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["_id", "_t1", "_t2", "digest", "bands"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return plain.mapInArrow(run, f"_id {kind}, _t1 long, _t2 long, digest binary, bands array<long>")


def candidate_sets(signed: DataFrame) -> DataFrame:
    """(digest, copies, _t1, _t2, part): different sets that share a band with another one.

    ``part`` is the connected component over shared bands. No pairs are made: each bucket of a
    band ties its members to the least one.
    """
    sets = signed.where("digest is not null").groupBy("digest").agg(
        F.count("*").alias("copies"), F.min(F.struct("_t1", "_t2")).alias("t"), F.first("bands").alias("bands")
    )
    sets = sets.checkpoint()
    buckets = sets.select("digest", F.posexplode("bands").alias("band", "hash"))
    shared = buckets.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("digest").alias("least")).where("n > 1")
    edges = buckets.join(shared, ["band", "hash"]).select(F.col("digest").alias("u"), F.col("least").alias("v"))
    # A star's centre is in no row of its own, so it is added.
    parts = components(edges.distinct())
    members = parts.unionByName(parts.select(F.col("root").alias("u"), "root").distinct())
    return sets.join(members.withColumnRenamed("u", "digest"), "digest").select(
        "digest", "copies", F.col("t._t1").alias("_t1"), F.col("t._t2").alias("_t2"), F.col("root").alias("part")
    )


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of each left with each right set."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    every = [*left, *right]
    values, column = np.unique(np.concatenate(every), return_inverse=True)
    row = np.repeat(np.arange(len(every)), [len(s) for s in every])
    several = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(several) - 1
    kept = several[column]
    row, column = row[kept], number[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(several.sum()), COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        grid = np.zeros((len(every), COLUMNS), dtype=np.float32)
        grid[row[a:b], column[a:b] - first] = 1
        out += grid[: len(left)] @ grid[len(left) :].T
    return out


def _verified(frame: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links between the two blocks of a pair of blocks, or inside one block."""
    frame = frame.sort_values("digest", kind="stable").reset_index(drop=True)
    sets = [np.frombuffer(x, np.uint64) for x in frame["grams"]]
    one, two = int(frame["one"].iloc[0]), int(frame["two"].iloc[0])
    block = frame["block"].to_numpy()
    left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
    n = np.array([len(s) for s in sets])
    both = _shared_counts([sets[i] for i in left], [sets[i] for i in right])
    linked = both >= similarity * (n[left][:, None] + n[right][None, :] - both) - 1e-6
    if one == two:
        np.fill_diagonal(linked, False)
    copies = frame["copies"].to_numpy()
    links, doc_links = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
    links[left], doc_links[left] = linked.sum(1), linked @ copies[right]
    if one != two:
        links[right], doc_links[right] = linked.sum(0), copies[left] @ linked
    label = np.arange(len(sets))
    big = len(sets)
    while True:
        new = label.copy()
        if linked.size:
            new[left] = np.minimum(new[left], np.where(linked, label[right][None, :], big).min(1))
            new[right] = np.minimum(new[right], np.where(linked, label[left][:, None], big).min(0))
        if (new == label).all():
            break
        label = new
    found = np.flatnonzero(links)
    digests = frame["digest"].to_numpy()
    return pd.DataFrame({"u": digests[found], "v": digests[label[found]], "links": links[found], "doc_links": doc_links[found]})


def verified_links(candidates: DataFrame, docs: DataFrame, text: str, ngram: int, similarity: float) -> DataFrame:
    """(u, v, links, doc_links): each linked set with the least one linked to it in a pair of blocks.

    Full n-gram sets are made anew for the candidates only. A part of up to BLOCK sets is one
    block; a larger one is dealt into blocks, and each pair of blocks is a task of its own, so
    that memory is bounded, however large a part is. All pairs of a part are compared by block
    products; none is written, only a row for each set and pair of blocks.
    """
    texts = docs.select(*text_key(F.col(text)), F.col(text).alias("_text"))
    wanted = texts.join(candidates, ["_t1", "_t2"]).groupBy("digest").agg(
        F.first("_text").alias("_text"), F.first("copies").alias("copies"), F.first("part").alias("part")
    )

    def grams(batches):
        for batch in batches:
            out = []
            for words in word_slices(batch.column(1)):
                gram, bounds = gram_sets(words, ngram)
                out += [gram[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *batch.columns[2:], pa.array(out, pa.binary())], names=["digest", "copies", "part", "grams"]
            )

    sets = wanted.mapInArrow(grams, "digest binary, copies long, part binary, grams binary").checkpoint()
    sizes = sets.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.octet_length("grams")).alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("long")
    dealt = sets.join(sizes.select("part", blocks.alias("blocks")), "part").withColumn(
        "block", F.pmod(F.xxhash64("digest"), F.col("blocks"))
    )
    others = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = others.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
    return paired.groupBy("part", "one", "two").applyInPandas(
        lambda frame: _verified(frame, similarity), "u binary, v binary, links long, doc_links long"
    )


def near_classes(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    ngram: int = NGRAM,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """(_id, _t1, _t2, root, class_id, n_links, n_text_links) for each row of ``docs``.

    Two rows are linked if the Jaccard similarity of their sets of word n-grams is at least
    ``similarity``; a class is a connected component of links. ``class_id`` is the least id in
    it, ``n_links`` the number of other rows linked to the row, ``n_text_links`` that of linked
    sets that differ from its own. A text of fewer than n words, but one, has the gram of all of
    them. A null text or one without words is linked to nothing: its root is null, its class its
    own id. Rows with equal ids or texts count each; null ids take part, but name no class that
    has another id. An empty table gives no rows.
    """
    importable(docs.sparkSession)
    bands, rows = band_plan(similarity, recall)
    signed = signatures(docs, text, doc_id, ngram, bands, rows).checkpoint()
    candidates = candidate_sets(signed).checkpoint()
    found = verified_links(candidates, docs, text, ngram, similarity).checkpoint()
    roots = components(found.select("u", "v"))
    counts = found.groupBy("u").agg(F.sum("links").alias("links"), F.sum("doc_links").alias("doc_links"))
    sets = signed.where("digest is not null").groupBy("digest").agg(F.count("*").alias("copies"), F.min("_id").alias("least_id"))
    sets = (
        sets.join(roots.withColumnRenamed("u", "digest"), "digest", "left")
        .join(counts.withColumnRenamed("u", "digest"), "digest", "left")
        .withColumn("root", F.coalesce("root", "digest"))
    )
    names = sets.groupBy("root").agg(F.min("least_id").alias("class_id"))
    sets = sets.join(names, "root")
    zero = F.lit(0).cast("long")
    return signed.join(sets, "digest", "left").select(
        "_id",
        "_t1",
        "_t2",
        "root",
        F.when(F.col("root").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("doc_links", zero), zero).alias("n_links"),
        F.coalesce("links", zero).alias("n_text_links"),
    )


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class: the one of the least id, then of the least text digest.

    Rows without words stay, for they are linked to nothing. All columns stay, whatever their names.
    """
    apart = Apart(docs, ())
    docs, text, doc_id = apart.rows, apart.of(text), apart.of(doc_id)
    classes = near_classes(docs, text, doc_id, **options)
    order = F.struct(F.col("_id").isNull().alias("last"), "_id", "_t1", "_t2")
    chosen = classes.where("root is not null").groupBy("root").agg(F.min(order).alias("c")).select("c._id", "c._t1", "c._t2")
    empty = classes.where("root is null").select("_id", "_t1", "_t2").distinct()
    kept = chosen.withColumn("_one", F.lit(True)).unionByName(empty.withColumn("_one", F.lit(False))).checkpoint()
    t1, t2 = text_key(F.col(text))
    keyed = docs.withColumns({"_k": F.col(doc_id), "_k1": t1, "_k2": t2})
    same = keyed["_k"].eqNullSafe(kept["_id"]) & (keyed["_k1"] == kept["_t1"]) & (keyed["_k2"] == kept["_t2"])
    out = keyed.join(kept, same, "inner")
    repeated = classes.where("root is not null").groupBy("_id", "_t1", "_t2").count().where("count > 1")
    if not repeated.isEmpty():  # rows with the same id and text: one of them
        singles = out.where("_one").dropDuplicates(["_k", "_k1", "_k2"])
        out = singles.unionByName(out.where(~F.col("_one")))
    return out.select(*apart.back())


def op3_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return near_classes(docs).select(F.col("_id").alias("doc_id"), "class_id", "n_links", "n_text_links")
