"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areagrade.llm.wordhash import mixed
from areagrade.llm.workers import importable

DEGREE = 16  # links of a node on the upper layers; twice as many on the lowest
BREADTH_BUILD = 96
BREADTH_SEARCH = 256  # at least; at 20 neighbours: recall 0.95 on SHARD_ROWS random vectors of 128 dimensions
PROBES = 256  # nodes of a graph that tell which breadth it needs
RECALL = 0.95  # of the k nearest in a graph
BATCH = 256
EXPAND = 16  # nodes of a beam that a step expands at least
GATHER = 1 << 23  # numbers of the vectors that are gathered at once
SHARD_ROWS = 4096  # at least
SHARD_GROWTH = 64  # of a shard's rows with the root of all
SHARD_CELLS = 1 << 22  # numbers in a shard's vectors at most, if these are over SHARD_ROWS; shorter ones count as 64
QUERY_ROWS = 8192
SPREAD = 8  # partitions for each group, so that few groups share a task
EMPTY = np.iinfo(np.int64).max


def layer_counts(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of the nodes by their layer, highest first, and the size of each layer from 0 up.

    A node's highest layer is geometric with ratio DEGREE and follows from its id alone.
    """
    uniform = (mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)) / 2.0**53
    top = np.floor(-np.log(np.maximum(uniform, 1e-300)) / np.log(DEGREE)).astype(int)
    top = np.minimum(top, 12)
    order = np.lexsort((ids, -top))
    return order, [int((top >= level).sum()) for level in range(int(top.max()) + 1)] if len(ids) else [0]


def _keys(products: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """One number for a node and its product: the best sorts first, then the least node. The last bit is free."""
    bits = (-products).astype(np.float32).view(np.int32).astype(np.int64)
    return ((bits ^ ((bits >> 31) & 0x7FFFFFFF)) << 32) | (nodes.astype(np.int64) << 1)


def _nodes(keys: np.ndarray) -> np.ndarray:
    return np.where(keys == EMPTY, -1, (keys & 0xFFFFFFFF) >> 1)


def _by_row(row: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The keys of each row, which come in order of their rows, side by side."""
    count = np.bincount(row, minlength=n)
    out = np.full((n, count.max(initial=0)), EMPTY)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = keys
    return out


def expanded_at_once(breadth: int) -> int:
    """Nodes of a beam that a step expands: the steps do not grow in number with the beam."""
    return max(EXPAND, breadth // EXPAND)


def beam_search(points, links, queries, starts, breadth, without=None):
    """The ``breadth`` best nodes found for each query on one layer, best first (-1: none).

    All queries advance in step. ``links`` is the layer's flat neighbour array (-1: none),
    ``starts`` holds the entry nodes of each query (-1: none), ``without`` a node of each that
    is left out. A beam is a row of keys, whose last bit marks the nodes that have been expanded.
    """
    n, shift = len(queries), int(len(points)).bit_length()
    seen = np.zeros((n, 1 << shift), dtype=bool)  # a query's nodes, and a last cell: "none" is the one before a query's first
    seen[:, -1] = True
    if without is not None:
        seen[np.arange(n), without] = True
    seen = seen.ravel()
    out = np.full((n, breadth), EMPTY)
    live, beam = np.arange(n), np.full((n, 0), EMPTY)  # the queries that go on, and their beams
    row, near = np.repeat(np.arange(n), starts.shape[1]), starts.ravel()
    while len(live):
        cell = (live[row] << shift) + near
        cell = np.sort(cell[~seen[cell]].astype(np.int32 if n < 1 << (31 - shift) else np.int64))
        seen[cell] = True
        cell = cell[np.append(True, cell[1:] != cell[:-1])[: len(cell)]].astype(np.int64)
        near = cell & ((1 << shift) - 1)
        ends = np.searchsorted(cell, (live + 1) << shift)
        row = np.repeat(np.arange(len(live)), np.diff(ends, prepend=0))
        vectors, products = points.take(near, 0), np.empty(len(near), points.dtype)
        for query, begin, end in zip(live, [0, *ends], ends):
            np.dot(vectors[begin:end], queries[query], out=products[begin:end])
        keys = _keys(products, near)
        if beam.shape[1] == breadth:  # what would fall out of the beam is not sorted into it
            better = keys < beam[row, -1]
            row, keys = row[better], keys[better]
        beam = np.sort(np.concatenate([beam, _by_row(row, keys, len(live))], axis=1), axis=1)[:, :breadth]
        waiting = beam & 1 == 0
        going = waiting.any(axis=1)
        if not going.all():
            out[live[~going], : beam.shape[1]] = beam[~going]
            live, beam, waiting = live[going], beam[going], waiting[going]
        row, at = np.nonzero(waiting & (np.cumsum(waiting, axis=1) <= expanded_at_once(breadth)))
        near = links[_nodes(beam[row, at])].ravel()
        beam[row, at] |= 1
        row = np.repeat(row, links.shape[1])
    return _nodes(out)


def spread_links(points, nodes, products, most):
    """Of each row's nodes (best first, -1: none), up to ``most`` that are nearer to the row's own
    point than to a chosen one; the rest is filled with the best of the others."""
    n, k = nodes.shape
    near = points[nodes]
    between = near @ near.transpose(0, 2, 1)
    chosen = np.zeros((n, k), dtype=bool)
    blocked = nodes < 0
    for i in range(k):
        take = ~blocked[:, i] & (chosen.sum(1) < most)
        chosen[take, i] = True
        shadow = between[:, i, :] > products
        blocked[take] |= shadow[take]
    rank = np.where(nodes < 0, 3 * k, np.where(chosen, 0, k) + np.arange(k))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(nodes < 0, -1, nodes), order, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def best_of(products: np.ndarray, breadth: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``breadth`` largest cells of each row, best first: (columns, products); -inf is no cell."""
    n, width = products.shape
    groups = max(2 * breadth, width // 16)
    if width > 4 * groups:
        # So many cells, and few more, reach the least of the best groups' largest.
        top = products[:, : width - width % groups].reshape(n, -1, groups).max(axis=1)
        least = np.partition(top, groups - breadth, axis=1)[:, groups - breadth]
        row, column = np.nonzero((products >= least[:, None]) & (products > -np.inf))
        keys = _by_row(row, _keys(products[row, column], column), n)
    else:
        keys = np.where(products > -np.inf, _keys(products, np.arange(width)[None, :]), EMPTY)
    nodes = _nodes(np.sort(keys, axis=1)[:, :breadth])
    return nodes, np.where(nodes < 0, -np.inf, np.take_along_axis(products, nodes, 1))


def build_layer(points, upper):
    """Flat neighbour array of one layer over ``points``, its nodes inserted in order in batches.

    A batch doubles the layer. A new node's links are chosen among the nearest of all nodes
    up to its batch's end, which matrix products tell faster than walks would find them.
    """
    n = len(points)
    most = DEGREE if upper else 2 * DEGREE
    links = np.full((n + 1, most), -1, dtype=np.int32)
    at = 0
    while at < n:
        end = min(max(2 * at, 32), n)
        for low in range(at, end, BATCH):
            new = np.arange(low, min(low + BATCH, end))
            inside = points[new] @ points[:end].T
            inside[np.arange(len(new)), new] = -np.inf
            links[new] = spread_links(points, *best_of(inside, BREADTH_BUILD), most)
        _link_back(points, links, np.arange(at, end), most)
        at = end
    return links


def _link_back(points, links, new, most):
    """Give the neighbours of new nodes a link to them; who has too many keeps a spread of its own and the nearest new ones.

    All own links take part, so that a batch near to a node does not cut it off from what lies farther."""
    source, target = np.repeat(new, most), links[new].ravel()
    order = np.argsort(target, kind="stable")[np.count_nonzero(target < 0) :]
    source, target = source[order], target[order]
    touched, first = np.unique(target, return_index=True)
    first = np.append(first, len(target))
    for low in range(0, len(touched), BATCH):
        part = touched[low : low + BATCH]
        own, at = links[part], slice(first[low], first[low + len(part)])
        row, node = np.searchsorted(part, target[at]), source[at]
        fresh = (own[row] != node[:, None]).all(axis=1)
        row, node = row[fresh], node[fresh]
        keys = _by_row(row, _keys(np.einsum("nd,nd->n", points[part[row]], points[node]), node), len(part))
        keys = np.sort(keys, axis=1)[:, : 2 * most]
        nodes = np.concatenate([own, _nodes(keys)], axis=1)
        products = (points[nodes] @ points[part][:, :, None])[:, :, 0]
        products[nodes < 0] = -np.inf
        order = np.argsort(-products, axis=1, kind="stable")
        nodes, products = (np.take_along_axis(x, order, 1) for x in (nodes, products))
        links[part] = spread_links(points, nodes, products, most)


class Graph:
    """The layers of one shard. ``points`` are in the order of ``layer_counts``."""

    def __init__(self, points: np.ndarray, sizes: list[int], layers: list[np.ndarray]):
        self.points, self.sizes, self.layers = points, sizes, layers

    @classmethod
    def build(cls, points: np.ndarray, sizes: list[int]) -> Graph:
        return cls(points, sizes, [build_layer(points[:size], level > 0) for level, size in enumerate(sizes)])

    def descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """An entry node on ``level`` for each query, by greedy search on the layers above."""
        entry = np.zeros((len(queries), 1), dtype=np.int64)
        for above in reversed(range(level + 1, len(self.sizes))):
            entry = beam_search(self.points[: self.sizes[above]], self.layers[above], queries, entry, 8)[:, :4]
        return entry

    def search(self, queries: np.ndarray, breadth: int, without: np.ndarray | None = None) -> np.ndarray:
        """Nodes of the lowest layer for each query, best first."""
        entry = self.descend(queries, 0)
        return beam_search(self.points, self.layers[0], queries, entry, breadth, without)

    def breadth_for(self, k: int) -> int:
        """The breadth from BREADTH_SEARCH up at which walks find RECALL of the k nearest of some nodes.

        These nodes are left out of their own walks, so that they stand for queries from elsewhere.
        How wide a beam has to be is up to the vectors, and grows with the graph.
        """
        low, n, breadth = self.sizes[1] if len(self.sizes) > 1 else 1, self.sizes[0], BREADTH_SEARCH
        probes = np.unique(np.linspace(low, n - 1, min(PROBES, n - low)).astype(int)) if n > breadth else []
        if not len(probes):
            return breadth
        queries = self.points[probes]
        queries[:, -1] = 0
        products = queries @ self.points.T
        products[np.arange(len(probes)), probes] = -np.inf
        least = np.partition(products, -k, axis=1)[:, -k, None] if k < n else products.min(axis=1, keepdims=True)
        while breadth < n:
            step = self.at_once(breadth)
            nodes = np.concatenate([self.search(queries[i : i + step], breadth, probes[i : i + step]) for i in range(0, len(probes), step)])
            near = (np.take_along_axis(products, nodes, 1) >= least) & (nodes >= 0)
            if np.minimum(near.sum(axis=1), k).mean() >= RECALL * min(k, n - 1):
                break
            breadth += breadth // 2
        return breadth

    def at_once(self, breadth: int) -> int:
        """Queries that walk together, so that the vectors of a step take little memory."""
        return max(1, min(BATCH, GATHER // (expanded_at_once(breadth) * 2 * DEGREE * self.points.shape[1])))


def with_norm(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate that makes all lengths equal: the largest product is then the nearest point."""
    square = (vectors.astype(np.float64) ** 2).sum(1)
    rest = np.sqrt(np.maximum(square.max(initial=0.0) - square, 0.0))
    return np.column_stack([vectors, rest]).astype(np.float32)


def usable_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, dim, vec): ids and vectors that take part, of floats or else doubles; -0.0 counts as 0.0."""
    kind = "float" if dict(rows.dtypes)[vector] == "array<float>" else "double"
    v = F.transform(F.col(vector), lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x.cast(kind)))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vec"))
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
        .where(finite & F.exists("vec", lambda x: x != 0))
        .select("vec_id", F.size("vec").alias("dim"), "vec")
    )


def build_index(vectors: DataFrame, k: int, shard_rows: int | None = None) -> DataFrame:
    """(dim, shard, counts, members, vectors, breadth, sizes, layers): a graph for each shard.

    Equal vectors are one node with its k + 1 least ids, which is all that any query's k nearest
    can hold, so a common vector neither fills a shard nor cuts its graph apart. Nodes are dealt
    to shards by hash, ``shard_rows`` to each on average. By default that grows with the root of
    their number, as walks over larger graphs are hardly longer, up to what a task's memory holds.
    """
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    numbered = vectors.distinct().withColumn("_number", F.row_number().over(by_id)).where(F.col("_number") <= k + 1)
    nodes = numbered.groupBy("dim", "vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members")).checkpoint()
    grown = F.least(SHARD_GROWTH * F.sqrt(F.count("*")), SHARD_CELLS / F.greatest("dim", F.lit(64)))
    least = F.greatest(F.lit(SHARD_ROWS), grown) if shard_rows is None else F.lit(shard_rows)
    shards = nodes.groupBy("dim").agg(F.ceil(F.count("*") / least).cast("long").alias("shards"))
    # A shard is a few megabytes but many seconds of work: shuffles sized by bytes would merge them into one task.
    tasks = SPREAD * (shards.agg(F.sum("shards")).first()[0] or 1)
    dealt = nodes.join(F.broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards"))).repartition(tasks, "dim", "shard")

    def build(frame):
        first = np.array([m[0] for m in frame["members"]], dtype=np.int64)
        order, sizes = layer_counts(first)
        exact = np.stack(frame["vec"].to_numpy()[order])
        graph = Graph.build(with_norm(exact), sizes)
        members = [np.asarray(m, np.int64) for m in frame["members"].to_numpy()[order]]
        return pd.DataFrame(
            {
                "dim": frame["dim"].iloc[:1].to_numpy(),
                "shard": frame["shard"].iloc[:1].to_numpy(),
                "counts": [np.array([len(m) for m in members], np.int32).tobytes()],
                "members": [np.concatenate(members).tobytes()],
                "vectors": [exact.tobytes()],
                "breadth": np.array([graph.breadth_for(k)], np.int32),
                "sizes": [np.array(sizes, np.int32).tobytes()],
                "layers": [b"".join(layer.astype(np.int32).tobytes() for layer in graph.layers)],
            }
        )

    schema = "dim int, shard long, counts binary, members binary, vectors binary, breadth int, sizes binary, layers binary"
    return dealt.drop("shards").groupBy("dim", "shard").applyInPandas(build, schema)


def _opened(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    sizes, counts = np.frombuffer(row["sizes"], np.int32).tolist(), np.frombuffer(row["counts"], np.int32)
    kind = np.float32 if len(row["vectors"]) == 4 * row["dim"] * len(counts) else np.float64
    exact = np.frombuffer(row["vectors"], kind).reshape(-1, row["dim"])
    flat, layers, at = np.frombuffer(row["layers"], np.int32), [], 0
    for level, size in enumerate(sizes):
        most = DEGREE if level else 2 * DEGREE
        layers.append(flat[at : at + (size + 1) * most].reshape(-1, most))
        at += (size + 1) * most
    return Graph(with_norm(exact), sizes, layers), exact, counts, np.frombuffer(row["members"], np.int64)


def _best_members(nodes, own, queries, exact, counts, members, k):
    """(row, id, score): each query's k best ids of the nodes found, by exact product, ties by id; not its own."""
    starts = np.cumsum(counts) - counts
    usable = (nodes >= 0) & ~((counts[nodes] == 1) & (members[starts[nodes]] == own[:, None]))
    score = np.empty(nodes.shape)
    step = max(1, GATHER // (4 * nodes.shape[1] * exact.shape[1]))
    for low in range(0, len(nodes), step):
        part = slice(low, low + step)
        score[part] = (exact[nodes[part]].astype(np.float64) @ queries[part, :, None])[:, :, 0]
    if nodes.shape[1] > k:  # every usable node brings an id, so that the k best nodes are enough
        ranked = np.where(usable & ~np.isnan(score), score, -np.inf)
        usable &= ~(ranked < np.partition(ranked, -k, axis=1)[:, -k, None])
    row, at = np.nonzero(usable)
    node, score = nodes[row, at], score[row, at]
    ends = np.cumsum(counts[node])
    row, score = np.repeat(row, counts[node]), np.repeat(score, counts[node])
    ids = members[np.arange(len(row)) + np.repeat(starts[node] - ends + counts[node], counts[node])]
    row, score, ids = row[ids != own[row]], score[ids != own[row]], ids[ids != own[row]]
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], score[kept]


def search_index(index: DataFrame, queries: DataFrame, k: int, breadth: int = BREADTH_SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found, by exact inner product, ties by id.

    Every block of queries meets every shard of its dimension in a task of its own, which
    returns k rows for each query; the best of all shards are merged. A shard may need beams wider
    than ``breadth``.
    """
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("blocks"))
    met = blocks.join(index.groupBy("dim").agg(F.collect_set("shard").alias("shards")), "dim").checkpoint()  # a row per length
    tasks = SPREAD * (met.agg(F.sum(F.col("blocks") * F.size("shards"))).first()[0] or 1)
    keys = ["dim", "shard", "block"]
    asked = queries.join(F.broadcast(met), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    asked = asked.withColumn("shard", F.explode("shards")).drop("shards", "blocks").repartition(tasks, *keys)
    spread = index.join(F.broadcast(met.drop("shards")), "dim").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.drop("blocks").repartition(tasks, *keys)

    def search(graphs, frame):
        out = [(np.array([], np.int64), np.array([], np.int64), np.array([], float))]
        if len(graphs) and len(frame):
            graph, *shard = _opened(graphs.iloc[0])
            wide = max(breadth, int(graphs["breadth"].iloc[0]))
            step = graph.at_once(wide)
            for low in range(0, len(frame), step):
                part = frame.iloc[low : low + step]
                own, asked_for = part["vec_id"].to_numpy(), np.stack(part["vec"].to_numpy()).astype(np.float64)
                nodes = graph.search(np.column_stack([asked_for, np.zeros(len(part))]).astype(np.float32), wide)
                row, ids, score = _best_members(nodes, own, asked_for, *shard, k)
                out.append((own[row], ids, score))
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], map(np.concatenate, zip(*out)))))

    found = spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, every: int, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``, among all rows but its own.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id. A query meets the vectors of its own length. Equal rows count once; rows of one
    id with different vectors are all candidates, but none for that id's queries. With fewer
    candidates than k there are fewer rows; an empty table gives none. Other columns are ignored.
    """
    importable(rows.sparkSession)
    vectors = usable_vectors(rows, vec_id, vector).checkpoint()
    index = build_index(vectors, k).checkpoint()
    queries = vectors.where(F.col("vec_id") % every == 0).distinct().checkpoint()
    return search_index(index, queries, k)


def op9_hnsw(spark: SparkSession, sf: str) -> DataFrame:
    from areagrade.sources.tables import read_table

    return nearest(read_table(spark, sf, "embeddings"), 20, 20)
