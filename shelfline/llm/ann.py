"""Approximate nearest neighbours: a hierarchical navigable small world per shard.

Distinct vectors are dealt to shards of about ``SHARD_ROWS``. A task builds the graph
of its shard by insertion, many nodes at a time: each batch searches the graph so far
level by level, links to a diverse choice of what it finds, and its neighbours choose
anew among old and new links. A shard is stored as one row of flat arrays (vectors,
node ids, and per level the nodes and their neighbour table, -1 padded). Queries visit
every shard in blocks; the shards' results are merged by score.

Nearness is the inner product. For the graph, vectors get one more component that
makes all lengths equal, which turns the largest inner product into the nearest
neighbour. Nodes are linked by squared distances, in double precision and from
differences, so that a long vector does not swamp those among the others; queries go by
the inner product, and start from the longest vectors too, which few others link to.
Scores are computed on the original vectors.

Copies of a vector are one node; each distinct vector keeps its ``k + 1`` smallest ids,
which is all that ``k`` neighbours can need, so copies are found exactly.

Defined results: vectors that are null, empty, zero, or hold a null or a non-finite
component take no part, nor do rows without an id; vectors are compared within their
own number of components; an id with several vectors counts with the smallest of them,
and repeated rows once; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.sources.storage import materialise

K = 20
SHARD_ROWS, QUERY_ROWS = 16_384, 16_384
#: Links of a node on upper levels (twice as many on the lowest), search widths.
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 16, 64, 200
#: Nodes inserted, and queries searched, at once.
BATCH, TOGETHER = 256, 512
SEED = 7
#: The nearness of what is too far for a double; lengths that need scaling down.
FAR, LONG = -np.finfo(np.float64).max, 2.0**500


class Graph:
    """The graph of one shard in flat arrays."""

    def __init__(self, vectors: np.ndarray):
        self.space = self.lengthened(vectors)
        n = len(vectors)
        rng = np.random.default_rng(SEED)
        draws = -np.log(1 - rng.random(n)) / np.log(LINKS)
        self.level = np.minimum(draws.astype(np.int64), 12)
        top = int(self.level.max(initial=0))
        self.nodes = [np.flatnonzero(self.level >= l).astype(np.int32) for l in range(top + 1)]
        self.row = [np.full(n, -1, np.int32) for _ in self.nodes]
        for row, nodes in zip(self.row, self.nodes, strict=True):
            row[nodes] = np.arange(len(nodes))
        self.links = [np.full((len(nodes), LINKS * (1 if l else 2)), -1, np.int32) for l, nodes in enumerate(self.nodes)]

    @staticmethod
    def lengthened(vectors: np.ndarray) -> np.ndarray:
        """The vectors with the component that makes their lengths equal."""
        space = vectors.astype(np.float64)
        largest = np.abs(space).max(initial=0)
        if largest > LONG:
            space = space * 2.0 ** -np.ceil(np.log2(largest / LONG))
        lengths = (space**2).sum(axis=1)
        rest = np.sqrt(np.maximum(lengths.max(initial=0) - lengths, 0))
        return np.concatenate((space, rest[:, None]), axis=1)

    @classmethod
    def stored(cls, space: np.ndarray, nodes: list[np.ndarray], links: list[np.ndarray]) -> Graph:
        graph = cls.__new__(cls)
        graph.space, graph.nodes, graph.links = space, nodes, links
        graph.row = []
        for own in nodes:
            row = np.full(len(space), -1, np.int32)
            row[own] = np.arange(len(own))
            graph.row.append(row)
        return graph

    @property
    def entry(self) -> int:
        return int(self.nodes[-1][0])

    def nearness(self, ids: np.ndarray, points: np.ndarray, product: bool = False) -> np.ndarray:
        """Of each line's nodes to its point: the inner product, or else the negative
        squared distance, from differences."""
        vectors = self.space[ids]
        if product:
            return np.einsum("bkd,bd->bk", vectors, points)
        vectors -= points[:, None]
        return np.maximum(-np.einsum("bkd,bkd->bk", vectors, vectors), FAR)

    def beam(self, level: int, points: np.ndarray, start: np.ndarray, width: int, product: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of one level for many points in step: ids (-1 padded) and
        nearness of the ``width`` nearest found, nearest first. ``start``: ids."""
        n, links, row = len(points), self.links[level], self.row[level]
        ids = np.full((n, width), -1, np.int32)
        near = np.full((n, width), -np.inf)
        done = np.zeros((n, width), bool)
        seen = np.zeros((n, len(self.space)), bool)
        first = min(width, start.shape[1])
        begin = start[:, :first]
        ids[:, :first] = begin
        near[:, :first] = np.where(begin >= 0, self.nearness(begin, points, product), -np.inf)
        lines, places = np.nonzero(begin >= 0)
        seen[lines, begin[lines, places]] = True
        order = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        active = np.arange(n)
        while len(active):
            open_ = ~done[active] & (ids[active] >= 0)
            some = open_.any(axis=1)
            active = active[some]
            if not len(active):
                break
            at = open_[some].argmax(axis=1)
            done[active, at] = True
            found = links[row[ids[active, at]]]
            new = (found >= 0) & ~seen[active[:, None], found]
            lines, places = np.nonzero(new)
            seen[active[lines], found[lines, places]] = True
            score = np.where(new, self.nearness(found, points[active], product), -np.inf)
            all_near = np.concatenate((near[active], score), axis=1)
            all_ids = np.concatenate((ids[active], np.where(new, found, -1)), axis=1)
            all_done = np.concatenate((done[active], ~new), axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
            near[active], ids[active], done[active] = (np.take_along_axis(x, order, 1) for x in (all_near, all_ids, all_done))
        return ids, near

    def choose(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """A diverse choice of ``most`` candidates per line: in order of nearness, those
        nearer to the point than to any chosen one, then the nearest of the others."""
        order = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        # Seen from the nearest candidate, squared lengths are as small as the distances.
        vectors = self.space[ids] - self.space[ids[:, :1]]
        squared = np.einsum("bkd,bkd->bk", vectors, vectors)
        between = 2 * (vectors @ vectors.transpose(0, 2, 1)) - squared[:, :, None] - squared[:, None, :]
        chosen = np.zeros(ids.shape, bool)
        closest = np.full(near.shape, -np.inf)
        count = np.zeros(len(ids), np.int64)
        for j in range(ids.shape[1]):
            take = (ids[:, j] >= 0) & (count < most) & (near[:, j] > closest[:, j])
            chosen[:, j] = take
            count += take
            closest[take] = np.maximum(closest[take], between[take, j])
        rank = np.where(ids < 0, 2, np.where(chosen, 0, 1))
        return np.take_along_axis(ids, np.argsort(rank, axis=1, kind="stable")[:, :most], 1)

    def link(self, level: int, own: np.ndarray, found: np.ndarray) -> None:
        """Sets the links of ``own`` and adds the links back."""
        links, row = self.links[level], self.row[level]
        links[row[own], : found.shape[1]] = found
        lines, places = np.nonzero(found >= 0)
        target, source = found[lines, places], own[lines]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        who, first, many = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, many)
        more = np.full((len(who), int(many.max(initial=0))), -1, np.int32)
        more[np.repeat(np.arange(len(who)), many), place] = source
        step = max(8, 1_000_000 // (links.shape[1] + more.shape[1]) ** 2)
        for a in range(0, len(who), step):
            some = slice(a, a + step)
            both = np.concatenate((links[row[who[some]]], more[some]), axis=1)
            both[(both[:, :, None] == both[:, None, :]).argmax(axis=2) < np.arange(both.shape[1])] = -1
            near = np.where(both >= 0, self.nearness(both, self.space[who[some]]), -np.inf)
            links[row[who[some]]] = self.choose(both, near, links.shape[1])

    def build(self) -> Graph:
        n = len(self.space)
        rest = np.random.default_rng(SEED + 1).permutation(n).astype(np.int32)
        # The entry point is there from the start, and batches grow with the graph.
        rest = np.concatenate(([self.entry], rest[rest != self.entry])).astype(np.int32)
        at = 1
        while at < n:
            own = rest[at : at + min(BATCH, max(1, at // 2))]
            at += len(own)
            points = self.space[own]
            start = np.full((len(own), 1), self.entry, np.int32)
            for level in range(len(self.nodes) - 1, -1, -1):
                here = self.level[own] >= level
                ids, near = self.beam(level, points, start, BUILD_WIDTH if here.any() else 4)
                if here.any():
                    mates = own[here]
                    among = np.concatenate([self.nearness(mates[None, :], self.space[[mate]]) for mate in mates])
                    np.fill_diagonal(among, -np.inf)
                    pool = np.concatenate((ids[here], np.where(np.isfinite(among), mates[None, :], -1)), axis=1)
                    score = np.concatenate((near[here], among), axis=1)
                    best = np.argsort(-score, axis=1, kind="stable")[:, :BUILD_WIDTH]
                    self.link(level, mates, self.choose(np.take_along_axis(pool, best, 1), np.take_along_axis(score, best, 1), LINKS))
                start = ids[:, : min(8, ids.shape[1])]
        return self

    def search(self, queries: np.ndarray, k: int, width: int) -> np.ndarray:
        """Ids of about the ``k`` nearest of each query, -1 padded."""
        # Only the order of a query's products counts, not its length.
        scale = np.maximum(np.abs(queries).max(axis=1, initial=0), np.finfo(np.float64).tiny)
        points = np.concatenate((queries / scale[:, None], np.zeros((len(queries), 1))), axis=1)
        longest = np.argsort(self.space[:, -1], kind="stable")[:LINKS].astype(np.int32)
        out = np.full((len(points), k), -1, np.int32)
        for a in range(0, len(points), TOGETHER):
            some = points[a : a + TOGETHER]
            start = np.full((len(some), 1), self.entry, np.int32)
            for level in range(len(self.nodes) - 1, 0, -1):
                start = self.beam(level, some, start, 4, True)[0]
            more = np.where((start[:, :, None] == longest).any(axis=1), -1, longest)
            found = self.beam(0, some, np.concatenate((start, more), axis=1), max(width, k), True)[0][:, :k]
            out[a : a + TOGETHER, : found.shape[1]] = found
        return out


def usable(embedding: Column) -> Column:
    x = embedding.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame, copies: int, identity: str, embedding: str) -> DataFrame:
    """A row per distinct vector: ``node`` (its smallest id), its ``size`` and its
    ``copies`` smallest ids in order."""
    own = vectors.select(F.col(identity).cast("long").alias("id"), F.col(embedding).alias("vector"))
    own = own.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    ranked = own.withColumn("rank", F.expr("row_number() OVER (PARTITION BY vector ORDER BY id)")).where(f"rank <= {copies}")
    return ranked.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("node"), "vector", F.size("vector").alias("size"), "ids"
    )


def build_index(nodes: DataFrame, shard_rows: int = SHARD_ROWS, dtype: str = "float32") -> DataFrame:
    """One row of flat arrays per shard. ``nodes``: ``node``, ``vector``, ``size``."""
    shards = max(1, -(-nodes.count() // shard_rows))

    def task(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable")
        vectors = np.stack(frame["vector"].to_numpy()).astype(dtype)
        graph = Graph(vectors).build()
        return pd.DataFrame(
            {
                "size": [key[0]],
                "shard": [key[1]],
                "node": [frame["node"].to_numpy(np.int64).tobytes()],
                "vectors": [vectors.tobytes()],
                "level_nodes": [[x.tobytes() for x in graph.nodes]],
                "level_links": [[x.tobytes() for x in graph.links]],
            }
        )

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int"))
    shape = "size int, shard int, node binary, vectors binary, level_nodes array<binary>, level_links array<binary>"
    return dealt.select("node", "vector", "size", "shard").groupBy("size", "shard").applyInPandas(task, shape)


def _loaded(row: pd.Series, dtype: str) -> tuple[np.ndarray, np.ndarray, Graph]:
    node, size = np.frombuffer(row["node"], np.int64), int(row["size"])
    vectors = np.frombuffer(row["vectors"], dtype).reshape(-1, size)
    nodes = [np.frombuffer(x, np.int32) for x in row["level_nodes"]]
    links = [np.frombuffer(x, np.int32).reshape(-1, LINKS * (1 if l else 2)) for l, x in enumerate(row["level_links"])]
    return node, vectors, Graph.stored(Graph.lengthened(vectors), nodes, links)


def search_index(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH, query_rows: int = QUERY_ROWS, dtype: str = "float32") -> DataFrame:
    """``query``, ``node``, ``score``: per query and shard the ``k`` nearest found.
    ``queries``: ``query``, ``vector``, ``size``; a block of them visits every shard.

    A block meets a copy of each shard. It has as many queries as a shard has vectors, so
    these copies shuffle about as many bytes as the queries' own visits, which no split
    of the work avoids: queries x shards vectors."""
    blocks = max(1, -(-queries.count() // query_rows))
    shards = F.broadcast(index.select(F.col("size").alias("of"), F.col("shard").alias("visit")))  # two numbers per shard
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    visits = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).join(shards, F.col("size") == F.col("of"))

    def task(graph: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(frame):
            return pd.DataFrame({"query": [], "node": [], "score": []})
        node, vectors, built = _loaded(graph.iloc[0], dtype)
        points = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        found = built.search(points, min(k, len(node)), width)
        lines, places = np.nonzero(found >= 0)
        hits = found[lines, places]
        score = np.einsum("nd,nd->n", points[lines], vectors[hits].astype(np.float64))
        return pd.DataFrame({"query": frame["query"].to_numpy(np.int64)[lines], "node": node[hits], "score": score})

    asked = visits.select("query", "vector", "of", "visit", F.col("block").alias("part")).groupBy("of", "visit", "part")
    return graphs.groupBy("size", "shard", "block").cogroup(asked).applyInPandas(task, "query long, node long, score double")


def nearest(
    vectors: DataFrame,
    asks: Column,
    k: int = K,
    identity: str = "vec_id",
    embedding: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    width: int = SEARCH_WIDTH,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of every
    row whose id meets ``asks`` (a condition on a long column ``id``), itself excluded."""
    element = vectors.schema[embedding].dataType.elementType.typeName()
    dtype = "float32" if element == "float" else "float64"
    nodes = materialise(distinct_vectors(vectors, k + 1, identity, embedding), "vectors")
    index = materialise(build_index(nodes.select("node", "vector", "size"), shard_rows, dtype), "index")
    # Queries with equal vectors are searched once; what they ask for differs by their own id only.
    own = vectors.select(F.col(identity).cast("long").alias("id"), F.col(embedding).alias("vector")).where(asks & usable(F.col("vector")))
    own = own.groupBy("id").agg(F.min("vector").alias("vector"))
    asked = materialise(own.join(nodes.select("vector", "node"), "vector").select("id", "node"), "queries")
    queries = nodes.join(asked.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "vector", "size")
    found = search_index(index, queries, k + 1, width, dtype=dtype)
    best = found.withColumn("place", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, node)")).where(f"place <= {k + 1}")
    rows = best.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    few = rows.withColumn("place", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)")).where(f"place <= {k + 1}")
    named = asked.join(few, asked["node"] == few["query"]).where("id <> vec_id").select(F.col("id").alias("query_id"), "vec_id", "score")
    ranked = named.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(f"rank <= {k}").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
