"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node (their smallest id; a node keeps its k + 1 smallest ids, all that a query can need). Nodes are dealt into
blocks of about BLOCK by the signs of random projections. NN-descent starts with neighbours from each block, the cells beside it and a few random
nodes, and then, by joins, brings every block the neighbours, reverse neighbours and neighbours of neighbours of its nodes; each node
keeps the DEGREE nearest it has met, until a turn hardly changes them. A turn brings a block only nodes that it has not met yet. A cell
of many vectors that look alike is dealt into several blocks, of which a node meets up to SPREAD at the start. Vectors travel with 16 bits
a component and a factor of their own here.

A search is a beam of the BEAM nearest nodes for each query, first of its own block's; each turn joins the nearest ones not
expanded yet with the graph (forward edges and up to REVERSE reverse ones), measures what is new, and stops when no
query has an unexpanded node left in its beam. The best are measured again on the original vectors, in double precision.

Every vector is indexed. Reverse edges of a node beyond REVERSE are chosen by hash; no vector depends on them to be
found, since forward edges stay. Recall against brute force is measured in tests/llm.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; shorter vectors count as
followed by zeros; repeated ids of candidates are candidates each, of queries the smallest vector counts. Other columns
play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .topk import usable

K, DEGREE, REVERSE, BEAM, BLOCK = 10, 24, 48, 320, 256
TURNS, CHANGE, SEED = 8, 0.002, 5
#: Neighbouring cells that a node is shown to at the start.
PROBES = 8
#: In a turn of NN-descent: reverse neighbours of a node, and how many of each neighbour's nearest are met.
BACK, NEAREST = 16, 8
#: Blocks of a cell that a node or a query is shown to at the start.
SPREAD = 4
STATE = "node long, block long, small binary, neighbours array<long>, d array<float>"
STEPS = 60


def signs(x: np.ndarray, center: np.ndarray, bits: int) -> np.ndarray:
    planes = np.random.default_rng(SEED).standard_normal((len(center), max(bits, 1)))
    return (((x - center) @ planes[:, :bits] > 0) << np.arange(bits)).sum(axis=1).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row's factor (32 bits) and its components as multiples of it (16 bits each)."""
    factor = (np.abs(x).max(axis=1, initial=0.0) / 32_000).astype(np.float32)
    small = np.rint(np.clip(x / np.where(factor > 0, factor, 1)[:, None], -32_767, 32_767)).astype(np.int16)
    return [f.tobytes() + r.tobytes() for f, r in zip(factor, small, strict=True)]


def unpacked(rows, width: int) -> np.ndarray:
    whole = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 4 + 2 * width)
    return np.ascontiguousarray(whole[:, 4:]).view(np.int16).astype(np.float32) * np.ascontiguousarray(whole[:, :4]).view(np.float32)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * (a @ b.T), 0)


def nearest(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, held_i: np.ndarray, held_d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """held_i, held_d (of each of ids its nearest so far and their distances; -1 and inf where there is none) after meeting others."""
    degree = held_i.shape[1]
    for lo in range(0, len(others), 8192):
        o = others[lo : lo + 8192]
        d = distances(x, y[lo : lo + 8192]).astype(np.float32)
        d[ids[:, None] == o[None]] = np.inf
        d, i = np.concatenate((held_d, d), axis=1), np.concatenate((held_i, np.broadcast_to(o, d.shape)), axis=1)
        at = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        held_d, held_i = np.take_along_axis(d, at, 1), np.take_along_axis(i, at, 1)
    order = np.argsort(held_d, axis=1)
    return np.take_along_axis(held_i, order, 1), np.take_along_axis(held_d, order, 1)


def renamed(df: DataFrame) -> DataFrame:
    """df with columns of their own, for a cogroup with what derives from df."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


class Index:
    """nodes (node, block, small, vector), graph (node, neighbours), members (node, ids), and how to place a query."""

    def __init__(self, vectors: DataFrame, k: int = K, degree: int = DEGREE) -> None:
        e = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
        rows = vectors.where(usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("vector"))
        order = Window.partitionBy("vector").orderBy("vec_id")
        self.members = stored(rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("vector").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
        shape = self.members.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("top")).first()
        self.count, self.width, self.scale = shape["n"], shape["width"] or 1, min(1.0, 1e15 / (shape["top"] or 1.0))
        means = self.members.select(F.posexplode("vector")).groupBy("pos").agg(F.percentile_approx("col", 0.5, 1000).alias("s")).collect()  # medians, which a few far vectors don't move; one row a component
        self.center = np.zeros(self.width)
        for r in means:
            self.center[r["pos"]] = r["s"]
        self.bits = max(0, math.ceil(math.log2(max(1, self.count / BLOCK))))
        center, bits, width, scale = self.center, self.bits, self.width, self.scale

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = matrix(pdf["vector"], width)
                yield pd.DataFrame({"node": pdf["node"], "cell": signs(x, center, bits), "small": packed(x * scale)})

        self.place = place
        placed = stored(self.members.select("node", "vector").mapInPandas(place, "node long, cell long, small binary"))
        self.parts = stored(placed.groupBy("cell").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts")))
        block = F.xxhash64("cell", F.pmod(F.xxhash64("node"), F.col("parts")))
        self.nodes = stored(placed.join(self.parts, "cell").select("node", block.alias("block"), "cell", "small"))
        self.degree = degree
        self.graph = self.descend()

    def _blocks(self, rows: DataFrame, key: str) -> DataFrame:
        """rows (with cell) once for each of up to SPREAD blocks of the cell, from the one that the hash of `key` points at."""
        start = F.pmod(F.xxhash64(key), F.col("parts"))
        turns = F.transform(F.sequence(F.lit(0), F.least(F.col("parts"), F.lit(SPREAD)) - 1), lambda i: F.xxhash64("cell", F.pmod(start + i, F.col("parts"))))
        return rows.join(self.parts, "cell").withColumn("block", F.explode(turns)).drop("cell", "parts")

    def _measure(self, state: DataFrame, wanted: DataFrame) -> DataFrame:
        """state (node, block, small, neighbours, d) after each block has met the nodes in wanted (block, other, small)."""
        width, degree = self.width, self.degree

        def meet(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(others):
                return own
            held_i, held_d = np.full((len(own), degree), -1, np.int64), np.full((len(own), degree), np.inf, np.float32)
            for r, (i, d) in enumerate(zip(own["neighbours"], own["d"], strict=True)):
                held_i[r, : len(i)], held_d[r, : len(i)] = i, d
            x, y = (unpacked(p["small"], width) for p in (own, others))
            held_i, held_d = nearest(own["node"].to_numpy(np.int64), x, others["other"].to_numpy(np.int64), y, held_i, held_d)
            n = np.isfinite(held_d).sum(axis=1)
            return own.assign(neighbours=[i[:k] for i, k in zip(held_i, n, strict=True)], d=[d[:k] for d, k in zip(held_d, n, strict=True)])

        return stored(renamed(state).groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(meet, STATE))

    def _edges(self, graph: DataFrame, reverse: int) -> DataFrame:
        """node, other: forward edges, and at most `reverse` reverse ones of each node."""
        forward = graph.select("node", F.explode("neighbours").alias("other"))
        order = Window.partitionBy("node").orderBy(F.xxhash64("other", F.lit(SEED)), "other")
        back = forward.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= reverse).drop("r")
        return forward.unionByName(back).distinct()

    def descend(self) -> DataFrame:
        """The graph: node, neighbours. A block never meets a node twice: each turn brings only what is new to it."""
        at = self.nodes.select("node", "block")
        none = F.array()
        state = self.nodes.select("node", "block", "small", none.cast("array<long>").alias("neighbours"), none.cast("array<float>").alias("d"))
        # first acquaintances: a block's own nodes, those of cells that differ in one sign, and random ones, which tie cells together
        beside = [F.col("cell").bitwiseXOR(F.lit(1 << j)) for j in range(min(self.bits, PROBES))]
        any_ = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(1 << self.bits)) for j in range(2)]
        cells = self.nodes.select("node", F.explode(F.array_distinct(F.array(F.col("cell"), *beside, *any_))).alias("cell"))
        new = stored(self._blocks(cells, "node").select("block", F.col("node").alias("other")).distinct())
        met, last = new, math.inf
        for turn in range(TURNS + 1):
            state = self._measure(state, new.join(self.nodes.select(F.col("node").alias("other"), "small"), "other"))
            now = state.agg(F.sum(F.aggregate("d", F.lit(0.0), lambda a, x: a + F.sqrt(x.cast("double"))))).first()[0] or 0.0
            if turn == TURNS or (turn > 1 and last - now <= CHANGE * last):
                break
            last = now
            near = stored(self._edges(state, BACK).join(at, "node").select("block", "other").distinct())
            far = near.select("block", F.col("other").alias("node")).join(state.select("node", F.explode(F.slice("neighbours", 1, NEAREST)).alias("other")), "node").select("block", "other")
            new = stored(near.unionByName(far).distinct().join(met, ["block", "other"], "left_anti"))
            met = stored(met.unionByName(new))
        return state.select("node", "neighbours")

    def search(self, queries: DataFrame, k: int = K, beam: int = BEAM) -> DataFrame:
        """query_id, rank, vec_id, score. queries: vec_id, embedding."""
        e = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
        good = queries.where(usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)).groupBy(F.col("vec_id").cast("long").alias("node")).agg(F.min(e).alias("vector"))
        good = stored(good)
        placed = good.mapInPandas(self.place, "node long, cell long, small binary").withColumnsRenamed({"node": "query", "small": "q"})
        placed = stored(placed.withColumn("team", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-good.count() // 64))))))
        edges = stored(self._edges(self.graph, REVERSE).join(self.nodes.select(F.col("node").alias("other"), "block"), "other"))
        width, step = self.width, max(16, beam // 4)
        state_type = "team long, query long, nodes array<long>, d array<float>, open array<boolean>"

        def measure(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(asked):
                return pd.DataFrame({"team": [], "query": [], "node": [], "d": []})
            x = unpacked(own["small"], width)
            ids = own["node"].to_numpy(np.int64)
            order = np.argsort(ids)
            ids, x = ids[order], x[order]
            q = unpacked(asked["q"], width)
            of = np.repeat(np.arange(len(asked)), asked["others"].map(len))
            at = np.searchsorted(ids, np.concatenate(asked["others"].to_numpy()))
            d = ((q[of] - x[at]) ** 2).sum(axis=1)
            ok = d < asked["bound"].to_numpy(np.float32)[of]
            of = of[ok]
            return pd.DataFrame({"team": asked["team"].to_numpy()[of], "query": asked["query"].to_numpy()[of], "node": ids[at[ok]], "d": d[ok]})

        def merge(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            groups = dict(list(new.groupby("query"))) if len(new) else {}
            held = {r.query: r for r in old.itertuples()}
            out = []
            for query in {*groups, *held}:
                nodes, d, open_ = (np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, bool)) if query not in held else (np.array(held[query].nodes, np.int64), np.array(held[query].d, np.float32), np.array(held[query].open, bool))
                closing = np.flatnonzero(open_)[:step]  # these were expanded in this turn
                open_[closing] = False
                if query in groups:
                    g = groups[query]
                    fresh = ~np.isin(g["node"].to_numpy(), nodes)
                    nodes = np.concatenate((nodes, g["node"].to_numpy()[fresh]))
                    d = np.concatenate((d, g["d"].to_numpy(np.float32)[fresh]))
                    open_ = np.concatenate((open_, np.ones(int(fresh.sum()), bool)))
                order = np.lexsort((nodes, d))[:beam]
                team = old["team"].iloc[0] if len(old) else new["team"].iloc[0]
                out.append((team, query, nodes[order], d[order], open_[order]))
            return pd.DataFrame(out, columns=["team", "query", "nodes", "d", "open"])

        entry = self._blocks(placed, "query").join(self.nodes.select("block", F.col("node").alias("other")), "block")
        pool = self.nodes.orderBy(F.xxhash64("node", F.lit(SEED)), "node").limit(64).select("block", F.col("node").alias("other"))
        entry = entry.select("query", "team", "q", "block", "other").unionByName(placed.select("query", "team", "q").join(F.broadcast(pool)).select("query", "team", "q", "block", "other"))
        ask = entry.groupBy("block", "query").agg(F.collect_set("other").alias("others"), F.first("team").alias("team"), F.first("q").alias("q")).withColumn("bound", F.lit(float("inf")).cast("float"))
        state = self.nodes.sparkSession.createDataFrame([], state_type)
        for _ in range(STEPS):
            met = renamed(self.nodes).groupBy("block").cogroup(ask.groupBy("block")).applyInPandas(measure, "team long, query long, node long, d float")
            state = stored(renamed(state).groupBy("team").cogroup(met.groupBy("team")).applyInPandas(merge, state_type))
            places = F.filter(F.transform("open", lambda x, i: F.when(x, i).otherwise(-1)), lambda i: i >= 0)
            front = state.withColumn("places", F.slice(places, 1, step)).where(F.size("places") > 0)
            if front.isEmpty():
                break
            bound = F.when(F.size("nodes") >= beam, F.element_at("d", -1)).otherwise(F.lit(float("inf")).cast("float"))
            front = front.select("query", bound.alias("bound"), F.explode(F.transform("places", lambda i: F.get("nodes", i))).alias("node"))
            ask = front.join(edges, "node").groupBy("block", "query").agg(F.collect_set("other").alias("others"), F.first("bound").alias("bound")).join(placed.select("query", "team", "q"), "query")
        found = state.select("query", F.explode(F.slice("nodes", 1, 12 * k)).alias("node")).join(self.members, "node").join(good.select(F.col("node").alias("query"), F.col("vector").alias("target")), "query")

        @F.pandas_udf("double")
        def score(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(np.sqrt(((matrix(a, width) - matrix(b, width)) ** 2).sum(axis=1)))

        rows = found.select("query", score("vector", "target").alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")
