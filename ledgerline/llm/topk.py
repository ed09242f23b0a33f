"""Exact search for the largest inner products, by multi-resolution segment statistics.

The largest inner products are the smallest distances once lengths are allowed for: 2 <q, c> = |q|^2 + |c|^2 - |q - c|^2.
Vectors are centred on the candidates' mean m and turned to the axes of their largest variance, which changes no distance:
<q, c> = <q, m> + <Rq, R(c - m)>. On a segment of L turned components |q - c|^2 is at least L ((mean_q - mean_c)^2 + (dev_q - dev_c)^2),
so that the inner product there is at most L (mean_q mean_c + dev_q dev_c). Summed over 1, 4, 16, then 32 segments these bounds
get finer; a candidate goes on to the next level only if its bound reaches the query's k-th best score so far, and only what
survives the last level gets its product, exactly, on the vectors as they came.

Queries and candidates are packed into blocks of bounded size; each block of candidates meets each block of queries in
one row of an equi-join. A task keeps the k-th best scores of the query blocks it has seen, and returns k rows a query and
block at most.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors, empty ones too, count
as followed by zeros; of queries that repeat an id the smallest vector counts, repeated candidates are candidates each; ties
go to the smaller id; scores outside the range of long stop at its ends. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, LEVELS = 20, (1, 4, 16, 32)
QUERY_BLOCK, CANDIDATE_BLOCK, STRIPE = 8_192, 4_096, 32
#: Queries of a block that are bounded at a time, and components up to which the axes are turned (beyond, only reordered).
AT_ONCE, TURNED = 1_024, 256
BLOCK = "n int, kind string, ids binary, vectors binary"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def whole_numbers(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, embedding with each component x as floor(scale * x)."""
    e = F.col("embedding")
    whole = F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(whole_numbers(e) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("embedding"))


def _packed(size: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                width = max(1, *map(len, part["embedding"]))
                block = np.zeros((len(part), width), np.int64)
                for i, x in enumerate(part["embedding"]):
                    block[i, : len(x)] = x
                kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= block.min() and block.max() <= np.iinfo(t).max)
                out = {"n": len(part), "kind": np.dtype(kind).name, "ids": part["vec_id"].to_numpy(np.int64).tobytes(), "vectors": block.astype(kind).tobytes()}
                if "block" in part:
                    out["block"] = part["block"].iloc[0]
                yield pd.DataFrame([out])

    return pack


def _unpacked(n: int, kind: str, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(n, -1).astype(np.float64 if kind != "int64" else object)


def _moments(width: int):
    """Sums, and sums of products, of the components: rows i, j, s (j = -1 for plain sums), one set a partition."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain, products = np.zeros(width), np.zeros((width, width) if width <= TURNED else width)
        for pdf in batches:
            x = np.zeros((len(pdf), width))
            for i, v in enumerate(pdf["embedding"]):
                x[i, : len(v)] = v
            plain += x.sum(axis=0)
            products += x.T @ x if width <= TURNED else (x**2).sum(axis=0)
        i = np.arange(width)
        out = [pd.DataFrame({"i": i, "j": -1, "s": plain})]
        if width <= TURNED:
            out.append(pd.DataFrame({"i": np.repeat(i, width), "j": np.tile(i, width), "s": products.ravel()}))
        else:
            out.append(pd.DataFrame({"i": i, "j": i, "s": products}))
        yield pd.concat(out)

    return sums


def axes(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the vectors, and the axes (columns) of their variance, the largest first."""
    shape = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    n, width = shape["n"], max(1, shape["width"] or 1)
    rows = vectors.select("embedding").mapInPandas(_moments(width), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()  # TURNED * TURNED rows at most
    mean, second = np.zeros(width), np.zeros((width, width) if width <= TURNED else width)
    plain = rows[rows["j"] < 0]
    mean[plain["i"]] = plain["s"] / max(1, n)
    rest = rows[rows["j"] >= 0]
    if width <= TURNED:
        second[rest["i"], rest["j"]] = rest["s"] / max(1, n)
        values, turned = np.linalg.eigh(second - np.outer(mean, mean))
        return mean, turned[:, ::-1]
    second[rest["i"]] = rest["s"] / max(1, n)
    return mean, np.argsort(mean**2 - second)


def turned(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return x @ by if by.ndim == 2 else x[:, by]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their lengths; products of rows bound inner products."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    return np.column_stack([f(p, axis=1) * np.sqrt(p.shape[1]) for p in parts for f in (np.mean, np.std)])


class Block:
    """Vectors of whole numbers with their turned forms."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, width: int, center: np.ndarray, by: np.ndarray, less: bool) -> None:
        self.ids, self.x = ids, np.pad(x, ((0, 0), (0, width - x.shape[1])))
        plain = self.x.astype(np.float64)
        self.from_center = plain @ center  # the part of a query's products that its center gives
        self.turned = turned(plain - center if less else plain, by)
        self.top = float(np.abs(plain).max(initial=0))
        self.single: np.ndarray | None = None

    def numbers(self, kind: str) -> np.ndarray:
        if self.single is None or self.single.dtype != kind:
            self.single = self.x.astype(np.int64).astype(kind) if kind == "object" else self.x.astype(kind)
        return self.single


def best_of(q: Block, c: Block, floor: np.ndarray, k: int, rows: slice, alive_share: list[float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query number, id, score) of the k best candidates of each of the queries `rows` that reach its floor. Raises floors.

    alive_share gets the share of pairs that survive each level."""
    largest = q.top * c.top * c.x.shape[1]
    kind = "float32" if largest < 2**24 else "float64" if largest < 2**53 else "object"  # what holds products and sums exactly
    qx, cx, own, low = q.numbers(kind)[rows], c.numbers(kind), q.ids[rows], floor[rows]
    columns, base = np.arange(len(c.ids)), q.from_center[rows]
    margin = 1e-9 * (largest + 1)
    alive = np.ones((len(own), len(columns)), bool)
    for level in LEVELS:
        bound = statistics(q.turned[rows], level) @ statistics(c.turned[columns], level).T + base[:, None] + margin
        if level == LEVELS[0] and len(columns) > k and not np.isfinite(low).all():  # floors from the candidates that look best at the coarsest level
            first = np.argpartition(-bound, k, axis=1)[:, : k + 1]
            seen = np.array([cx[f] @ x for f, x in zip(first, qx, strict=True)]).astype(np.float64)
            seen[c.ids[first] == own[:, None]] = -np.inf
            low = np.maximum(low, np.sort(seen, axis=1)[:, 1] - margin)
        alive = alive[:, some] if level != LEVELS[0] else alive
        alive &= bound >= low[:, None]
        some = alive.any(axis=0)
        columns = columns[some]
        if alive_share is not None:
            alive_share.append(float(alive.sum() / (len(own) * len(c.ids))))
    alive = alive[:, some]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(alive.any(axis=1)):
        at = columns[alive[i]]
        at = at[c.ids[at] != own[i]]
        score = cx[at] @ qx[i]
        if kind == "object":
            score = np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in score], dtype=np.int64)
        else:
            score = score.astype(np.int64)
        if len(at) > k:
            near = score >= np.partition(score, -k)[-k]
            at, score = at[near], score[near]
        order = np.lexsort((c.ids[at], -score))[:k]
        if len(order) == k:
            low[i] = max(low[i], float(score[order[-1]]) - margin * (kind == "object"))
        out.append((np.full(len(order), rows.start + i), c.ids[at[order]], score[order]))
    floor[rows] = low
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score. vectors and queries: vec_id, embedding (arrays of integers)."""
    queries = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    center, by = axes(vectors)
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    pack = _packed(QUERY_BLOCK * 2)

    def one_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(pack([pdf]))

    left = dealt.groupBy("block").applyInPandas(one_block, BLOCK + ", block int").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(STRIPE - 1))))
    left = left.select("block", "stripe", *[F.col(c).alias(f"q_{c}") for c in ("n", "kind", "ids", "vectors")])
    right = vectors.mapInPandas(_packed(CANDIDATE_BLOCK), BLOCK).withColumn("stripe", F.pmod(F.xxhash64("ids"), F.lit(STRIPE)).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        floors: dict[tuple, np.ndarray] = {}
        held: tuple = (None, None)
        for pdf in batches:
            for r in pdf.itertuples():
                key = (r.block, len(r.q_ids), r.q_ids[:8])
                q_ids, q = _unpacked(r.q_n, r.q_kind, r.q_ids, r.q_vectors)
                c_ids, c = _unpacked(r.n, r.kind, r.ids, r.vectors)
                width = max(len(center), q.shape[1], c.shape[1])
                mid = np.pad(center, (0, width - len(center)))
                axis = by if width == len(center) else np.arange(width)
                if held[0] != (key, width):
                    held = ((key, width), Block(q_ids, q, width, mid, axis, False))
                own = held[1]
                floor = floors.setdefault(key, np.full(len(q_ids), -np.inf))
                block = Block(c_ids, c, width, mid, axis, True)
                for lo in range(0, len(q_ids), AT_ONCE):
                    i, ids, score = best_of(own, block, floor, k, slice(lo, min(lo + AT_ONCE, len(q_ids))))
                    yield pd.DataFrame({"query_id": q_ids[i], "vec_id": ids, "score": score})

    found = left.join(right, ["block", "stripe"]).mapInPandas(scored, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def survivors(vectors: np.ndarray, queries: np.ndarray, k: int = K) -> list[float]:
    """Shares of all pairs of rows that survive each level, once floors are known from a first pass. For tests and reports."""
    mean = vectors.mean(axis=0)
    _, by = np.linalg.eigh(np.cov(vectors.T))
    q = Block(np.arange(-len(queries), 0), queries, vectors.shape[1], mean, by[:, ::-1], False)
    c = Block(np.arange(len(vectors)), vectors, vectors.shape[1], mean, by[:, ::-1], True)
    floor, shares = np.full(len(queries), -np.inf), []
    for again in (False, True):
        best_of(q, c, floor, k, slice(0, len(queries)), shares if again else None)
    return shares


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
