"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Entries are scaled and rounded down to integers; the fit list holds each distinct vector once. Its covariance V is never formed: each pass over
the list multiplies a block Q of up to `BLOCK` columns by the centred vectors and their transpose, batch by batch, and sums the tasks' products, which
are as large as Q, in an aggregation. On the driver there are blocks of that size only.

A few Lanczos steps find where the spectrum ends below. A cycle then applies a Chebyshev polynomial of V to the block by its three-term recurrence, one
pass a degree: it is at most 1 on the unwanted interval, from that end to the smallest value of the block, and grows above it, so that all but the leading
vectors are damped. QR and Rayleigh-Ritz follow. In each cycle the last `PROBES` columns are random vectors anew, which would
bring in a leading vector that the block had missed. The result is certified when the residuals of all wanted pairs are at rounding level and a further filtered
cycle with new probes has left their values as they are. Where a cycle gains little (clusters wider than the block) the block
doubles; at full width Rayleigh-Ritz is exact, so the iteration always ends.

Defined cases: rows whose vector is null or holds null or non-finite entries are left out, as are those of another length than most
vectors have (ties: the shorter). Repeated vectors count once in the fit and have a row each in the result; null ids
are kept. Entries beyond the range of a long are taken as its ends. Components whose variance is nothing but rounding (under 1e-12 of the
whole) are not returned: whitening can't scale them; so equal vectors, a single one and an empty table give no rows. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, COMPONENTS = 256, 4
BLOCK, PROBES, DEGREE, LANCZOS, SEED = 24, 2, 8, 8, 20_240_611
#: Residual of a certified pair, as a part of its eigenvalue; and of the largest, where rounding hides more.
EXACT, ROUNDING = 1e-13, 1e-14
#: Part of the whole variance below which a component is rounding.
NOTHING = 1e-12
#: Rows of a batch that are multiplied at a time.
ROWS = 4_096


class Fit(NamedTuple):
    """n distinct vectors with sums S; eigenvalues and vectors (columns) of their covariance, its trace, and cycles taken."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    cycles: int


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and x (array of long) of the rows that take part."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    whole = F.col("embedding").isNotNull() & F.forall(F.col("embedding"), lambda c: finite(c.cast("double")))
    x: Column = F.transform(F.col("embedding"), lambda c: F.floor(c.cast("double") * scale) + 0)
    rows = vectors.select("vec_id", "embedding").where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    usual = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("x") == (usual["size"] if usual else 0))


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def total(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], width: int, length: int) -> np.ndarray:
    """The sum over all rows of fit (x) of what `of` makes of each batch of them, an array of `length` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(length)
        for _, x in _matrices(batches, width):
            out += of(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(length, dtype=np.int32)), pa.array(out)], names=["at", "value"])

    rows = fit.select("x").mapInArrow(add, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()  # `length` rows
    out = np.zeros(length)
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def exact_sums(fit: DataFrame, width: int) -> list[int]:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [0] * width
        for _, x in _matrices(batches, width):
            safe = len(x) == 0 or max(abs(int(x.max())), abs(int(x.min()))) < 1 << 50
            own = x.sum(0) if safe else x.astype(object).sum(0)
            out = [a + int(b) for a, b in zip(out, own, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([Decimal(v) for v in out], pa.decimal128(38, 0))], names=["at", "value"])

    rows = fit.select("x").mapInArrow(add, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()
    return [int(r["value"]) for r in sorted(rows, key=lambda r: r["at"])]


class Operator:
    """The covariance of the fit list as a linear map: each product is a pass over the list."""

    def __init__(self, fit: DataFrame, n: int, mean: np.ndarray) -> None:
        self.fit, self.n, self.mean, self.trace = fit, n, mean, 0.0

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        """V Q; on the way, the trace of V."""
        mean, width = self.mean, len(self.mean)

        def of(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return np.concatenate(((c.T @ (c @ q)).ravel(), [np.einsum("ij,ij->", c, c)]))

        out = total(self.fit, of, width, q.size + 1) / self.n
        self.trace = float(out[-1])
        return out[:-1].reshape(q.shape)


def least_value(v: Operator, rng: np.random.Generator, steps: int = LANCZOS) -> float:
    """About the lower end of V's spectrum, by Lanczos steps with full orthogonalization; never under 0."""
    width = len(v.mean)
    q = np.linalg.qr(rng.standard_normal((width, 1)))[0]
    basis, alphas, betas = [q], [], []
    for _ in range(min(steps, width)):
        w = v @ basis[-1]
        alphas.append(float((basis[-1].T @ w)[0, 0]))
        for b in basis + basis:
            w = w - b @ (b.T @ w)
        betas.append(float(np.linalg.norm(w)))
        if betas[-1] <= ROUNDING * v.trace:
            break
        basis.append(w / betas[-1])
    k = len(alphas)
    values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[: k - 1], 1) + np.diag(betas[: k - 1], -1))
    return max(0.0, float(values[0] - betas[k - 1] * abs(vectors[-1, 0])))


def filtered(v: Operator, q: np.ndarray, low: float, high: float, values: np.ndarray, wanted: int) -> np.ndarray:
    """A Chebyshev polynomial of V times q: at most 1 in size on [low, high], growing above; scaled to 1 at the largest value."""
    centre, half = (high + low) / 2, (high - low) / 2
    grows = np.arccosh(np.maximum((values - centre) / half, 1 + 1e-15))
    apart = grows[0] - grows[wanted - 1]
    degree = DEGREE if apart <= 0 else int(max(1, min(DEGREE, 23 / apart)))  # so that the leading vector does not drown the others
    sigma = first = half / (values[0] - centre)
    before, now = q, (v @ q - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (v @ now - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now / np.maximum(np.linalg.norm(now, axis=0), np.finfo(float).tiny)


def leading(v: Operator, wanted: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """The `wanted` largest eigenvalues, their unit vectors (columns), and the number of cycles."""
    rng, width = np.random.default_rng(SEED), len(v.mean)
    block = min(width, max(block, wanted + PROBES + 2))
    q = np.eye(width) if block == width else np.linalg.qr(rng.standard_normal((width, block)))[0]
    low, old, worst, cycles, calm = 0.0, None, np.inf, 0, 0
    if block < width:
        low = least_value(v, rng)
    while True:
        vq = v @ q
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        gone = np.linalg.norm(vq - q * values, axis=0)[:wanted]
        allowed = np.maximum(EXACT * values[:wanted], ROUNDING * values[0])
        same = old is not None and np.all(np.abs(values[:wanted] - old) <= allowed + ROUNDING * values[0])
        if q.shape[1] == width or (cycles and same and np.all(gone <= allowed)):
            return values[:wanted], q[:, :wanted], cycles
        now = float(np.max(gone / allowed))
        calm = calm + 1 if now > worst / 3 else 0
        worst, old, cycles = min(worst, now), values[:wanted], cycles + 1
        if calm >= 3:  # little gained in three cycles
            block, calm = min(width, 2 * block), 0
            if block == width:
                q = np.eye(width)
                continue
            q = np.hstack((q, rng.standard_normal((width, block - q.shape[1]))))
        q[:, -PROBES:] = rng.standard_normal((width, PROBES))
        high = float(values[min(len(values), q.shape[1]) - PROBES - 1])
        if high - low > ROUNDING * values[0] and values[0] > high:
            q = filtered(v, q, low, high, np.concatenate((values, np.repeat(values[-1:], q.shape[1] - len(values)))), wanted)
        q = np.linalg.qr(q)[0]


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct x of rows once, written to the shared folder."""
    return stored(rows.select("x").distinct())


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The leading components of the covariance of fit (x); None without vectors."""
    row = fit.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width")).first()
    n, width = row["n"], row["width"] or 0
    if not n or not width:
        return None
    sums = exact_sums(fit, width)
    v = Operator(fit, n, np.array([s / n for s in sums]))
    values, vectors, cycles = leading(v, min(components, width))
    some = values > NOTHING * max(v.trace, 0.0)
    return Fit(n, sums, values[some], vectors[:, some], v.trace, cycles)


def identity_error(fit: DataFrame, model: Fit) -> float:
    """The largest entry, in size, of the whitened fit list's covariance less the identity."""
    mean, turn, k = np.array([s / model.n for s in model.sums]), model.vectors / np.sqrt(model.values), len(model.values)

    def of(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn
        return np.concatenate((w.sum(0), (w.T @ w).ravel()))

    out = total(fit, of, len(mean), k + k * k) / model.n
    return float(np.max(np.abs(out[k:].reshape(k, k) - np.outer(out[:k], out[:k]) - np.eye(k))))


WHITE = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, eigenvalue double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, eigenvalue, identity_error for each row of vectors (vec_id, embedding) and component."""
    rows = quantized(vectors, scale)
    fit = fit_list(rows)
    model = fitted(fit, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], WHITE + ", identity_error double")
    n, sums, k = model.n, model.sums, len(model.values)
    mean, turn = np.array([s / n for s in sums]), model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace

    def away(x: np.ndarray) -> pa.Array:
        most = max(abs(int(x.max())), abs(int(x.min()))) * n + max(map(abs, sums))
        c = x * np.int64(n) - np.array(sums, np.int64) if most * most * len(sums) < 1 << 63 else x.astype(object) * n - np.array(sums, object)
        return pa.array([Decimal(int(d)) for d in (c * c).sum(1)], pa.decimal128(38, 0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, len(sums)):
            m = len(x)
            take = pa.array(np.repeat(np.arange(m), k))
            columns = [part.column("vec_id").take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), away(x).take(take)]
            columns += [pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.tile(model.values, m))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITE.replace("(38,0)", "").split(", ")])

    return rows.select("vec_id", "x").mapInArrow(project, WHITE).withColumn("identity_error", F.lit(identity_error(fit, model)))
