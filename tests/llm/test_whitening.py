"""Chebyshev-filtered subspace iteration against dense eigenvectors of the exact covariance."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerline.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>, x array<long>, component int, n string"


def frame(spark, rows: list) -> object:
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], [1], 3, "n") for i, v in rows], VECTORS)


def plain(rows: list, components: int = 4) -> tuple[dict, int, np.ndarray, np.ndarray]:
    kept = {}
    for i, v in rows:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            kept[i] = tuple(int(np.floor(256.0 * float(np.float32(c)))) for c in v)
    fit = np.array(sorted({*kept.values()}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    c = (fit - np.array([s / n for s in sums])).astype(float)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return kept, n, sums, (values[::-1][:components], vectors[:, ::-1][:, :components], values.sum(), c)


def compare(out: list, rows: list) -> None:
    kept, n, sums, (values, vectors, trace, c) = plain(rows)
    got = {(x["vec_id"], x["component"]): x for x in out}
    assert len(got) == len(out) == len(kept) * len(values)
    white = np.array([[got[i, k + 1]["whitened"] for k in range(len(values))] for i in kept])
    want = (np.array([*kept.values()], float) - np.array([s / n for s in sums])) @ (vectors / np.sqrt(values))
    sign = np.sign((white * want).sum(0))
    assert np.abs(white - want * sign).max() < 1e-6
    for i, x in kept.items():
        for k in range(len(values)):
            r = got[i, k + 1]
            assert r["n"] == n and int(r["deviation"]) == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert abs(r["explained"] / (values[k] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_query_with_gaps_repeats_and_odd_rows(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(i, v) for i, v in enumerate(r.standard_normal((600, 40)) @ np.diag(np.linspace(1, 2, 40)))]
    rows += [(700 + i, rows[i][1]) for i in range(50)]
    rows += [(800, None), (801, [np.nan, *rows[0][1][1:]]), (802, [None, *rows[0][1][1:]]), (803, [np.inf, *rows[0][1][1:]]), (804, -rows[1][1])]
    path = str(tmp_path)
    frame(spark, rows).write.parquet(f"{path}/embeddings.parquet")
    compare(queries.op11_whitening(spark, path).collect(), rows)


@pytest.mark.parametrize(("width", "spread"), [(1, 1.0), (3, 1.0), (30, 1.0), (60, 0.999), (60, 0.5)])
def test_spectra(spark, width, spread):
    r = np.random.default_rng(width)
    rows = [(i, v) for i, v in enumerate(r.standard_normal((500, width)) * 4 * spread ** np.arange(width))]
    compare(whitening.whiten(frame(spark, rows)).collect(), rows)


class Dense:
    """A covariance with a given spectrum in place of the passes."""

    def __init__(self, values: np.ndarray) -> None:
        basis = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values), len(values))))[0]
        self.matrix, self.mean, self.trace, self.passes = basis * values @ basis.T, np.zeros(len(values)), float(values.sum()), 0

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        return self.matrix @ q


@pytest.mark.parametrize("values", [np.ones(80), np.r_[[3.0, 2, 1.5, 1.2], np.ones(76)], np.r_[np.full(40, 2.0), np.ones(60)], 0.5 ** np.arange(100.0), np.r_[1e12, 1e6, 10.0, 1.0, np.full(60, 0.5)], 1 + 1e-6 * np.arange(90.0), np.r_[5.0, np.zeros(50)], np.linspace(1, 2, 200)])
def test_certified_on_hard_spectra(values):
    values = np.sort(values)[::-1]
    v = Dense(values)
    found, vectors, _ = whitening.leading(v, 4)
    assert np.abs(found - values[:4]).max() <= 1e-12 * values[0]
    assert np.abs(v.matrix @ vectors - vectors * found).max() <= 1e-11 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-12
    assert v.passes < 400


def test_few_and_equal_vectors(spark):
    none = frame(spark, [])
    assert whitening.whiten(none).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, []), (2, [])])).count() == 0
    line = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (None, [2.0, 4.0]), (3, [3.0, 6.0]), (4, [9.0])])).collect()
    assert sorted((x["vec_id"] or 0, x["component"]) for x in line) == [(0, 1), (1, 1), (3, 1)]
    assert sorted(abs(round(x["whitened"], 9)) for x in line) == [0, 1.224744871, 1.224744871]


def test_large_entries_stay_exact(spark):
    rows = [(i, [1e12 * i, -3e11 * i * i]) for i in range(6)]
    out = whitening.whiten(frame(spark, rows), components=1).collect()
    kept, n, sums, _ = plain(rows)
    assert {x["vec_id"]: int(x["deviation"]) for x in out} == {i: sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for i, v in kept.items()}
