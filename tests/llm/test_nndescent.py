"""op6: recall with far vectors, two scales, a dense cluster and repeated ids."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerline.llm import nndescent


def recall(spark, x: np.ndarray, queries: list[int], **options) -> float:
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = nndescent.Index(vectors).search(vectors.where(vectors["vec_id"].isin(queries)), **options).collect()
    found, shares = {(r["query_id"], r["vec_id"]) for r in out}, []
    for q in queries:
        order = [int(i) for i in np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable") if i != q][:10]
        shares.append(sum((q, i) in found for i in order) / 10)
    return float(np.mean(shares))


@pytest.fixture(scope="module")
def mixed() -> np.ndarray:
    rng = np.random.default_rng(2)
    near = rng.standard_normal((2500, 16)) * 0.1
    dense = 0.3 + rng.standard_normal((2000, 16)) * 1e-4
    wide = rng.standard_normal((1500, 16)) * 1e3
    x = np.concatenate((near, dense, wide))
    x[700], x[3100] = 1e6, -3e8
    return x


def test_far_vectors_scales_and_a_dense_cluster(spark, mixed):
    queries = [q for q in range(0, 6000, 150) if q not in (700, 3100)]
    got = recall(spark, mixed, queries)
    assert got > 0.9, got


def test_crowded_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 32)
    monkeypatch.setattr(nndescent, "SPREAD", 2)
    x = 5 + np.random.default_rng(3).standard_normal((900, 8)) * np.repeat([[1.0], [1e-3]], [100, 800], axis=0)
    got = recall(spark, x, list(range(0, 900, 30)), beam=96)
    assert got > 0.9, got


def test_repeated_ids(spark):
    rows = [(1, [0.0, 1.0]), (1, [5.0, 5.0]), (2, [0.0, 1.1]), (2, [0.0, 1.2]), (3, [9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nndescent.Index(vectors).search(vectors.where("vec_id = 1")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in out] == [(1, 2), (2, 2), (3, 3)]
