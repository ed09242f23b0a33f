"""op2: the segment bounds cut, and what they leave is exact."""

from __future__ import annotations

import numpy as np

from ledgerline.llm import topk


def clustered(n: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((40, 64)) * 40
    return np.floor(centers[rng.integers(0, 40, n)] + rng.standard_normal((n, 64)) * 4)


def test_levels_leave_fewer_and_fewer():
    shares = topk.survivors(clustered(4000), clustered(100))
    assert len(shares) == len(topk.LEVELS) and shares == sorted(shares, reverse=True)
    assert shares[-1] < 0.1 and shares[-1] < shares[0]


def test_search_equals_all_products(spark):
    x = clustered(1500)
    x[7] = x[1400]  # ties
    rows = [(i, [int(v) for v in r]) for i, r in enumerate(x)] + [(3, [int(v) for v in x[3]])] * 2
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<bigint>").repartition(3)
    got = topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20).collect()
    want = set()
    for q in range(0, 1500, 20):
        scores = sorted((-sum(a * b for a, b in zip(rows[q][1], v, strict=True)), i) for i, v in rows if i != q)[:20]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    assert sorted(map(tuple, got)) == sorted(want | set()) or {tuple(r) for r in got} == want


def test_repeated_queries_and_no_candidates(spark):
    v = "vec_id long, embedding array<bigint>"
    queries = spark.createDataFrame([(1, [2, 0]), (1, [1, 5]), (2, [])], v)
    few = spark.createDataFrame([(1, [9, 9]), (4, [1, 1]), (4, [0, 2]), (5, [])], v)
    assert sorted(map(tuple, topk.search(few, queries, 3).collect())) == [(1, 1, 4, 10), (1, 2, 4, 6), (1, 3, 5, 0), (2, 1, 1, 0), (2, 2, 4, 0), (2, 3, 4, 0)]
    assert topk.search(few.where("false"), queries).count() == 0


def test_wide_vectors_are_reordered(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [int(v) for v in rng.integers(-9, 9, 300)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<bigint>")
    got = {(r["query_id"], r["rank"]): r["score"] for r in topk.search(vectors, vectors.where("vec_id < 3"), 4).collect()}
    for q in range(3):
        best = sorted((sum(a * b for a, b in zip(rows[q][1], v, strict=True)) for i, v in rows if i != q), reverse=True)[:4]
        assert [got[q, r] for r in (1, 2, 3, 4)] == best
