"""Samples that are filled up, fallback hits and keys of gaps on small and empty tables."""

from __future__ import annotations

from ledgerline.operators import evidence as E
from ledgerline.operators import retrieval as K
from ledgerline.operators import rules as R


def test_round_robin_then_fill(spark):
    rows = spark.createDataFrame([(1, "x", "a"), (2, "x", "a"), (3, "x", "b"), (4, "y", "c"), (5, None, "d"), (6, "y", "c")], "id long, lang string, source string")
    take = lambda n: [r["id"] for r in sorted(K.filled_round_robin(rows, "lang", "source", n).collect(), key=lambda r: r["place"])]
    assert take(2) == [5, 1] and take(4) == [5, 1, 4, 3] and take(5) == [5, 1, 4, 3, 2] and take(99) == [5, 1, 4, 3, 2, 6]
    assert K.filled_round_robin(rows.limit(0), "lang", "source", 3).collect() == []


def test_one_chunk_a_pair_then_fill(spark):
    rows = spark.createDataFrame([(1, "s", "body"), (2, "s", "body"), (3, "s", "short"), (4, "t", "body")], "doc_id long, source string, kind string")
    assert [(r["doc_id"], r["place"]) for r in sorted(E.sample_filled(rows, 4).collect(), key=lambda r: r["place"])] == [(1, 1), (3, 2), (4, 3), (2, 4)]
    assert E.sample_filled(rows, 2).count() == 2 and E.sample_filled(rows.limit(0)).count() == 0


def test_fallback_only_where_there_are_no_hits(spark):
    hits = spark.createDataFrame([(1, 10, 0.5)], "query_id long, vec_id long, score double")
    other = spark.createDataFrame([(1, 11, 0.9), (2, 12, 0.1), (2, 13, 0.1)], hits.schema)
    assert sorted((r["vec_id"], r["fallback"]) for r in K.with_fallback(hits, other).collect()) == [(10, False), (12, True), (13, True)]
    assert K.with_fallback(hits.limit(0), other.limit(0)).count() == 0


def test_keys_of_gaps_and_skew(spark):
    rows = spark.createDataFrame([(f"{i:06d}", "2020Q1", None if i < 12 else 1.0, float(10 ** (i // 14 * 3)) if i else None) for i in range(15)], "stock_code string, report_period string, a double, b double")
    got = {r["field"]: r["sample_keys"].split(" | ") for r in R.missing_keys(rows).collect()}
    assert got == {"a": [f"{i:06d}|2020Q1" for i in range(10)], "b": ["000000|2020Q1"]}
    assert {r["column"]: (r["n"], r["skewed"]) for r in R.skew_flags(rows, ["a", "b"]).collect()} == {"a": (3, False), "b": (14, True)}
    assert {r["column"]: (r["n"], r["skewed"]) for r in R.skew_flags(rows.limit(0), ["a"]).collect()} == {"a": (0, False)}
