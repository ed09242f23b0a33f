"""Readers, writers, incremental build and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import periods as D
from ledgerline.sources import tables as A
from ledgerline.streaming import embedding as E


def test_manifest(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text("source_name,stock_code,stock_abbr,year,report_year,period_norm,report_period,is_english_version,selected\na.pdf,42,A,2020,nan,Q1,,false,true\nb.pdf,43,B,2020,2021,Q1,H1,true,true\nc.pdf,44,C,2020,2021,Q1,H1,false,false\n", encoding="utf-8")
    assert [tuple(r) for r in A.read_manifest(spark, path).collect()] == [("a.pdf", "000042", "A", 2020, "Q1")]


def test_sheet_round_trip(spark, tmp_path):
    path = str(tmp_path / "sheet")
    schema = {"a": "int", "b": "double", "c": "string"}
    for _ in range(2):
        A.write_sheet(spark.createDataFrame([(1, "x")], "a int, c string"), path, schema)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(1, None, "x")] * 2
    A.export_csv(spark.read.parquet(path), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_incremental_build_equals_one_build(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("text of "), "id").alias("text"))
    source, sink, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for part in (rows.where("chunk_id < 10"), rows.where("chunk_id >= 10")):
        part.write.mode("append").parquet(source)
        E.build(spark, source, sink, cp, "v1")
    E.build(spark, source, sink, cp, "v1")
    E.build(spark, source, sink, cp, "v2")
    first, second = (sorted(map(str, E.built(spark, sink, v).select("chunk_id", "embedding").collect())) for v in ("v1", "v2"))
    assert first == second and len(first) == 20


def test_numbers(spark):
    cases = [("1,234.5", 1234.5), ("(12)", -12.0), ("（3.5）", -3.5), ("－7", -7.0), ("12%", 12.0), ("--", None), ("", None), ("3亿元", 3.0), (None, None), ("不适用", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "x string").select(T.plain_number(F.col("x")).alias("v"), T.number(F.col("x")).alias("n"))
    assert [r["v"] for r in df.collect()] == [v for _, v in cases]
    assert df.collect()[7]["n"] == 30_000.0


def test_field_rules(spark):
    df = spark.createDataFrame([(None, 2.0, 3.0), (0.0, 2.0, 3.0), (1.0, None, None)], "d double, r double, x double")
    got = {m: [r[0] for r in df.select(D.field_rule(m, F.col("d"), F.col("r"), F.col("x"))).collect()] for m in ("direct", "reuse", "direct_or_reuse", "prefer_reuse", "derive", "direct_or_derive", "prefer_derive")}
    assert got == {"direct": [None, 0.0, 1.0], "reuse": [2.0, 2.0, None], "direct_or_reuse": [2.0, 2.0, 1.0], "prefer_reuse": [2.0, 2.0, 1.0], "derive": [3.0, 3.0, None], "direct_or_derive": [3.0, 0.0, 1.0], "prefer_derive": [3.0, 3.0, 1.0]}


def test_sentences_and_windows(spark):
    df = spark.createDataFrame([("ab. " * 60,), ("short.",)], "x string")
    assert [len(r[0]) for r in df.select(T.dense_sentences(F.col("x"))).collect()] == [60, 1]
    assert [r[0] for r in spark.createDataFrame([("abcdefghij",)], "x string").select(T.windows(F.col("x"), 4, 1)).collect()] == [["abcd", "defg", "ghij"]]


def test_facts_bring_rows_together_before_they_are_summed(spark):
    from ledgerline.sources import statements as S

    tables = {t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "part")}
    got, plain = (spark.sql(f"WITH {sql} SELECT * FROM base", **tables) for sql in (S.SPARK_FACTS, S.FACTS))
    assert got.schema == plain.schema and got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    plan = spark.sql(f"WITH {S.SPARK_FACTS} SELECT * FROM base", **tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") < plan.rindex("REBALANCE_PARTITIONS_BY_COL")  # the lowest aggregate is above the exchange


def test_amounts_of_facts_are_summed_as_whole_numbers(spark):
    """no sum of decimals from rows, and the same ones: ties, signs, large amounts, nulls, sums beyond 2**53 and 2**63 ten-thousandths."""
    from ledgerline.sources import statements as N

    assert "SUM(CAST(" in N.FACTS and "SUM(CAST(" not in N.SPARK_FACTS
    values = [0.00005, 0.00015, -0.00025, 1.00005, -0.0, 12.345678, 9.9e12, -9.9e12, 8_765_432_198.7654, 1e-9, None]
    lineitem = spark.createDataFrame([(1 + i % 4, j, 5.0, v, d, 0.08, "ANR"[j % 3], "OF"[j % 2]) for j, v in enumerate(values) for d in (0.0, 0.07) for i in range(4 if j != 6 else 800)], "l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    lineitem = lineitem.selectExpr("*", "timestamp'1995-02-03' + make_interval(0, int(l_partkey)) AS l_shipdate")
    part = spark.createDataFrame([(j, 901.01 + j) for j in range(len(values))], "p_partkey long, p_retailprice double")
    rows = [sorted(map(repr, spark.sql(f"WITH {sql} SELECT * FROM base", lineitem=lineitem, part=part).collect())) for sql in (N.FACTS, N.SPARK_FACTS)]
    assert rows[0] == rows[1] and len(rows[0]) > 10
