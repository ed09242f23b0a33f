"""Plans of retrieval, wider searches, resumable builds and sheets from paths and tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import planning as P
from ledgerline.sources import tables as A
from ledgerline.streaming import embedding as E

GIVEN = "question_id string, text string, intent string, companies array<string>, slot_companies array<string>, topics array<string>, slot_topics array<string>, scope array<string>, mode string, needs_retrieval boolean, slot_needs boolean, top_k int"
REPORTS = "report_id string, kind string, company string, topics array<string>"


def plan(i, text, companies=None, topics=None, scope=None, intent=None, needs=None, top_k=None):
    return (i, text, intent, companies, None, topics, None, scope, None, needs, None, top_k)


def test_plans(spark):
    rows = [
        plan("null", None), plan("why", "A为什么增长", ["A"], ["品牌", "品牌", None, " "]), plan("future", "A未来趋势", ["A"], ["x"]), plan("sql", "A的原因", ["A"], intent="sql_only"), plan("sql2", "多少", intent="sql_chart", needs=True),
        plan("must", "说明", intent="sql_only", top_k=20), plan("names", "A变化", ["A"], scope=["annual_report"]), plan("plain", "行业", scope=["news", "STOCK", "industry"]), plan("open", "x", ["A"], intent="industry_open_analysis", needs=False),
    ]
    got = {r["question_id"]: r for r in P.normalized_plans(spark.createDataFrame(rows, GIVEN), vectors=False).collect()}
    brief = lambda i: (got[i]["companies"], got[i]["needs_retrieval"], got[i]["top_k"], got[i]["scope"])
    assert brief("null") == ([], True, 5, "hybrid") and got["null"]["mode"] == "metadata" and got["null"]["topics"] == []
    assert brief("why") == (["A"], True, 8, "stock") and got["why"]["topics"] == ["品牌", "增长驱动", "业务结构", "市场拓展", "产品线", "渠道"]
    assert brief("future")[0] == [] and got["future"]["topics"][:3] == ["x", "中药材", "价格"]
    assert brief("sql")[1:3] == (False, 8) and brief("sql2")[1:3] == (False, 0) and brief("must")[1:3] == (True, 20)
    assert brief("names")[3] == "hybrid" and brief("plain")[3] == "stock" and brief("open")[1:] == (False, 8, "industry")
    assert P.normalized_plans(spark.createDataFrame([], GIVEN)).collect() == []


def test_searches_widen_turn_by_turn(spark):
    plans = P.normalized_plans(spark.createDataFrame([plan("first", "A", ["A"], ["t"], ["stock"]), plan("second", "B变化", ["B"], ["u"]), plan("third", "C", ["C"], ["政策"]), plan("never", "D", ["D"], ["v"]), plan("not asked", "A", ["A"], ["t"], needs=False)], GIVEN))
    reports = spark.createDataFrame([("r1", "stock", "A", ["t", "t"]), ("r2", "stock", "A", ["t"]), ("r3", "stock", "Z", ["t"]), ("r4", "industry", None, ["渠道"]), ("r5", "stock", "C", ["气候", None]), ("r6", "industry", None, None)], REPORTS)
    got = P.searched(plans, lambda p: P.topic_hits(p, reports), [P.second_plans, P.related_plans])
    assert sorted((r["question_id"], r["report_id"], r["score"], r["place"], r["turn"]) for r in got.collect()) == [("first", "r1", 5.0, 1, 1), ("first", "r2", 5.0, 2, 1), ("second", "r4", 2.0, 1, 2), ("third", "r5", 5.0, 1, 3)]
    for p, r in ((plans.limit(0), reports), (plans, reports.limit(0))):
        assert P.searched(p, lambda x: P.topic_hits(x, r), [P.second_plans, P.related_plans]).collect() == []  # noqa: B023


def test_many_alike_reports_and_plans_against_all_pairs(spark):
    reports = spark.range(600).select(F.format_string("r%03d", "id").alias("report_id"), F.when(F.col("id") % 4 == 0, "industry").otherwise("stock").alias("kind"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), F.col("id") % 3)).alias("company"), F.when(F.col("id") % 7 < 6, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("topics"))
    plans = spark.range(40).select(F.col("id").cast("string").alias("question_id"), F.array(F.concat(F.lit("c"), F.col("id") % 3)).alias("companies"), F.array(F.lit("a"), F.lit("b")).alias("topics"), (F.col("id") % 2 * 5 + 3).cast("int").alias("top_k"), F.when(F.col("id") % 5 == 0, "industry").when(F.col("id") % 5 == 1, "stock").otherwise("hybrid").alias("scope"))
    expected = []
    for q in plans.collect():
        inside = [r for r in reports.collect() if q["scope"] in ("hybrid", r["kind"]) and (q["scope"] != "stock" or r["company"] in q["companies"])]
        scores = sorted((-2.0 * len(r["topics"]) - 3.0 * (r["company"] in q["companies"]), r["report_id"]) for r in inside)[: q["top_k"]]
        expected += [(q["question_id"], r, -s, n) for n, (s, r) in enumerate(scores, 1)]
    assert sorted(tuple(r) for r in P.topic_hits(plans, reports).collect()) == sorted(expected)


def test_build_goes_on_after_a_kill_between_batches(spark, tmp_path, monkeypatch):
    source, target = str(tmp_path / "chunks"), str(tmp_path / "index")
    rows = spark.range(24).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows.repartition(6).write.parquet(source)
    note = E._note

    def killed(session, home, number, *more):
        if number == 1:
            raise KeyError("killed")
        note(session, home, number, *more)

    monkeypatch.setattr(E, "_note", killed)  # batch 1 is written, but neither noted nor committed
    with pytest.raises(Exception, match="killed"):
        E.build_resumable(spark, source, target, "m", files_a_batch=2)
    part = E.progress(spark, target, "m", 24).first()
    assert (part["batches"], part["index_status"]) == (1, "partial") and part["embedded"] == E.embedded(spark, target, "m", 24).count() < 24
    monkeypatch.setattr(E, "_note", note)
    E.build_resumable(spark, source, target, "m", files_a_batch=2, most_batches=1)
    assert E.progress(spark, target, "m", 24).first()["batches"] == 2
    for _ in range(2):
        E.build_resumable(spark, source, target, "m", files_a_batch=2)
    assert E.progress(spark, target, "m", 24).first().asDict() == {"model": "m", "chunk_count": 24, "embedded": 24, "batches": 3, "dim": 16, "index_status": "ready"}
    assert sorted(int(r[0]) for r in E.embedded(spark, target, "m", 24).select("chunk_id").collect()) == list(range(24))
    rows.limit(1).write.mode("append").parquet(source)  # another number of chunks begins anew
    E.build_resumable(spark, source, target, "m", files_a_batch=20)
    assert E.progress(spark, target, "m", 25).first()["batches"] == 1 and E.embedded(spark, target, "m", 25).count() == 25


def test_sheets_from_paths_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("42", 1.5, "x"), ("1234567", None, None)], "stock_code string, eps double, other string")
    schema = {"stock_code": "string", "eps": "double", "roe": "double"}
    want = [("000042", 1.5, None), ("1234567", None, None)]
    for kind in ("parquet", "csv", "json", "orc"):
        rows.write.format(kind).option("header", True).save(str(tmp_path / kind))
        assert sorted(tuple(r) for r in A.read_sheet(spark, path=str(tmp_path / kind), schema=schema, kind=kind).collect()) == want
    rows.write.option("path", str(tmp_path / "table")).saveAsTable("ledgerline_sheet")
    try:
        assert sorted(tuple(r) for r in A.read_sheet(spark, table="ledgerline_sheet", schema=schema).collect()) == want
        assert A.read_sheet(spark, table="ledgerline_sheet").columns == rows.columns
    finally:
        spark.sql("DROP TABLE ledgerline_sheet")
    for wrong in ({}, {"path": "a", "table": "b"}):
        with pytest.raises(ValueError):
            A.read_sheet(spark, **wrong)


def test_database_options():
    got = A.jdbc_options("jdbc:x", "income_sheet", ("report_year", 2015, 2024, 10), user="u")
    assert got == {"url": "jdbc:x", "dbtable": "income_sheet", "fetchsize": "10000", "pushDownPredicate": "true", "user": "u", "partitionColumn": "report_year", "lowerBound": "2015", "upperBound": "2024", "numPartitions": "10"}
    assert "partitionColumn" not in A.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError):
        A.jdbc_options("jdbc:x", "t", ("y", 3, 2, 4))
