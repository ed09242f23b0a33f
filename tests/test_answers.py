"""Versions of reports, routes of questions, references and fused rows, drawings, limits by name."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import charts as C
from ledgerline.operators import references as N
from ledgerline.operators import routing as L
from ledgerline.operators import versions as A
from ledgerline.operators import view as V


def test_titles(spark):
    names = [" 甲 公司：甲公司2023年年度报告（更正后）(1).PDF", "甲：2023年第一季度报告摘要(英文版).pdf", "甲：2023年半年度报告.pdf", "甲：1999年年度报告.pdf", "甲2023年年度报告.pdf", "甲：2023年年报.pdf", "甲：2023年年度报告.txt", "：2023年三季度报告.pdf", "", None, "甲　乙：2024年第三季度报告更新后.pdf"]
    got = A.titled(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, company_norm int")).orderBy("company_norm").collect()
    brief = [(r["company"], r["year"], r["period"], r["report_type"], r["correction"], r["duplicate"], r["english"], r["canonical_name"]) for r in got]
    assert brief[0] == ("甲公司", 2023, "年度", "全文", "更正后", True, False, "甲公司：2023年年度报告全文.pdf")
    assert brief[1] == ("甲", 2023, "一季度", "摘要", "", False, True, "甲：2023年一季度报告摘要.pdf")
    assert brief[2][2] == "半年度" and brief[7][:3] == ("", 2023, "三季度") and brief[10][:5] == ("甲乙", 2024, "三季度", "全文", "更新后")
    assert [r["parsed"] for r in got] == [True, True, True, False, False, False, False, True, False, False, True]
    assert all(x is None for r in (got[3], got[8], got[9]) for x in (r["company"], r["year"], r["canonical_name"]))


def test_versions_by_each_rule(spark):
    rules = [("更新后", "（英文版）更正后"), ("", "更新后"), ("（英文版）", ""), ("(1)", ""), ("", "全文"), ("a", "b")]
    names = [f"公司{i}：2023年年度报告{t}.pdf" for i, pair in enumerate(rules) for t in pair] + ["公司9：2023年年度报告.pdf"] * 3 + ["公司9：2023年年度报告摘要.pdf", "x.pdf", None]
    files = A.titled(spark.createDataFrame([(n,) for n in names], "name string"))
    got = A.versions(files).collect()
    assert {r["name"] for r in got if r["selected"] and r["group_size"] == 2} == {f"公司{i}：2023年年度报告{better}.pdf" for i, (_, better) in enumerate(rules)}
    assert sorted((r["group_size"], r["selected"]) for r in got if r["company"] == "公司9") == [(1, True), (3, True), (3, True), (3, True)]
    assert {r["company"]: r["selection_reason"] for r in got}["公司1"] == "corrected_preferred" and {r["company"]: r["selection_reason"] for r in got}["公司2"] == "single_or_best_available"
    summary = A.selection_summary(files).first()
    assert tuple(summary) == (16, 2, 8, 7, "x.pdf")
    empty = files.limit(0)
    assert A.versions(empty).count() == 0 and tuple(A.selection_summary(empty).first()) == (0, 0, 0, 0, "")


def test_routes(spark):
    rows = [
        ("净利润的柱状图", None, ["净利润"], ("sql_chart", True, False)), ("柱状图", None, None, ("open_analysis", False, True)), ("净利润柱状图的原因", None, ["净利润"], ("causal_analysis", True, True)), ("为什么", None, None, ("causal_analysis", False, True)),
        ("行业观点", None, None, ("industry_open_analysis", False, True)), ("行业观点", ["A"], ["净利润"], ("hybrid_sql_rag", True, True)), ("行业观点", None, ["净利润"], ("industry_open_analysis", True, True)), ("行业净利润", None, ["净利润"], ("hybrid_sql_rag", True, True)),
        ("行业", ["A"], [], ("industry_open_analysis", False, True)), ("哪些", [], [], ("sql_only", True, False)), ("A", ["A"], None, ("rag_only", False, True)), ("观点", None, None, ("open_analysis", False, True)), (None, None, None, ("open_analysis", False, True)), ("", ["A"], None, ("rag_only", False, True)),
    ]
    df = spark.createDataFrame([(i, *r[:3], None, None, None, None) for i, r in enumerate(rows)], "i int, text string, companies array<string>, metrics array<string>, periods array<string>, topics array<string>, top_n int, threshold double")
    assert [(x["intent"], x["needs_sql"], x["needs_retrieval"]) for x in L.routed(df).orderBy("i").collect()] == [r[3] for r in rows]
    assert L.routed(df.limit(0)).columns == [*df.columns, "needs_sql", "intent", "needs_retrieval"]


HITS = "query_id long, place int, path string, text string, chunk_text string, captions array<string>, chunk_captions array<string>, visual string, picture string"


def test_references(spark):
    hit = lambda q, p, text="t", captions=None, chunk=None, visual=None: (q, p, f"/b/{p}", text, "c", captions, chunk, visual, "clash")
    rows = [hit(1, p) for p in range(1, 20)] + [hit(1, 20, visual="v"), hit(1, 21, visual="w")]  # a picture at the last place looked at
    rows += [hit(2, p, captions=["a", "", None, "d"] if p == 6 else []) for p in range(1, 8)] + [hit(3, 1, "x" * 5_000_000, visual=" "), hit(3, 2, " ", [], ["k"], "k"), hit(3, 3, None, None, ["k"], "l"), hit(4, p := 1), hit(5, 21, visual="w")]
    rows += [hit(6, p, visual="z" if p in (5, 6) else None) for p in range(1, 8)]
    got = {(r["query_id"], r["place"]): r for r in N.references(spark.createDataFrame(rows, HITS), "/b/").collect()}
    assert len(got) == 5 + 5 + 3 + 1 + 5
    assert got[1, 5]["picture"] == "v" and got[1, 5]["path"] == "./20" and got[1, 4]["picture"] is None
    assert got[2, 5]["picture"] == "a" and got[2, 5]["path"] == "./6"
    assert len(got[3, 1]["text"]) == 600 and got[3, 1]["picture"] is None and got[3, 2]["picture"] == "k" and got[3, 2]["text"] == "c" and got[3, 3]["picture"] == "k；l"
    assert got[6, 5]["path"] == "./5" and got[4, 1]["path"] == "./1"
    assert N.references(spark.createDataFrame([], HITS), "/b").count() == 0


def test_paths_and_captions(spark):
    paths = {None: "", " ": "", "/b/正式数据/附件5：研报数据/x/y.pdf": "../附件 5：研报数据/x/y.pdf", "/b/a/正式数据//z/": "../z", "/b/正式数据": "../", "/b/正式数据2/x": "./正式数据2/x", "/b/附件5：研报数据/x": "./附件5：研报数据/x", "/bb/x": "/bb/x", "rel/x": "rel/x", "/": "/"}
    df = spark.createDataFrame(list(paths.items()), "p string, want string")
    assert df.where(~N.relative_path(F.col("p"), "/b").eqNullSafe(F.col("want"))).collect() == []
    df = spark.createDataFrame([("图", " 收入 ", "图：收入"), (None, "x", "x"), ("图 ", "", "图"), (None, None, "")], "a string, b string, want string")
    assert df.where(N.caption(F.col("a"), F.col("b")) != F.col("want")).collect() == []


def test_fused_rows(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    rows = spark.createDataFrame([(1, p, f"r{p}") for p in range(9, 0, -1)] + [(2, None, "unplaced"), (4, 1, "of no question"), (2, 1, None)], "query_id long, place int, row string")
    evidence = spark.createDataFrame([(1, 2, "b", "stock"), (1, 1, "a", None), (1, 6, "f", "stock"), (3, 1, None, "")], "query_id long, place int, title string, source_type string")
    got = {r["query_id"]: tuple(r)[1:] for r in N.fused(questions, rows, evidence).collect()}
    assert got == {1: (9, 3, ["r1", "r2", "r3", "r4", "r5"], ["a", "b"], '{"stock":2,"unknown":1}'), 2: (2, 0, [""], [], "{}"), 3: (0, 1, [], [""], '{"unknown":1}')}
    assert N.fused(questions, rows.limit(0), evidence.limit(0)).where("sql_row_count + evidence_count > 0").count() == 0


def test_drawings(spark):
    df = spark.createDataFrame([("a", 1.0, 7), ("a", 5.0, 1), ("b", None, 2), ("c", -3.0, 3), (None, 99.0, 4)], "k string, v double, other int")
    assert [tuple(r) for r in C.charted(df, "k", "v", n=2).collect()] == [("a", 5.0, 1), ("c", -3.0, 2)]
    assert [tuple(r)[0] for r in C.charted(df, "k", "v", ascending=True).collect()] == ["c", "a", "b"]
    low = df.withColumn("v", -F.abs("v"))
    assert {r["k"]: r["v"] for r in C.charted(low, "k", "v").collect()} == {"a": -5.0, "b": None, "c": -3.0}
    single = df.where("other <> 1")
    assert C.charted(single, "k", "v").columns == ["k", "v", "other"] and [r["k"] for r in C.charted(single, "k", "v", sort_by="other", n=1).collect()] == ["a"]
    text = spark.createDataFrame([("s", "10"), ("s", "9"), ("s", "x"), ("t", None), ("t", "1")], "k string, v string")
    assert [(r["k"], r["v"], r["place"]) for r in C.charted(text, "k", "v", series="k", n=2, collapse=False).orderBy("k", "place").collect()] == [("s", "10", 1), ("s", "9", 2), ("t", "1", 1), ("t", None, 2)]
    words = text.where("v = 'x' or v is null")
    assert [r["v"] for r in C.charted(words, "k", "v", n=5).collect()] == ["x", None]
    assert C.charted(df.limit(0), "k", "v", n=3).collect() == []


def test_scales(spark):
    df = spark.createDataFrame([(2e5, 2e5, None, "7"), (None, None, 5.0, "x")], "revenue double, ROE_margin double, small double, written string")
    got = C.scaled(df, df.columns).orderBy("revenue").collect()
    assert [(r["revenue"], r["ROE_margin"], r["small"], r["written"]) for r in got] == [(0.0, 0.0, 5.0, 0.0), (20.0, 2e5, 0.0, 7.0)]
    assert tuple(got[0][f"{c}_unit"] for c in df.columns) == ("万元", "%", "", "")
    assert C.scaled(df.limit(0), ["revenue"]).count() == 0 and C.scaled(df, ["ROE_margin"]).first()["ROE_margin_unit"] == "%"


@pytest.mark.parametrize("name, value, want", [("roe", 1001.0, None), ("roe", -1000.0, -1000.0), ("Revenue_Growth", 2000.0, None), ("revenue", 1e8, 1e8), ("revenue", -1.1e8, None), ("eps", 1e12, 1e12), ("净利率", 1500.0, None), ("资产", 2e8, None), ("revenue", None, None)])
def test_limits_by_name(spark, name, value, want):
    assert V.clamped_by_name(spark.createDataFrame([(value, "1e99")], f"`{name}` double, revenue_text string")).first() == (want, "1e99")
