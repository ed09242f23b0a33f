"""Candidate pages, issues, rows to check by hand, shared remarks."""

from __future__ import annotations

import json

from ledgerline.operators import audits as A


def test_pages_of_sheets(spark):
    labels = {"kpi": ["营业收入（元）", "净利润"], "income": ["营业 收入(元)"], "cash": []}
    rows = [(1, "营业收入\n（元） 净 利润", "clash"), (2, "营业收入(元)", "c"), (3, "目录 净利润" + "1" * 99, "c"), (4, "目 录 财务报告 净利润 营业收入(元)", "c"), (5, "١" * 80, "c"), (6, "1" * 79, "c"), (7, None, "c"), (8, "", "c"), (9, "x" * 1_200_000 + "营业收入(元)", "c")]
    got = {(r["i"], r["sheet"]): (r["hits"], r["digits"]) for r in A.candidate_pages(spark.createDataFrame(rows, "i int, text string, sheet string"), labels).collect()}
    assert got == {(1, "kpi"): (2, 0), (1, "income"): (1, 0), (2, "income"): (1, 0), (4, "kpi"): (2, 0), (4, "income"): (1, 0), (5, "kpi"): (0, 80), (5, "income"): (0, 80), (5, "cash"): (0, 80), (9, "income"): (1, 0)}


def test_issues(spark):
    issues = spark.createDataFrame([("a", "r", "error"), ("a", "r", "error"), ("a", "s", None), (None, "r", "warning")], "sheet string, rule string, severity string")
    assert {tuple(r) for r in A.issue_counts(issues).collect()} == {("a|error", 2), ("a|", 1), ("|warning", 1)}
    anomalies = spark.createDataFrame([("a", "f", "amount")] * 3, "sheet string, field string, anomaly string")
    assert {tuple(r) for r in A.anomaly_summary(anomalies, issues).collect()} == {("a", "f", "amount", 3), ("a", "r", "validation_error", 2), ("a", "s", "validation_", 1), (None, "r", "validation_warning", 1)}
    assert A.issue_counts(issues.limit(0)).count() == 0 and A.anomaly_summary(anomalies.limit(0), issues.limit(0)).count() == 0


def test_rows_to_check(spark):
    rows = [(f"{i:06}", "n", p, 2020, float(i)) for i in range(9) for p in ("2020Q1", "2020FY")] + [(None, None, None, None, None)]
    df = spark.createDataFrame(rows, "stock_code string, stock_abbr string, report_period string, report_year int, net_profit double")
    got = A.rows_to_check({"income": df, "other": df.limit(1)}).collect()
    first = [r for r in got if r["sheet"] == "income"]
    assert len(first) == 8 and first[0]["stock_code"] is None and [r["stock_code"] for r in first[1:]] == [f"{i:06}" for i in range(7)] and {r["report_period"] for r in first[1:]} == {"2020FY"}
    assert json.loads(first[2]["sampled_field_values"]) == {"total_operating_revenue": None, "total_operating_expenses": None, "operating_profit": None, "net_profit": 1.0}
    assert [r["sampled_field_values"] for r in got if r["sheet"] == "other"] == ["{}"]
    assert A.rows_to_check({"kpi": df.limit(0)}).count() == 0


def test_shared_remarks(spark):
    df = spark.createDataFrame([(" x", "a", None, "s", 1), ("x ", "b", " ", "s", 1), ("", "b", None, "s", 1)], "`总评价.一` string, `判断` string, `结论` string, stock_code string, `说明` int")
    assert [tuple(r) for r in A.shared_remarks(df).collect()] == [("总评价.一", "研报证据支撑：x")]
    assert A.shared_remarks(df.limit(0)).collect() == [] and A.shared_remarks(df.select("stock_code")).collect() == []
