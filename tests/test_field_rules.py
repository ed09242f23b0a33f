"""Stages, cycles and modes of field rules; the repeated pass over key figures."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evidence as E
from ledgerline.operators import field_rules as R

KEYS = "stock_code string, report_period string, report_year int"
ROW = ("000001", "2022Q3", 2022)


def test_stages_follow_what_rules_read():
    order = {name: i for i, stage in enumerate(R.stages()) for name in stage}
    assert len(order) == 22
    assert order["cash.net_cash_flow"] < order["cash.operating_cf_ratio_of_net_cf"]
    assert order["balance.equity_total_equity"] < order["kpi.roe"] and order["kpi.net_profit_10k_yuan"] < order["kpi.net_asset_per_share"]
    assert order["kpi.total_operating_revenue"] < order["kpi.gross_profit_margin"]


def test_cycles_and_unknown_modes_are_refused():
    add = lambda a, b: a + b
    rules = {"a": {"x": ("derive", None), "y": ("direct_or_derive", None)}}
    with pytest.raises(ValueError, match=r"a\.x, a\.y"):
        R.stages(rules, {"a.x": R.Derivation(("a.y", "a.z"), add), "a.y": R.Derivation(("a.x", "a.z"), add)})
    with pytest.raises(ValueError, match="guess"):
        R.stages({"a": {"x": ("guess", None)}}, {})
    own = {"a.x": R.Derivation(("a.x", "a.z"), add)}
    assert R.stages({"a": {"x": ("derive", None)}}, own) == [["a.x"]]


@pytest.mark.parametrize(
    ("mode", "own", "source", "derived", "want"),
    [
        ("direct", 5.0, 1.0, 2.0, 5.0), ("direct", 2_000.0, 1.0, 2.0, None), ("direct_or_reuse", None, 1.0, 2.0, 1.0), ("direct_or_reuse", 0.0, 1.0, 2.0, 0.0), ("direct_or_reuse", 5.0, 1.0, 2.0, 5.0), ("reuse", None, 1.0, 2.0, 1.0),
        ("prefer_reuse", 5.0, 1.0, 2.0, 1.0), ("prefer_reuse", 5.0, None, 2.0, 5.0), ("derive", None, 1.0, 2.0, 2.0), ("direct_or_derive", 5.0, 1.0, 2.0, 5.0), ("direct_or_derive", 2_000.0, 1.0, 2.0, 2.0), ("direct_or_derive", 2_000.0, 1.0, None, 2_000.0),
        ("prefer_derive", 5.0, 1.0, 2.0, 2.0), ("prefer_derive", 5.0, 1.0, None, 5.0),
    ],
)
def test_modes(spark, mode, own, source, derived, want):
    x = spark.createDataFrame([(own, source, derived)], "own double, source double, derived double")
    assert x.select(R.filled("roe", mode, F.col("own"), F.col("source"), F.col("derived"))).first()[0] == want


def test_records_without_a_sheet_stay(spark):
    kpi = spark.createDataFrame([(*ROW, "n", 0.5, None, None)], f"{KEYS}, stock_abbr string, eps double, roe double, total_operating_revenue double")
    income = spark.createDataFrame([(*ROW, 100.0, 10.0), ("000002", "2022FY", 2022, 7.0, 1.0)], f"{KEYS}, total_operating_revenue double, net_profit double")
    balance = spark.createDataFrame([(*ROW, 90.0, 50.0, None)], f"{KEYS}, asset_total_assets double, liability_total_liabilities double, equity_total_equity double")
    cash = spark.createDataFrame([], f"{KEYS}, operating_cf_net_amount double")
    out = {r["stock_code"]: r for r in R.apply_rules({"income": income, "balance": balance, "cash": cash, "kpi": kpi}).collect()}
    one, two = out["000001"], out["000002"]
    assert (one["balance.equity_total_equity"], one["kpi.roe"], one["kpi.total_operating_revenue"], one["kpi.net_profit_margin"]) == (40.0, 25.0, 100.0, 10.0)
    assert two["kpi.roe"] is None and two["has_kpi"] is None and two["income.net_profit"] == 1.0


def kpi_chain(spark, passes: int):
    kpi = spark.createDataFrame([(*ROW, 1_000.0, 10.0, 0.5, 6.0, 900.0, 2_000.0, None)], f"{KEYS}, total_operating_revenue double, net_profit_10k_yuan double, eps double, gross_profit_margin double, net_asset_per_share double, net_profit_margin double, operating_cf_per_share double")
    income = spark.createDataFrame([(*ROW, 100.0, 10.0, 94.0)], f"{KEYS}, total_operating_revenue double, net_profit double, operating_expense_cost_of_sales double")
    none = spark.createDataFrame([], f"{KEYS}, equity_total_equity double, operating_cf_net_amount double")
    return E.settled_kpi(kpi, income, none, none, passes).first()


def test_second_pass_follows_replaced_revenue(spark):
    one, two, three = (kpi_chain(spark, n) for n in (1, 2, 3))
    steps = lambda r: [(h["step"], h["field"], h["before"], round(h["after"], 6) if h["after"] is not None else None) for h in r["history"]]
    first = {("sanitize", "net_profit_margin", 2_000.0, None), ("sanitize", "net_asset_per_share", 900.0, None), ("enrich 1", "total_operating_revenue", 1_000.0, 100.0), ("enrich 1", "gross_profit_margin", 6.0, 90.6), ("enrich 1", "net_profit_margin", None, 1.0)}
    assert {*steps(one)} == first and round(one["gross_profit_margin"], 6) == 90.6
    assert {*steps(two)} == first | {("enrich 2", "gross_profit_margin", 90.6, 6.0)} and two["gross_profit_margin"] == 6.0
    assert steps(three) == steps(two)
