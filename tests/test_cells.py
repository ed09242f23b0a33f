"""Grids of raw cells: labels over several rows."""

from __future__ import annotations

from ledgerline.operators import cells as C

ROWS = [("一、资产", None), ("（二）货币", None), ("资金", "1,200"), ("（二）短期借款", None), ("（三）存货", None), ("应收账款", "(5)"), ("应付", None), ("账款", "7"), ("合计", None), ("以上", None)]


def test_rows_are_stitched_in_windows_without_buffers(spark):
    """labels of rows without numbers go before the next row with numbers, the last ones stay together; nothing is gathered in aggregates that spill."""
    grid = spark.createDataFrame([(r, "balance", i, [label, number]) for r in ("a", "b") for i, (label, number) in enumerate(ROWS)], "record string, sheet string, row_idx int, cells array<string>")
    out = C.stitched(C.latched(C.labelled(C.filled_rows(grid.orderBy("record", "cells")))))
    got = sorted((r["record"], r["row_idx"], r["label"], r["numbers"]) for r in out.collect())
    want = [(2, "一、资产(二)货币资金", ["1,200"]), (3, "(二)短期借款", []), (5, "(三)存货应收账款", ["(5)"]), (7, "应付账款", ["7"]), (9, "合计以上", [])]
    assert got == sorted((r, *x) for r in ("a", "b") for x in want)
    plan = C.fields_of(grid)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan
    fields = {(r["field"], r["value"], r["row_idx"]) for r in C.fields_of(grid).where("record = 'a'").collect()}
    assert ("liability_short_term_loans", 0.0, 3) in fields and ("asset_accounts_receivable", -5.0, 5) in fields and ("asset_cash_and_cash_equivalents", 1200.0, 2) in fields
