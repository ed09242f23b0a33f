"""Companies of questions, and places without a window over a group."""

from __future__ import annotations

import random

from ledgerline.operators import resolution as L
from ledgerline.operators import shapes as S


def test_ways_in_order_and_longest_names(spark):
    names = spark.createDataFrame([("000999", "华润三九"), ("000538", "云南白药"), ("600080", "金花股份"), ("600081", "白药"), ("600082", "Ali Health"), ("600083", "甲乙（集团）"), ("600084", "")], "stock_code string, stock_abbr string")
    aliases = spark.createDataFrame([("金花", "金花股份"), ("三九", "华润三九"), ("unknown", "nobody")], "alias string, stock_abbr string")
    rows = {
        1: ("云南白药与999、600082比较", ["华润三九", "Ali Health", "云南白药"]), 2: ("白药和云南白药", ["白药", "云南白药"]), 3: ("金花的利润", ["金花股份"]), 4: ("甲 乙怎么样", ["甲乙（集团）"]), 5: ("公司名称：Ali（中国）集团，", ["Ali Health"]),
        6: ("Ali Heal th", ["Ali Health"]), 7: ("1999年 0009991", None), 8: (None, None), 9: ("", None), 10: ("公司简称 白", None),
    }
    questions = spark.createDataFrame([(i, t, "x") for i, (t, _) in rows.items()], "question_id long, text string, stock_code string")
    got = {r["question_id"]: r["companies"] for r in L.resolved_companies(questions, names, aliases).collect()}
    want = {i: w for i, (_, w) in rows.items() if w}
    assert got == want
    assert L.resolved_companies(questions.limit(0), names, aliases).count() == 0


def test_places_are_exact_with_ties(spark):
    r = random.Random(1)
    rows = [(f"c{i:04d}", "ab"[i % 2], r.choice([0.0, 0.0, 0.0, r.random()])) for i in range(3_000)]
    x = spark.createDataFrame(rows, "stock_code string, report_period string, v double").repartition(4)
    out = S.places(x, "report_period", "v", "stock_code", 8)
    got = {(p["report_period"], p["stock_code"]): p["place"] for p in out.collect()}
    for g in "ab":
        for place, (code, _, _) in enumerate(sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0])), 1):
            assert got[g, code] == place
    assert S.places(x.limit(0), "report_period", "v", "stock_code").count() == 0
