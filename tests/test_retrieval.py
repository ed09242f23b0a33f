"""Retrieval over more queries than a broadcast takes."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerline.operators import retrieval as K


def test_top_k_of_many_queries_meets_in_blocks(spark):
    r = random.Random(3)
    rows = [(i, [r.randint(-8, 8) / 4 for _ in range(5)], i % 3) for i in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = K.exact_top_k(vectors, vectors.where("vec_id % 2 = 0"), 4, block=4, stripes=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    want = set()
    for q, x, _ in rows[::2]:
        scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i, label) for i, y, label in rows if i != q)[:4]
        want |= {(q, i, label, -s, n + 1) for n, (s, i, label) in enumerate(scores)}
    got = [tuple(x) for x in out.select("query_id", "vec_id", "label", "score", "rank").collect()]
    assert len(got) == len(want) and {x[:3] + x[4:] for x in got} == {x[:3] + x[4:] for x in want}
    assert sorted(x[3] for x in got) == pytest.approx(sorted(x[3] for x in want))


def test_top_k_rounds_before_it_ranks(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.5000004, 0.0], "b"), (2, [0.4999996, 1.0], "c"), (3, [0.4], "d"), (4, None, "e"), (5, [], "f")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    out = K.exact_top_k(vectors, vectors.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"], r["label"]) for r in out] == [(1, 0.5, "b"), (2, 0.5, "c"), (3, 0.4, "d")]
    assert K.exact_top_k(vectors, vectors.where("false"), 3).count() == 0


def test_names_of_any_form_are_found(spark):
    names = spark.createDataFrame([("1", "云南白药"), ("2", "Ali Health"), ("3", "白药"), ("4", "")], "stock_code string, stock_abbr string")
    asked = spark.createDataFrame([(1, "云南白药2023年利润"), (2, "比较Ali Health与白药"), (3, "无"), (4, None)], "question_id long, text string")
    assert {r["question_id"]: r["companies"] for r in K.companies(asked, names).collect()} == {1: "1,3", 2: "2,3"}


def test_companies_come_from_fitting_stock_evidence(spark):
    asked = spark.createDataFrame([(1, "哪些公司有商誉减值风险"), (2, "有哪些公司")], "question_id long, text string")
    rows = [(q, i, kind, c, t, "") for q in (1, 2) for i, kind, c, t in [(1, "stock", "B 公司", "商誉 减值"), (2, "industry", "A", "商誉减值"), (3, "stock", "A", "商誉"), (4, "stock", "b公司", "商誉减值"), (5, "stock", "none", "x")]]
    evidence = spark.createDataFrame(rows, "question_id long, place int, source_type string, company string, title string, snippet string")
    names = spark.createDataFrame([("A",), ("B公司",)], "stock_abbr string")
    assert {r["question_id"]: r["companies"] for r in K.evidence_companies(asked, evidence, names).collect()} == {1: ["B公司"], 2: ["B公司", "A"]}


def test_slots_of_questions(spark):
    asked = [
        ("2022年第三季度与2023年营收超过1.5 亿元的公司", "2022Q3,2023FY", None, 15_000.0),
        ("2020-2022年第三季度净利润前5家", "2022Q3,2020Q3,2021Q3", 5, None),
        ("2024年前三季度毛利率不低于30%", "2024Q3", None, 30.0),
        ("去年上半年Top3，2021年年度，2021年度，2020年第四季度", "2021FY,2024FY", 3, None),
        ("不少于20000元", "", None, 2.0),
        ("", "", None, None),
        (None, "", None, None),
    ]
    questions = spark.createDataFrame([(i, x[0]) for i, x in enumerate(asked)], "question_id int, text string")
    out = K.slots(questions, this_year=2025).orderBy("question_id").collect()
    assert [(",".join(r["periods"]), r["top_n"], r["threshold"]) for r in out] == [x[1:] for x in asked]


def test_metadata_scores_against_a_plain_count(spark):
    asked = [(1, "比较 甲药 集采", ["甲药"], ["集采"]), (2, "乙 行业", [], None), (3, "丙丙 丙丙", ["丁丁"], []), (4, None, None, None), (5, "", ["无此"], [])]
    reports = [(1, "stock", "甲药点评", "甲药", "机构"), (2, "industry", "集采 甲药", None, ""), (3, "stock", "丙丙", "", "x"), (4, "industry", "", "", ""), (5, "industry", "丙丙丁丁", "", "")]
    got = K.metadata_scores(spark.createDataFrame(asked, "question_id int, text string, companies array<string>, topics array<string>"), spark.createDataFrame(reports, "report_id int, kind string, title string, company string, organization string"), 2)
    want = set()
    for q, text, companies, topics in asked:
        scores = []
        for r, kind, *parts in reports:
            held = " ".join(p for p in parts if p)
            own = [c for c in companies or [] if c in held]
            score = 3.0 * len(own) + 2.0 * sum(t in held for t in topics or []) + 0.2 * sum(len(t) > 1 and t in held for t in (text or "").split())
            score -= 2.5 if kind == "stock" and companies and not own else 0
            score += 1 if kind == "industry" and any(w in (text or "") for w in K.INDUSTRY_WORDS) else 0
            scores += [(-round(score, 6), r)] if score > 0 else []
        want |= {(q, r, -s, i + 1) for i, (s, r) in enumerate(sorted(scores)[:2])}
    assert {tuple(r) for r in got.collect()} == want


def test_stripes_grow_with_the_vectors(spark):
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in K.exact_top_k(vectors, vectors.where("vec_id % 3 = 0"), 4, block=10, stripe=10).collect()}
    for i in range(0, 90, 3):
        best = sorted((j for j in range(90) if j != i), key=lambda j: (-sum(a * b for a, b in zip(rows[i][1], rows[j][1], strict=True)), j))[:4]
        assert [got[i, n] for n in range(1, 5)] == best


def test_frequent_needles_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(K, "OFTEN", 3)
    reports = [(f"r{i:03d}", "stock" if i % 3 else "industry", f"P{i % 2} note", f"C{i % 20:02d}", "") for i in range(60)]
    asked = [(q, f"C{q:02d} P{q % 2} 行业" if q % 2 else f"C{q:02d} P0", [f"C{q:02d}"] if q % 3 else None, [f"P{q % 2}"]) for q in range(12)]
    out = K.metadata_scores(spark.createDataFrame(asked, "question_id long, text string, companies array<string>, topics array<string>"), spark.createDataFrame(reports, "report_id string, kind string, title string, company string, organization string"), 4)
    want = set()
    for q, text, companies, topics in asked:
        scores = []
        for r, kind, title, company, _ in reports:
            held = f"{title} {company}"
            s = sum(3 for c in companies or [] if c in held) + sum(2 for t in topics if t in held) + sum(0.2 for w in text.split() if w in held)
            s += (kind == "industry" and "行业" in text) - 2.5 * (kind == "stock" and bool(companies) and not any(c in held for c in companies or []))
            scores += [(-round(s, 6), r)] if round(s, 6) > 0 else []
        want |= {(q, r, n) for n, (_, r) in enumerate(sorted(scores)[:4], 1)}
    assert {(x["question_id"], x["report_id"], x["rank"]) for x in out.collect()} == want


def test_copies_do_not_swell_what_leaves_a_cell():
    ids = np.arange(5_000)[::-1].copy()
    score = np.zeros((3, 5_000))
    score[1, 7], score[2] = 2.0, np.arange(5_000) / 100  # all equal; one above equal ones; all different
    i, j = K._candidates(score, ids, 10)
    got = [sorted(ids[j[i == r]].tolist()) for r in range(3)]
    assert got[0] == list(range(10))
    assert got[1] == [*range(10), int(ids[7])]
    assert got[2] == list(range(10))  # the largest scores have the smallest ids
    assert [x.size for x in K._candidates(np.full((2, 3), -np.inf), ids[:3], 10)] == [0, 0]


def test_all_hits_of_copies_are_those_with_the_smallest_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(300, [2.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in K.exact_top_k(vectors, vectors.where("vec_id in (1, 300)"), 3, block=1, stripes=3).collect()}
    assert got == {(1, 1): 300, (1, 2): 0, (1, 3): 2, (300, 1): 0, (300, 2): 1, (300, 3): 2}
