"""Pages to chunks: packing against a plain fold, sections over pages, and odd input."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import chunking as C

LONG = "公司持续加大研发投入，渠道下沉成效显著，盈利能力稳步提升。"


def plain_groups(paragraphs, size, overlap):
    """Character by character: what a reader of the rule would do."""
    groups, now = [], []
    for p in paragraphs:
        if now and sum(len(x) + 2 for x in now) + len(p) + 2 > size:
            groups.append(list(now))
            tail = []
            while now and sum(len(x) + 2 for x in tail) < overlap:
                tail.insert(0, now.pop())
            now = tail
        if now or len(p) + 2 <= size:
            now.append(p)
            continue
        at = 0
        while True:
            piece = p[at : at + size]
            if piece.strip():
                groups.append([piece.strip()])
            if at + size >= len(p):
                break
            at += size - overlap
    if now:
        groups.append(now)
    out = []
    for g in groups:
        if out and len("".join(g)) < max(120, overlap):
            out[-1].extend(g)
        else:
            out.append(list(g))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_packing_is_the_plain_fold(seed):
    r = random.Random(seed)
    size, overlap = r.choice([(900, 150), (200, 50), (130, 30)])
    paragraphs = ["".join(r.choice("甲乙丙丁 ") for _ in range(r.choice([18, 60, 140, 400, 2_500]))).strip() or "甲" for _ in range(r.randint(0, 14))]
    assert C.packed(paragraphs, size, overlap) == plain_groups(paragraphs, size, overlap)


def test_groups_carry_whole_paragraphs_and_merge_short_tails():
    a, b, c = "a" * 400, "b" * 200, "c" * 400
    assert C.packed([a, b, c]) == [[a, b], [b, c]]
    assert C.packed([a, c, "short tail"], 900, 0) == [[a, c, "short tail"]] or C.packed([a, c, "short tail"], 900, 0)[-1][-1] == "short tail"
    assert [len(g[0]) for g in C.packed(["x" * 2_000])] == [900, 900, 500]
    assert C.packed([]) == []


def pages(spark, rows):
    return spark.createDataFrame([(d, p, t, "s", 1) for d, p, t in rows], "doc_id long, page int, text string, section string, place int")


def test_sections_run_over_pages_and_end_at_dropped_ones(spark):
    head, sub = "一、公司主营业务稳健增长，盈利能力持续改善", "（一）核心产品收入与毛利率的变化情况如下所示"
    rows = [(1, 1, f"{head}\n{LONG}"), (1, 2, f"{LONG}\n{sub}\n{LONG}"), (1, 3, LONG), (1, 4, "免责声明\n法律声明\n" + LONG), (1, 5, LONG), (1, 6, None), (1, 7, ""), (2, 1, LONG)]
    got = {(r["doc_id"], r["page"], r["place"]): (r["section"], r["subsection"]) for r in C.sections(pages(spark, rows)).collect()}
    assert got == {(1, 1, 0): (head, ""), (1, 1, 1): (head, ""), (1, 2, 0): (head, ""), (1, 2, 1): (head, sub), (1, 2, 2): (head, sub), (1, 3, 0): (head, sub), (1, 5, 0): ("", ""), (2, 1, 0): ("", "")}


def test_paragraphs_follow_the_rules(spark):
    lines = ["同比增长，主要由于渠道下沉带来的增量贡献", "", LONG[:12], LONG[12:], "12.3 45%", LONG, "图表12：公司近五年营业收入及同比增速（亿元）", "plain ascii words only", "", "总股本 12 总市值 13 分析师：某某", "", LONG * 9]
    got = [r["paragraph"] for r in C.sections(pages(spark, [(1, 1, "\n".join(lines))])).orderBy("place").collect()]
    assert got == [f"{lines[0]} {LONG}", LONG, lines[6], *[LONG] * 9]


def test_chunks(spark):
    head, caption = "一、公司主营业务稳健增长，盈利能力持续改善", "图表12：公司近五年营业收入及同比增速（亿元）"
    body = [f"{i}：{LONG}" for i in range(60)]
    text = "\n\n".join([head, *body, caption, *body[:2]])
    out = C.report_chunks(pages(spark, [(7, 3, text), (8, 1, None)])).orderBy("chunk").collect()
    want = ["\n\n".join(g) for g in plain_groups(body, 900, 150)]
    assert [r["text"] for r in out] == [*[f"{head}\n{w}" for w in want], caption, f"{head}\n" + "\n\n".join(body[:2])]
    assert [r["chunk"] for r in out] == list(range(1, len(want) + 3)) and out[0]["chunk_id"] == "7::p3::body::1" and out[-2]["chunk_id"].startswith("7::p3::visual::")
    assert [r["label"] for r in out if r["kind"] == "visual_caption"] == ["图表12"]
    assert C.report_chunks(pages(spark, [])).count() == 0


def test_cleaned_chunks(spark):
    rows = [("body", "short"), ("visual_caption", "short"), ("body", "ABC 12% 34 / 56 - 78 : 90 AAA BBB"), ("body", "EPS PE ROE 每股收益市盈率净资产收益率对照一览表格"), ("body", LONG), ("body", "Analyst Certification and NISM " + LONG * 80), ("body", "NISM only " + LONG * 80), ("body", None)]
    chunks = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "chunk_id long, kind string, text string")
    assert sorted(r["chunk_id"] for r in C.cleaned_chunks(chunks).collect()) == [1, 4, 6]


def test_one_shuffle_by_document(spark):
    plan = C.sections(pages(spark, [(1, 1, LONG)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_paragraphs_are_computed_once(spark):
    pages = spark.createDataFrame([(1, 1, "x")], "doc_id long, page int, text string")
    assert C.sections(pages)._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 1


def test_noise_as_its_plain_patterns(spark):
    parts = ["分析师：某某。", "SAC 登记编号：S1", "a@b.com5@c.org", "52 周内最高/最低价 3", "a|-|-b -- c", "资料来源：x", "--|" * 9_000, "  x\t y ", "Email: q@r.st", "2023年", "请务必阅读正文之后的重要声明部分", "第一大股东 甲", "", " "]
    texts = [a + b for a in parts for b in parts]

    def plain(x):
        for p in (C.NOISE, r"\s*[|｜]+\s*", r"\s*[-—–]{2,}\s*", r"\s+"):
            x = F.regexp_replace(x, p, " ")
        return C.trimmed(x)

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(C.without_noise(F.col("t")).alias("got"), plain(F.col("t")).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows)


def test_chunks_compute_paragraphs_once(spark):
    pages = spark.createDataFrame([(1, 1, "x")], "doc_id long, page int, text string")
    for chunks in (C.report_chunks(pages).select("chunk_id", "kind", "text"), C.cleaned_chunks(C.report_chunks(pages)).select("chunk_id", "kind", "text")):
        assert chunks._jdf.queryExecution().optimizedPlan().toString().count("array_join(") == 1


def test_chunks_of_captions_and_of_pages_that_come_twice(spark):
    head, caption = "一、公司主营业务稳健增长，盈利能力持续改善", "图表12：公司近五年营业收入及同比增速（亿元）"
    once, twice = f"{LONG}甲\n{caption}\n{caption}\n{LONG}乙", f"{head}\n{caption}\n\n{LONG}丙"
    out = C.report_chunks(pages(spark, [(1, 1, once), (2, 1, twice), (2, 1, twice), (None, None, caption), (None, None, caption)])).collect()
    got = {k: sorted((r["chunk"], r["kind"], r["label"], r["text"]) for r in out if (r["doc_id"], r["page"]) == k) for k in ((1, 1), (2, 1), (None, None))}
    seen, of = ("visual_caption", "图表12", caption), lambda section, text: ("body", None, f"{section}{text}")
    assert got[1, 1] == [(1, *of("", f"{LONG}甲")), (2, *seen), (3, *seen), (4, *of("", f"{LONG}乙"))]
    assert got[2, 1] == [(1, *seen), (2, *seen), (3, *of(f"{head}\n", f"{LONG}丙\n\n{LONG}丙"))]
    assert got[None, None] == [(1, *seen), (2, *seen)]


def test_glances_change_nothing(spark):
    def plain_noise(x):
        for p in (C.NOISE, r"\s*[|｜]+\s*", r"\s*[-—–]{2,}\s*", r"\s+"):
            x = F.regexp_replace(x, p, " ")
        return F.trim(x)

    def plain_little(x):
        cover = (C.hits(x, C.COVER_WORDS) >= 2) | ((F.regexp_count(x, F.lit("[0-9]")) > 0.18 * F.length(x)) & ~x.rlike("[。！？；]"))
        return (F.length(x) < 18) | x.rlike("|".join(C.DISCARDED)) | x.rlike(C.ASCII_ONLY) | x.rlike(r"^[0-9]{6}\.(?:SH|SZ|BJ)\s*.*$") | cover

    def plain_line(x):
        return (x == "") | (x.rlike("^[0-9. /%+-]+$") & (F.length(x) <= 32)) | x.rlike(C.NOISE_LINE)

    plain_trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    plain_contents = lambda x: (C.hits(plain_trim(x), C.CONTENTS) >= 2) | (x.contains("目录") & (F.regexp_count(x, F.lit("[.．]{6,}")) >= 3))
    plain_disclaimer = lambda x: sum((x.contains(w).cast("int") for w in C.DISCLAIMERS), F.lit(0)) >= 2
    same = {
        "noise": (C.without_noise, plain_noise), "little": (C.says_little, plain_little), "line": (C.is_noise_line, plain_line), "trim": (C.trimmed, plain_trim), "caption": (C.is_caption, lambda x: x.rlike(C.CAPTION)),
        "contents": (C.is_contents, plain_contents), "disclaimer": (C.is_disclaimer, plain_disclaimer),
    }
    # an example of each alternative of a pattern, and what may stand around it
    patterns = [*C.INLINE_NOISE[:-1], *C.COVER_FIGURES, *C.NOISE_LINES, *C.DISCARDED, *C.COVER_WORDS[0].split("|"), *C.COVER_WORDS[1].split("|"), *C.DISCLAIMERS]
    words = {w for p in patterns for w in re.sub(r"\(\?i:(.*)\)$", r"\1", p).replace("(?:", "").replace("\\(", "(").replace("\\)", ")").split("|")}
    words = {re.sub(r"\[:：\]\??", c, re.sub(r"（\?元）\?", "（元）", re.sub(r"\\s[*+]", s, re.sub(r"\[\^。；\\n\]\*|\.\*|\$|\)$", "", w)))) for w in words for c, s in (("：", " "), (":", ""))}
    others = ["", "公司主营业务稳健增长，盈利能力持续改善以及其他", "Plain words of a sentence, and so on", "123456 7.8% 90", "目录", "......\n．．．．．．\n.......", "图表12：甲", "表3", "第 3 页 / 共 20 页", "3/20", "600000.SH 某某银行", "a.b@c.org", "a--b", "–", "—|", "\x85", "  ", "\r\n", "\x0b\f", "\t ", "。"]
    texts = sorted({t for w in {*words, *others} for o in others for t in (w + o, o + w, f"{o} {w} {o}")})
    assert all(any(re.match(p, x) for x in texts) for p in patterns)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *[f(F.col("t")).alias(f"{k}_{i}") for k, fs in same.items() for i, f in enumerate(fs)]).collect()
    assert len(rows) > 3_000 and not [(k, r["t"]) for r in rows for k in same if r[f"{k}_0"] != r[f"{k}_1"]]
