"""Registered queries of report pages, sections and chunks (K-2 to K-8, K-10, K-11, K-13), with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking as C

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}

#: Lines that are dealt over the pages: headings of all levels, captions, noise, covers, sentences that go on, and whole ones.
LINES = (
    "一、公司主营业务稳健增长，盈利能力持续改善", "（一）核心产品收入与毛利率的变化情况如下所示", "1.2 渠道拓展情况与未来三年的销售网络规划", "1.2.1 分地区收入结构及其占比的变化情况说明", "图表12：公司近五年营业收入及同比增速（亿元）", "表 3 分产品收入预测",
    "请务必阅读正文之后的重要声明部分", "资料来源：公司公告，研究所整理", "第 3 页 / 共 20 页", "12.5 13.6 14.7%", "分析师：某某 SAC登记编号：S0000000000000", "总股本/流通股本（亿股） 12.3 / 11.9 第一大股东 某某集团", "总市值 123.4 流通市值 120.1 分析师：某某",
    "同比增长12.5%，主要由于渠道下沉带来的增量，", "3.5%，较去年同期提升0.4个百分点。", "公司在2023年实现营业总收入123.45亿元，同比增长8.9%；归属于上市公司股东的净利润12.3亿元，同比增长10.1%。", "风险提示", "风险提示：原材料价格波动，行业竞争加剧，新品推广不及预期",
    "本研究报告仅供本公司的客户使用，本公司不会因接收人收到本报告而视其为客户。", "我们预计公司未来三年收入保持两位数增长，维持买入评级 | 盈利预测 —— 见下表 contact@broker.example.com 。", "000001.SZ 某某银行 2023 年三季报", "投资要点：渠道与品牌双轮驱动，龙头地位稳固",
    "公司持续加大研发投入，研发费用率由3.1%提升至4.2%，在研管线推进顺利；海外业务拓展至三十余个国家和地区，境外收入占比提升。渠道方面，公司深化与连锁终端的合作，下沉市场覆盖率提升至七成以上，终端动销良好。产能方面，新基地按期投产，自动化水平显著提高，单位成本下降。我们认为，随着规模效应释放，公司盈利能力仍有提升空间。风险方面，需关注原材料价格与集采政策的变化，以及新品上市进度不及预期的可能；上述因素可能对业绩造成阶段性影响。",
)
CONTENTS_PAGE = "目录\n一、公司概况......1\n二、行业分析......5\n三、盈利预测......9"
DISCLAIMER_PAGE = "免责声明\n本公司不对因使用本报告而产生的损失负责。\n法律声明\n版权所有。"


def report_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page, text: five documents are the pages of a report; a fifth of their lines come after one of LINES. Some first pages are of contents, some last ones disclaimers."""
    lines = F.array(*[F.lit(x) for x in LINES])
    own = lambda i: F.element_at(lines, ((F.col("doc_id") + i) % len(LINES) + 1).cast("int"))
    dealt = lambda x, i: F.when((F.col("doc_id") * 31 + i * 7) % 5 == 0, F.array(own(i), x)).otherwise(F.array(x))
    body = F.array_join(F.flatten(F.transform(F.split("text", "\n"), dealt)), "\n")
    text = F.when(F.col("doc_id") % 35 == 0, CONTENTS_PAGE).when(F.col("doc_id") % 45 == 44, DISCLAIMER_PAGE).otherwise(body)
    return docs.select("doc_id", text.alias("text")).select(F.floor(F.col("doc_id") / 5).alias("doc_id"), (F.col("doc_id") % 5 + 1).cast("int").alias("page"), "text")


_q = lambda x: "'" + x.replace("'", "''") + "'"
_m = lambda x, p: f"regexp_matches({x}, {_q(p)})"
_n = lambda x, ps: "(" + " + ".join(f"{_m(x, p)}::INT" for p in ps) + ")"


def _sub(x: str, pattern: str, to: str = "' '") -> str:
    return f"regexp_replace({x}, {_q(pattern)}, {to}, 'g')"


def _bare(x: str) -> str:
    for p in (C.NOISE, r"\s*[|｜]+\s*", r"\s*[-—–]{2,}\s*", r"\s+"):
        x = _sub(x, p)
    return _sub(x, r"^\s+|\s+$", "''")


def _level(x: str) -> str:
    no = " OR ".join(_m(x, p) for p in (C.CAPTION, r"^[0-9./ %+\-]+$", r"^[0-9]{6}\.(?:SH|SZ|BJ)$")) + f" OR {x} = ''"
    numbered = " ".join(f"WHEN {_m(x, p)} THEN {n}" for p, n in C.NUMBERED)
    return f"CASE WHEN {x} IN ({', '.join(map(_q, C.PLAIN_HEADINGS))}) THEN 1 WHEN length({x}) > 40 OR {no} THEN NULL {numbered} WHEN length({x}) <= 36 AND contains({x}, '：') AND NOT {_m(x, '[。！？；]$')} THEN 1 END"


def _little(x: str) -> str:
    cover = f"{_n(x, C.COVER_WORDS)} >= 2 OR (length({_sub(x, '[^0-9]', chr(39) * 2)}) > 0.18 * length({x}) AND NOT {_m(x, '[。！？；]')})"
    return f"length({x}) < 18 OR {_m(x, '|'.join(C.DISCARDED))} OR {_m(x, C.ASCII_ONLY)} OR " + _m(x, r"^[0-9]{6}\.(?:SH|SZ|BJ)\s*.*$") + f" OR {cover}"


_lines = "[" + ", ".join(map(_q, LINES)) + "]"
_e = lambda x: x.replace("'", "''").replace("\n", "' || chr(10) || '")
PAGES = f"""pages AS (SELECT doc_id // 5 AS doc_id, (doc_id % 5 + 1)::INT AS page, CASE WHEN doc_id % 35 = 0 THEN '{_e(CONTENTS_PAGE)}' WHEN doc_id % 45 = 44 THEN '{_e(DISCLAIMER_PAGE)}'
    ELSE array_to_string(flatten(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (doc_id * 31 + (i - 1) * 7) % 5 = 0 THEN [{_lines}[(doc_id + i - 1) % {len(LINES)} + 1], x] ELSE [x] END)), chr(10)) END AS text FROM documents),
classed AS (SELECT *, ({_n("trim(text)", C.CONTENTS)} >= 2 OR (contains(text, '目录') AND len(regexp_extract_all(text, '[.．]{{6,}}')) >= 3)) OR {_n("text", C.DISCLAIMERS)} >= 2 AS dropped FROM pages)"""
_clean = r"regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
PARAGRAPHS = (
    PAGES
    + f""", bare AS (SELECT doc_id, page, list_transform(string_split(replace({_clean}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: {_bare("x")}) AS ls FROM classed WHERE NOT dropped),
marked AS (SELECT doc_id, page, string_split(array_to_string(list_transform(ls, lambda x: CASE WHEN x = '' OR ({_m("x", "^[0-9. /%+-]+$")} AND length(x) <= 32) OR {_m("x", C.NOISE_LINE)} THEN chr(1) WHEN {_m("x", C.CAPTION)} OR ({_level("x")}) IS NOT NULL THEN chr(1) || chr(2) || x || chr(1) ELSE x END), ''), chr(1)) AS ps FROM bare),
joined AS (SELECT doc_id, page, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM marked),
whole AS (SELECT doc_id, page, i, p[1] = chr(2) AS alone, CASE WHEN p[1] = chr(2) THEN p[2:] ELSE {_bare("p")} END AS p FROM joined WHERE p <> ''),
cut AS (SELECT doc_id, page, i, CASE WHEN alone OR length(p) < {C.DENSE} THEN [p] ELSE list_transform(string_split({_sub("p", "([。！？；])", chr(39) + chr(92) + "1" + chr(39) + " || chr(1)")}, chr(1)), lambda s: {_sub("s", r"^\s+|\s+$", "''")}) END AS parts FROM whole),
parts AS (SELECT doc_id, page, i, unnest(parts) AS p, generate_subscripts(parts, 1) AS j FROM cut),
told AS (SELECT *, {_bare("p")} AS b FROM parts WHERE p <> ''),
kept AS (SELECT doc_id, page, p, row_number() OVER w AS r, lag(p) OVER w AS before, count(*) OVER (PARTITION BY doc_id, page) AS n FROM told WHERE NOT ({_little("b")}) WINDOW w AS (PARTITION BY doc_id, page ORDER BY i, j)),
goes AS (SELECT *, bool_or(r = 1 AND n >= 2 AND length(p) <= 120 AND {_m("p", "|".join(f"(?:{x})" for x in C.CONTINUED))}) OVER (PARTITION BY doc_id, page) AS merge FROM kept),
paragraphs AS (SELECT doc_id, page, (r - 1 - merge::INT)::INT AS place, CASE WHEN merge AND r = 2 THEN before || ' ' || p ELSE p END AS paragraph FROM goes WHERE NOT (merge AND r = 1))"""
)
_topic = f"(length(paragraph) <= 48 AND NOT {_m('paragraph', '[。！？；]')} AND NOT " + _m("paragraph", r"^[0-9A-Za-z ./%+\-]+$") + " AND " + _m("paragraph", r"^[一二三四五六七八九十0-9A-Za-z（）().、\-—\s]*[:：]") + ")"
SECTIONS = (
    PARAGRAPHS
    + f""", marks AS (SELECT *, {_level("paragraph")} AS level, {_m("paragraph", C.CAPTION)} AS caption, false AS dropped FROM paragraphs UNION ALL SELECT doc_id, page, 0, '', NULL, false, true FROM classed WHERE dropped),
events AS (SELECT *, CASE WHEN dropped THEN '' WHEN level = 1 OR (place = 0 AND (level IS NOT NULL OR {_topic})) THEN paragraph END AS s, CASE WHEN dropped THEN '' WHEN level >= 2 THEN paragraph WHEN level = 1 OR (place = 0 AND {_topic}) THEN '' END AS t FROM marks),
sections AS (SELECT doc_id, page, place, paragraph, level, caption, coalesce(last_value(s IGNORE NULLS) OVER w, '') AS section, coalesce(last_value(t IGNORE NULLS) OVER w, '') AS subsection, dropped FROM events WINDOW w AS (PARTITION BY doc_id ORDER BY page, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return report_pages(spark.read.parquet(f"{d}/documents.parquet"))


_md5 = lambda c: F.md5(F.col(c).cast("binary"))
Q["k2_k3_report_pages"] = lambda spark, d: _pages(spark, d).select("doc_id", "page", C.is_contents(F.col("text")).alias("contents"), C.is_disclaimer(F.col("text")).alias("disclaimer"), F.md5(F.array_join(F.transform(F.split("text", "\n"), C.without_noise), "\n").cast("binary")).alias("clean"))
O["k2_k3_report_pages"] = f"WITH {PAGES} SELECT doc_id, page, {_n('trim(text)', C.CONTENTS)} >= 2 OR (contains(text, '目录') AND len(regexp_extract_all(text, '[.．]{{6,}}')) >= 3) AS contents, {_n('text', C.DISCLAIMERS)} >= 2 AS disclaimer, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: {_bare('x')}), chr(10))) AS clean FROM classed"
Q["k4_k7_paragraphs"] = lambda spark, d: C.sections(_pages(spark, d)).select("doc_id", "page", "place", _md5("paragraph").alias("paragraph"))
O["k4_k7_paragraphs"] = f"WITH {PARAGRAPHS} SELECT doc_id, page, place, md5(paragraph) AS paragraph FROM paragraphs"
Q["k5_k10_sections"] = lambda spark, d: C.sections(_pages(spark, d)).select("doc_id", "page", "place", "level", "caption", "section", "subsection")
O["k5_k10_sections"] = f"WITH {SECTIONS} SELECT doc_id, page, place, level, caption, section, subsection FROM sections WHERE NOT dropped"
#: Packing is a fold: tests hold it against a plain version.
Q["k8_k11_report_chunks"] = lambda spark, d: C.report_chunks(_pages(spark, d)).select("chunk_id", "kind", "section", "subsection", "label", F.length("text").alias("n"), _md5("text").alias("digest"))
Q["k13_cleaned_chunks"] = lambda spark, d: C.cleaned_chunks(C.report_chunks(_pages(spark, d))).select("chunk_id", "kind", _md5("text").alias("digest"))
