"""Registered queries of the A, B, C, K and L families, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cells as C
from ..operators import evidence as E
from ..operators import periods as D
from ..operators import retrieval as K
from ..sources import tables as A
from ..sources.statements import KEY
from .statement_queries import COST, ORACLE_BASE, REV, sheets

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _on(name: str, table: str, f: Callable[[DataFrame], DataFrame], sql: str | None) -> None:
    Q[name] = lambda spark, d: f(_table(spark, d, table))
    if sql:
        O[name] = sql


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Raw cells of the income sheet (FIXTURES.md F-3): code, period, label, text."""
    x = sheets(spark, d)["income"].where(f"{REV} is not null")
    n = T.cents(F.col("net_profit"))
    k = (F.col("stock_code").cast("int") + F.col("report_year")) % 5
    t = n.cast("string")
    size = F.abs(n).cast("string")
    txt = F.when(k == 0, t).when(k == 1, F.concat(F.lit("1,"), F.lpad(size, 6, "0"))).when(k == 2, F.concat(F.lit("（"), size, F.lit("）"))).when(k == 3, F.concat(t, F.lit("亿元"))).otherwise(F.concat(t, F.lit("%")))
    return x.select("stock_code", "report_period", F.lit(" 营业 收入（万元）").alias("label"), txt.alias("txt"))


CELLS = (
    ORACLE_BASE
    + f""", s AS (SELECT *, net_profit::DECIMAL(18,2) AS n, (stock_code::INT + report_year) % 5 AS k FROM income WHERE {REV} IS NOT NULL),
cells AS (SELECT stock_code, report_period, k, n, CASE k WHEN 0 THEN n::VARCHAR WHEN 1 THEN '1,' || lpad(abs(n)::VARCHAR, 6, '0') WHEN 2 THEN '（' || abs(n)::VARCHAR || '）' WHEN 3 THEN n::VARCHAR || '亿元' ELSE n::VARCHAR || '%' END AS txt FROM s)"""
)


def _cells(name: str, cols: Callable[[], list], sql: str) -> None:
    Q[name] = lambda spark, d: cells(spark, d).select("stock_code", "report_period", *cols())
    O[name] = f"WITH {CELLS} SELECT stock_code, report_period, {sql} FROM cells"


_num = "CASE k WHEN 0 THEN n::DOUBLE WHEN 1 THEN replace(txt, ',', '')::DOUBLE WHEN 2 THEN -abs(n)::DOUBLE ELSE n::DOUBLE END"
_cells("b1_b3_labels_units", lambda: [T.clean_label(F.col("label")).alias("label"), T.amount_unit(F.col("txt")).alias("amount_unit"), T.unit(F.col("txt")).alias("unit")], "'营业收入(万元)' AS label, CASE WHEN k = 3 THEN '亿元' END AS amount_unit, CASE k WHEN 3 THEN '亿元' WHEN 4 THEN '%' END AS unit")
_cells("b5_plain_number", lambda: ["txt", T.plain_number(F.col("txt")).alias("value")], f"txt, {_num} AS value")
_cells("b4_number", lambda: [F.round(T.number(F.col("txt"), F.lit("元")), 6).alias("value")], f"round(CASE k WHEN 3 THEN n::DOUBLE * 10000 WHEN 4 THEN n::DOUBLE ELSE ({_num}) * 0.0001 END, 6) AS value")
_cells("b6_number_for_field", lambda: [T.for_field(F.lit("eps"), F.col("txt"), F.lit("元")).alias("eps"), F.round(T.for_field(F.lit("net_profit"), F.col("txt"), F.lit("万元")), 6).alias("net_profit")], f"{_num} AS eps, round(CASE k WHEN 3 THEN n::DOUBLE * 10000 ELSE {_num} END, 6) AS net_profit")
_cells("b7_b23_periods", lambda: [T.report_period(F.substring("report_period", 1, 4), F.lit("第三季度报告")).alias("third"), T.period_text(F.col("report_period")).alias("label"), K.period_end(F.col("report_period")).alias("end")], "report_period[1:4] || 'Q3' AS third, report_period[1:4] || CASE report_period[5:6] WHEN 'Q1' THEN '年第一季度' WHEN 'H1' THEN '年上半年' WHEN 'Q3' THEN '年第三季度' ELSE '年度' END AS label, report_period[1:4] || CASE report_period[5:6] WHEN 'Q1' THEN '0331' WHEN 'H1' THEN '0630' WHEN 'Q3' THEN '0930' ELSE '1231' END AS end")
_cells("b10_b13_codes_keys", lambda: [T.stock_code(F.concat(F.lit("SZ"), F.col("stock_code"), F.lit(".x"))).alias("code"), T.scalar(F.lit(" 12.00 ")).alias("scalar"), T.metadata_key(F.col("stock_code"), F.lit(None).cast("string"), F.col("report_period")).alias("key"), T.without_prefix(F.lit("（一）1、营业收入")).alias("label")], "stock_code AS code, '12' AS scalar, stock_code || '::::' || report_period AS key, '营业收入' AS label")
_toks = lambda: T.split_numbers(F.concat(F.lit("净利润 2023 "), F.col("txt"), F.lit(" 12.5% 7")))
_cells("b14_b20_tokens", lambda: [_toks()["label"].alias("label"), F.array_join(T.without_references(_toks()["numbers"]), "|").alias("tokens"), T.nth_number(F.array(F.lit("x"), F.lit("-"), F.lit("3.5")), 0).alias("first"), F.array_join(T.merged_signs(F.array(F.lit("a"), F.lit("-"), F.lit("5"))), "|").alias("signs"), T.third_quarter_value(F.array(F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"))).alias("third"), T.is_note_marker(F.array(F.lit("7"))).alias("note")], "trim(regexp_replace('净利润 2023 ' || txt || ' 12.5% 7', '[-+]?\\(?[0-9][0-9,]*(?:\\.[0-9]+)?\\)?%?', '', 'g')) AS label, array_to_string(regexp_extract_all('净利润 2023 ' || txt || ' 12.5% 7', '[-+]?\\(?[0-9][0-9,]*(?:\\.[0-9]+)?\\)?%?')[2:5], '|') AS tokens, 3.5::DOUBLE AS first, 'a|-5' AS signs, 3.0::DOUBLE AS third, true AS note")
_cells("b22_formats", lambda: [T.amount_text(T.plain_number(F.col("txt")) * 100_000).alias("amount"), T.ratio_text(F.lit(12.345)).alias("ratio")], f"CASE WHEN abs(({_num}) * 100000) >= 10000 THEN format('{{:.2f}}亿元', ({_num}) * 100000 / 10000) ELSE format('{{:.2f}}万元', ({_num}) * 100000) END AS amount, '12.35%' AS ratio")

_on("k1_clean_page", "documents", lambda d: d.select("doc_id", F.md5(T.clean_page(F.col("text")).cast("binary")).alias("clean")), r"SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS clean FROM documents")
#: Paragraphs of informative text and their windows; \n before # and blank lines part them.
_sqlchunks = r"""WITH c AS (SELECT doc_id, length(text) > 60 AS long, source, lang, string_split(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '\n\s*\n', chr(1), 'g'), chr(10) || '#', chr(1) || '#'), chr(1)) AS ps FROM documents),
p AS (SELECT doc_id, long, list_filter(list_transform(ps, lambda x: trim(regexp_replace(x, '\s*\n\s*', ' ', 'g'), ' ')), lambda x: length(x) >= 18 AND length(regexp_replace(x, '[^0-9]', '', 'g')) <= 0.18 * length(x)) AS ps FROM c),
b AS (SELECT doc_id, long, array_to_string(ps, chr(10)) AS body FROM p WHERE len(ps) > 0)"""
_on("k6_dense_sentences", "documents", lambda d: d.select("doc_id", F.size(T.dense_sentences(F.col("text"))).alias("n_sentences")), r"SELECT doc_id, len(list_filter(CASE WHEN length(text) >= 220 THEN list_transform(string_split(regexp_replace(text, '([。！？；.!?])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')) ELSE [text] END, lambda s: s <> '' OR length(text) < 220))::INT AS n_sentences FROM documents")
_on("k7_k10_chunks", "documents", lambda d: K.chunks(d).select("chunk_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest")), _sqlchunks + ", w AS (SELECT doc_id, unnest(range(0, greatest(ceil((length(body) - 900) / 750.0), 0)::INT + 1)) AS i, body FROM b) SELECT doc_id || '-' || i AS chunk_id, length(substr(body, i * 750 + 1, 900))::INT AS n, md5(substr(body, i * 750 + 1, 900)) AS digest FROM w")
_on("k12_fallback_chunks", "documents", lambda d: K.fallback_chunks(d, K.chunks(d.where("length(text) > 60")).select("doc_id").distinct()), _sqlchunks + " SELECT doc_id, concat_ws('；', source, lang) AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM b WHERE long)")
_on("k9_windows", "documents", lambda d: d.select("doc_id", F.posexplode(T.windows(F.col("text"), 900, 150)).alias("chunk", "w")).select("doc_id", "chunk", F.md5(F.col("w").cast("binary")).alias("digest")), "WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 900) / 750.0), 0)::INT + 1))::INT AS chunk FROM documents) SELECT doc_id, chunk, md5(substr(text, chunk * 750 + 1, 900)) AS digest FROM s")
_on("k30_terms", "benchmark", lambda d: d.select("item_id", F.array_join(T.terms(F.col("text"), ["de", "la"]), " ").alias("terms")), "WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z]{2,}') AS w FROM benchmark), u AS (SELECT item_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), m AS (SELECT item_id, x, min(i) AS i FROM u WHERE x NOT IN ('de', 'la') GROUP BY ALL) SELECT item_id, coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM m WHERE m.item_id = t.item_id), '') AS terms FROM t")
_hits = lambda e, k=50: K.exact_top_k(e, e.where("vec_id % 20 = 0"), k)
_once = lambda f: lambda e: f(A.stored(_hits(e)))  # noqa: E731  # for what reads the hits several times
_sqlhits = "WITH h AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM h QUALIFY rank <= 50)"
_on("k15_normalized", "embeddings", lambda e: e.select("vec_id", F.round(K.dot(K.normalized(F.col("embedding")), K.normalized(F.col("embedding"))), 6).alias("norm")), "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings")
_on("k16_exact_top_k", "embeddings", _hits, _sqlhits + " SELECT query_id, vec_id, label, score, rank FROM r")
_on("k17_scoped_hits", "embeddings", lambda e: K.scoped(_hits(e), F.col("label") % 2 == 0, F.col("label") == 4, F.col("label") < 3).select("query_id", "vec_id", "score"), _sqlhits + " SELECT query_id, vec_id, round(score + CASE WHEN label = 4 THEN 0.05 ELSE 0.0 END + CASE WHEN label < 3 THEN 0.03 ELSE 0.0 END, 6) AS score FROM r WHERE label % 2 = 0")
_on("k21_fused", "embeddings", _once(lambda h: K.fused(h.where("label < 6").select("query_id", F.col("vec_id").alias("hit"), F.lit(0.5).alias("score")), h.where("label > 3").select("query_id", F.col("vec_id").alias("hit"), "score"))), _sqlhits + " SELECT query_id, vec_id AS hit, CASE WHEN label < 6 THEN 0.5 ELSE 0.0 END::DOUBLE AS metadata, CASE WHEN label > 3 THEN score ELSE 0.0 END AS vector, round(CASE WHEN label < 6 THEN 0.5 ELSE 0.0 END::DOUBLE + CASE WHEN label > 3 THEN score ELSE 0.0 END, 6) AS score FROM r")
_on("k22_balanced", "embeddings", lambda e: K.balanced(_hits(e).withColumn("kind", F.col("label") % 2), "kind", 8).select("query_id", "vec_id", "kind", "place"), _sqlhits + ", o AS (SELECT *, label % 2 AS kind, row_number() OVER (PARTITION BY query_id, label % 2 ORDER BY score DESC, vec_id) AS own FROM r) SELECT query_id, vec_id, kind, row_number() OVER (PARTITION BY query_id ORDER BY (kind = 1 AND own > 4), own, kind, score DESC, vec_id)::INT AS place FROM o QUALIFY place <= 8")
_on("e13_source_counts", "embeddings", lambda e: K.source_counts(_hits(e), "label"), _sqlhits + " SELECT label, count(*) AS hits FROM r GROUP BY 1")
_on("a11_cumulative_questions", "conversations", K.cumulative_text, "SELECT conv_id, turn, string_agg(text, ' | ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM conversations WHERE role = 'user'")
_on("a13_status_summary", "conversations", lambda d: K.status_summary(d, "role"), "SELECT role, count(*) AS n FROM conversations GROUP BY 1")
_on("a14_round_robin", "documents", lambda d: K.round_robin(d.select(F.col("doc_id").alias("id"), "lang", "source"), "lang", "source", 10), "WITH o AS (SELECT lang, source, min(doc_id) AS id FROM documents GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source) AS turn FROM o) SELECT lang, source, id FROM t ORDER BY turn, lang LIMIT 10")
_on("a15_seeded_sample", "benchmark", lambda d: K.seeded_sample(d.select("item_id"), "item_id", 20, 7), "SELECT item_id FROM benchmark ORDER BY md5('7:' || item_id), item_id LIMIT 20")
_on("l9_carried_slots", "conversations", lambda d: K.carried(d.withColumn("slot", F.when(F.length("text") > 300, F.length("text"))), "conv_id", "turn", "slot").select("conv_id", "turn", "carried"), "SELECT conv_id, turn, last_value(CASE WHEN length(text) > 300 THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::INT AS carried FROM conversations")


def _follow_ups(d: DataFrame) -> DataFrame:
    """Turns of which a third refers back and a third asks for the same period of a year, some with periods and a period before."""
    said = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("这些公司"), "text")).when(F.col("turn") % 3 == 2, F.concat(F.lit("与2021年同期相比 "), "text")).otherwise(F.col("text"))
    own = F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("2022FY"), F.lit("2023Q1"), F.lit("2022FY"))).when(F.col("conv_id") % 3 == 1, F.array().cast("array<string>"))
    x = d.select("conv_id", "turn", said.alias("text"), F.when(F.length("text") > 300, F.length("text")).alias("slot"), own.alias("own"), F.when(F.col("conv_id") % 4 < 2, "2023H1").alias("before"))
    periods = F.array_join(K.same_period(F.col("text"), F.col("own"), F.col("before")), ",")
    return K.carried(x, "conv_id", "turn", "slot", K.refers_back(F.col("text"))).select("conv_id", "turn", "carried", periods.alias("periods"))


_on("l9_follow_ups", "conversations", _follow_ups, """WITH x AS (SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN length(text) END AS slot, turn % 3 = 2 AND conv_id % 4 < 2 AS same FROM conversations),
y AS (SELECT *, last_value(slot IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before FROM x)
SELECT conv_id, turn, CASE WHEN slot IS NOT NULL THEN slot WHEN turn % 3 = 1 THEN before END::INT AS carried,
    CASE WHEN same THEN CASE WHEN conv_id % 3 = 0 THEN '2022H1,2023Q1' ELSE '2021H1' END WHEN conv_id % 3 = 0 THEN '2022FY,2023Q1,2022FY' ELSE '' END AS periods FROM y""")


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions on the facts (FIXTURES.md F-5)."""
    x = sheets(spark, d)["income"].where("report_period like '%Q3'")
    y = F.col("report_year").cast("string")
    t = (F.col("stock_code").cast("int") + F.col("report_year")) % 3
    text = F.when(t == 0, F.concat("stock_abbr", y, F.lit("年第三季度的营业总收入是多少"))).when(t == 1, F.concat(y, F.lit("年前三季度净利润前十的公司有哪些"))).otherwise(F.concat(y, F.lit("年第三季度营业总收入超过12亿元的公司有哪些")))
    return x.select(F.concat_ws("-", "stock_code", "report_period").alias("question_id"), text.alias("text"))


_QUESTIONS = ORACLE_BASE + ", qs AS (SELECT concat_ws('-', stock_code, report_period) AS question_id, stock_code, report_year AS y, (stock_code::INT + report_year) % 3 AS t FROM income WHERE report_period LIKE '%Q3')"
Q["l1_companies"] = lambda spark, d: K.companies(questions(spark, d), sheets(spark, d)["income"].select("stock_code", "stock_abbr").distinct())
O["l1_companies"] = f"WITH {_QUESTIONS} SELECT question_id, stock_code AS companies FROM qs WHERE t = 0"
Q["l2_metrics"] = lambda spark, d: K.metrics(questions(spark, d), {"营业总收入": "total_operating_revenue", "净利润": "net_profit"})
O["l2_metrics"] = f"WITH {_QUESTIONS} SELECT question_id, CASE t WHEN 1 THEN 'net_profit' ELSE 'total_operating_revenue' END AS metrics FROM qs"
Q["l4_l8_slots"] = lambda spark, d: K.slots(questions(spark, d)).drop("periods")
O["l4_l8_slots"] = f"WITH {_QUESTIONS} SELECT question_id, concat(y, 'Q3') AS period, CASE WHEN t = 1 THEN 10 END AS top_n, CASE WHEN t = 2 THEN 120000.0 END::DOUBLE AS threshold, CASE t WHEN 0 THEN 'lookup' WHEN 1 THEN 'ranking' ELSE 'screen' END AS intent FROM qs"


def _missing(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    names = sheets(spark, d)["income"].select("stock_code", "stock_abbr").distinct()
    parsed = K.slots(q).join(K.metrics(q, {"营业总收入": "total_operating_revenue"}), "question_id").join(K.companies(q, names), "question_id", "left")
    return K.missing_slots(parsed)


Q["l10_missing_slots"] = _missing
O["l10_missing_slots"] = f"WITH {_QUESTIONS} SELECT question_id, CASE t WHEN 0 THEN '' WHEN 1 THEN 'companies,metrics' ELSE 'companies' END AS missing FROM qs"


def _files(spark: SparkSession, d: str) -> DataFrame:
    x = sheets(spark, d)["income"].where("report_period like '%Q3' or report_period like '%FY'")
    word = F.when(F.col("report_period").endswith("Q3"), "第三季度").otherwise("年度")
    x = x.withColumn("tag", F.explode(F.array(F.lit(""), F.lit("（更正后）"), F.lit("(1)"))))
    name = F.concat(F.col("stock_abbr"), F.lit("："), F.col("report_year").cast("string"), F.lit("年"), word, F.lit("报告"), F.col("tag"), F.lit(".pdf"))
    return K.parsed_titles(x.select(name.alias("name")))


Q["a3_a4_versions"] = lambda spark, d: K.best_version(_files(spark, d)).select("company", "year", "period", "corrected", "duplicate", "group_size", "selected")
O["a3_a4_versions"] = f"WITH {ORACLE_BASE} SELECT stock_abbr AS company, report_year AS year, report_period[5:6] AS period, tag = 1 AS corrected, tag = 2 AS duplicate, 3 AS group_size, tag = 1 AS selected FROM income, (VALUES (0), (1), (2)) AS t(tag) WHERE report_period LIKE '%Q3' OR report_period LIKE '%FY'"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    """Raw grids of two sheets: headings, labels split over two rows, numbers in several forms, blank rows that mean 0 and that don't, a breakdown."""
    n = lambda c: T.cents(F.col(c)).cast("string")
    none = F.lit(None).cast("string")
    grid = lambda rows: F.array(*[F.array(F.lit(label), none if value is None else value) for label, value in rows])
    income = [("一、营业", None), ("总收入", n(REV)), ("（二）净利润", n("net_profit")), ("归属于母公司的净利润", n("operating_expense_rnd_expenses")), ("销售费用", None), ("第一季度第二季度", None), ("净利润", F.lit("999999"))]
    balance = [("货币资金", n("net_profit")), ("（二）短期借款", None), ("（三）存货", None), ("应收账款", n(REV))]
    both = F.array(F.struct(F.lit("income").alias("sheet"), grid(income).alias("rows")), F.struct(F.lit("balance").alias("sheet"), grid(balance).alias("rows")))
    x = sheets(spark, d)["income"].where(f"{REV} is not null")
    x = x.select(F.concat_ws("-", "stock_code", "report_period").alias("record"), F.explode(both).alias("g"))
    return x.select("record", "g.sheet", F.posexplode("g.rows").alias("row_idx", "cells"))


Q["c1_c9_fields"] = lambda spark, d: C.fields_of(_grid(spark, d)).select("record", "field", "value", "row_idx")
O["c1_c9_fields"] = f"WITH {ORACLE_BASE}, x AS (SELECT concat_ws('-', stock_code, report_period) AS record, {REV}::DECIMAL(18,2)::DOUBLE AS r, operating_expense_rnd_expenses::DECIMAL(18,2)::DOUBLE AS p, net_profit::DECIMAL(18,2)::DOUBLE AS n FROM income WHERE {REV} IS NOT NULL), s AS (SELECT *, 100 + 3 + 6 + least(log10(abs(n) + 1), 12) AS a, 55 + 3 + 6 + least(log10(abs(p) + 1), 12) + 60 AS b FROM x) SELECT record, 'total_operating_revenue' AS field, r AS value, 1 AS row_idx FROM x UNION ALL SELECT record, 'net_profit', CASE WHEN round(a, 6) >= round(b, 6) THEN n ELSE p END, CASE WHEN round(a, 6) >= round(b, 6) THEN 2 ELSE 3 END FROM s UNION ALL SELECT record, 'asset_cash_and_cash_equivalents', n, 0 FROM x UNION ALL SELECT record, 'liability_short_term_loans', 0.0, 1 FROM x UNION ALL SELECT record, unnest(['asset_inventory', 'asset_accounts_receivable']), r, 3 FROM x"
#: Rows that compete for a field: sheet, label, column of the value, and by candidate: field, alias and what the label gives without the size of the value.
_RIVALS = (
    ("balance", "归属于母公司所有者权益合计", COST, (("equity_total_equity", 100 + 13 + 6 + 70 - 70),)),
    ("balance", "所有者权益合计", REV, (("equity_total_equity", 100 + 7 + 6 + 70),)),
    ("balance", "少数股东权益与股东权益合计", "operating_expense_rnd_expenses", (("equity_total_equity", 55 + 6 + 6 + 70 - 120),)),
    ("kpi", "稀释每股收益", REV, (("eps", 100 + 6 + 6 - 20),)),
    ("kpi", "（二）基本每股收益", COST, (("eps", 100 + 6 + 6),)),
    ("kpi", "期末调整后每股净资产", REV, (("net_asset_per_share", 55 + 5 + 6 - 65),)),
    ("kpi", "本期每股净资产", COST, (("net_asset_per_share", 55 + 5 + 6),)),
    ("income", "终止经营净利润", REV, (("net_profit", 55 + 3 + 6 - 35),)),
    ("income", "本年净利润", COST, (("net_profit", 55 + 3 + 6),)),
    ("income", "归属于本公司的净利润", "net_profit", (("net_profit", 55 + 3 + 6 + 60),)),
)


def _rivals(spark: SparkSession, d: str) -> DataFrame:
    x = sheets(spark, d)["income"].where(f"{REV} is not null")
    rows = F.array(*[F.struct(F.lit(sheet).alias("sheet"), F.lit(i).alias("row_idx"), F.array(F.lit(label), T.cents(F.col(c)).cast("string")).alias("cells")) for i, (sheet, label, c, _) in enumerate(_RIVALS)])
    return x.select(F.concat_ws("-", "stock_code", "report_period").alias("record"), F.explode(rows).alias("r")).select("record", "r.*")


Q["c5_rival_rows"] = lambda spark, d: C.fields_of(_rivals(spark, d)).select("record", "sheet", "field", "value", "row_idx")
O["c5_rival_rows"] = f"WITH {ORACLE_BASE}, x AS (SELECT concat_ws('-', stock_code, report_period) AS record, * FROM income WHERE {REV} IS NOT NULL), c AS (" + " UNION ALL ".join(f"SELECT record, '{sheet}' AS sheet, '{field}' AS field, {c}::DECIMAL(18,2)::DOUBLE AS value, {i} AS row_idx, {given} + least(log10(abs({c}::DECIMAL(18,2)::DOUBLE) + 1), 12) AS score FROM x" for i, (sheet, _, c, found) in enumerate(_RIVALS) for field, given in found) + ") SELECT record, sheet, field, value, row_idx FROM c QUALIFY row_number() OVER (PARTITION BY record, sheet, field ORDER BY round(score, 6) DESC, row_idx) = 1"
Q["c12_records"] = lambda spark, d: C.assembled(C.fields_of(_grid(spark, d)), [REV, "liability_short_term_loans"]).select("record", "sheet", REV, "liability_short_term_loans", "warning")
O["c12_records"] = f"WITH {ORACLE_BASE}, x AS (SELECT concat_ws('-', stock_code, report_period) AS record, {REV}::DECIMAL(18,2)::DOUBLE AS r FROM income WHERE {REV} IS NOT NULL) SELECT record, 'income' AS sheet, r AS {REV}, NULL::DOUBLE AS liability_short_term_loans, NULL AS warning FROM x UNION ALL SELECT record, 'balance', NULL, 0.0, NULL FROM x"
_on("c13_candidate_pages", "documents", lambda d: C.candidate_pages(d.select("doc_id", "text"), ["License", "licensed"]).select("doc_id", "hits", "digits"), "WITH p AS (SELECT doc_id, contains(text, 'License')::INT + contains(text, 'licensed')::INT AS hits, length(regexp_replace(text, '[^0-9]', '', 'g'))::INT AS digits FROM documents) SELECT * FROM p WHERE hits >= 2 OR digits >= 80")
_on("c17_c18_grid_choice", "lineitem", lambda x: C.kept_grids(C.grid_quality(x.select(F.col("l_orderkey").alias("grid"), F.col("l_returnflag").alias("sheet"), (F.col("l_orderkey") % 50).alias("page"), F.col("l_linenumber").alias("row_idx"), F.col("l_suppkey").cast("string").alias("alias"), F.array(F.col("l_linestatus"), F.col("l_quantity").cast("int").cast("string")).alias("cells")))).select("grid", "sheet", "page", "quality"), "WITH g AS (SELECT l_orderkey AS grid, l_returnflag AS sheet, l_orderkey % 50 AS page, count(DISTINCT l_suppkey) AS h, count(*) AS n FROM lineitem GROUP BY ALL), q AS (SELECT *, round(least(h, 8) * 1.5 + least(0.5 * 6, 4) + least(n / 8, 4), 6) AS quality FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY sheet, page ORDER BY quality DESC, grid) AS p, max(quality) OVER (PARTITION BY sheet, page) AS t FROM q) SELECT grid, sheet, page, quality FROM r WHERE (p <= 2 AND quality >= 5) OR (t < 5 AND p = 1 AND quality >= 4)")
_on("c21_page_lines", "documents", lambda d: C.page_lines(d).select("doc_id", "row_idx", F.size("cells").alias("n_cells")), "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT - 1 AS row_idx FROM l) SELECT doc_id, row_idx, (1 + least(len(regexp_extract_all(line, '[-+]?\\(?[0-9][0-9,]*(?:\\.[0-9]+)?\\)?%?')), 5))::INT AS n_cells FROM u WHERE length(trim(line, ' ')) >= 4")
Q["a2_a17_curation"] = lambda spark, d: A.curation_summary(A.parse_coded_names(sheets(spark, d)["income"].select(F.concat(F.when(F.col("report_year") % 2 == 0, F.col("stock_code")).otherwise(F.lit("x")), F.lit("_19980331_"), F.col("report_period"), F.lit(".pdf")).alias("name"))))
O["a2_a17_curation"] = f"WITH {ORACLE_BASE}, n AS (SELECT CASE WHEN report_year % 2 = 0 THEN stock_code ELSE 'x' END || '_19980331_' || report_period || '.pdf' AS name, report_year % 2 = 0 AS parsed FROM income) SELECT count(*) FILTER (WHERE parsed) AS parsed, count(*) FILTER (WHERE NOT parsed) AS unparsed, (SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM (SELECT name FROM n WHERE NOT parsed ORDER BY name LIMIT 20)) AS examples FROM n"


def _sheets(name: str, f: Callable[[dict[str, DataFrame]], DataFrame], sql: str) -> None:
    Q[name] = lambda spark, d: f(sheets(spark, d))
    O[name] = f"WITH {ORACLE_BASE} {sql}"


_K3 = "stock_code, report_period, report_year"

def _kpi_given(s: dict[str, DataFrame]) -> DataFrame:
    """Key figures with zero, reversed, missing and wild values, enriched."""
    y = F.col("report_year")
    kpi = s["kpi"].withColumns({
        "net_profit_10k_yuan": F.when(y % 4 == 0, 0.0).when(y % 4 == 1, -F.col("net_profit_10k_yuan")).otherwise(F.col("net_profit_10k_yuan")),
        "roe": F.when(y % 3 == 1, 1_500.0).when(y % 3 == 2, F.col("roe")), "operating_revenue_yoy_growth": F.when(y % 2 == 0, 2_000.0).otherwise(5.0),
        "net_asset_per_share": F.when(y % 2 == 0, F.col("net_asset_per_share") * 0.1).otherwise(F.col("net_asset_per_share")),
        "operating_cf_per_share": F.when(y % 3 == 0, F.lit(0.0)).otherwise(F.col("operating_cf_per_share") * 50),
    })
    income = s["income"].withColumn("operating_revenue_yoy_growth", (y % 7).cast("double"))
    return E.enriched_kpi(kpi, income, s["balance"], s["cash"])


_KPI = "total_operating_revenue, net_profit_10k_yuan, gross_profit_margin, net_profit_margin, roe, roe_weighted_excl_non_recurring, net_asset_per_share, operating_cf_per_share"
_sheets("d6_enriched_kpi", lambda s: _kpi_given(s).select(*_K3.split(", "), "operating_revenue_yoy_growth", *[F.round(c, 6).alias(c) for c in _KPI.split(", ")]), f""", x AS (SELECT {_K3}, report_period LIKE '%FY' AS fy, k.{REV} AS r0, i.{REV} AS r, i.operating_expense_cost_of_sales AS c, i.net_profit AS p, b.equity_total_equity AS e, c.operating_cf_net_amount AS f, k.net_profit_excl_non_recurring AS x,
 CASE report_year % 4 WHEN 0 THEN 0 WHEN 1 THEN -k.net_profit_10k_yuan ELSE k.net_profit_10k_yuan END AS p0, k.gross_profit_margin AS g, k.net_profit_margin AS m, CASE report_year % 3 WHEN 1 THEN 1500 WHEN 2 THEN k.roe END AS roe,
 CASE WHEN report_year % 2 = 0 THEN k.net_asset_per_share * 0.1 ELSE k.net_asset_per_share END AS nav, CASE WHEN report_year % 3 = 0 THEN 0 ELSE k.operating_cf_per_share * 50 END AS ocf, k.eps
 FROM kpi k LEFT JOIN income i USING ({_K3}) LEFT JOIN balance b USING ({_K3}) LEFT JOIN cash c USING ({_K3})),
cand AS (SELECT {_K3}, v AS rev, (v - c) * 100 / v AS gm, p * 100 / v AS nm FROM (SELECT *, unnest([r, r0]) AS v FROM x) WHERE v > 0),
best AS (SELECT {_K3}, rev FROM cand QUALIFY row_number() OVER (PARTITION BY {_K3} ORDER BY CASE WHEN abs(gm) > 100 THEN 1000 + abs(gm) ELSE 0 END + CASE WHEN abs(nm) > 100 THEN 1000 + abs(nm) ELSE 0 END + CASE WHEN gm < -50 THEN -gm - 50 ELSE 0 END + CASE WHEN nm < -50 THEN -nm - 50 ELSE 0 END + CASE WHEN nm > gm + 20 THEN nm - gm + 480 ELSE 0 END, rev DESC) = 1),
y AS (SELECT x.*, coalesce(rev, nullif(r, 0), r0) AS v, CASE WHEN abs(p * 10000 / nullif(eps, 0)) BETWEEN 1e6 AND 1e12 THEN p * 10000 / eps END AS n FROM x LEFT JOIN best USING ({_K3})),
z AS (SELECT *, (v - c) * 100 / nullif(v, 0) AS g1, p * 100 / nullif(v, 0) AS m1, p * 100 / nullif(e, 0) AS roe1, x * 100 / nullif(e, 0) AS w1, e * 10000 / n AS nav1, f * 10000 / n AS ocf1 FROM y)
SELECT {_K3}, CASE WHEN report_year % 2 = 0 THEN report_year % 7 ELSE 5 END::DOUBLE AS operating_revenue_yoy_growth,
 round(CASE WHEN r IS NOT NULL AND (r0 IS NULL OR NOT fy AND (r0 = 0 AND abs(r) > 100 OR r0 <> 0 AND (r0 * r < 0 OR abs(r0 - r) > greatest(100, abs(r) * 0.3)))) THEN r ELSE r0 END, 6)::DOUBLE AS {REV},
 round(CASE WHEN p IS NOT NULL AND (p0 IS NULL OR NOT fy AND (p0 = 0 AND abs(p) > 100 OR p0 <> 0 AND (p0 * p < 0 OR abs(p0 - p) > greatest(100, abs(p) * 0.3)))) THEN p ELSE p0 END, 6)::DOUBLE AS net_profit_10k_yuan,
 round(CASE WHEN g1 IS NOT NULL AND (g IS NULL OR abs(g) > 1000 OR abs(g - g1) > 20) THEN g1 ELSE g END, 6)::DOUBLE AS gross_profit_margin,
 round(CASE WHEN m1 IS NOT NULL AND (m IS NULL OR abs(m) > 1000 OR abs(m - m1) > 20) THEN m1 ELSE m END, 6)::DOUBLE AS net_profit_margin,
 round(CASE WHEN roe1 IS NOT NULL AND (roe IS NULL OR abs(roe) > 1000) THEN roe1 ELSE roe END, 6)::DOUBLE AS roe, round(w1, 6)::DOUBLE AS roe_weighted_excl_non_recurring,
 round(CASE WHEN nav1 IS NOT NULL AND (nav IS NULL OR CASE WHEN nav = 0 OR nav1 = 0 THEN abs(nav - nav1) > 1 ELSE nav * nav1 < 0 OR abs(nav - nav1) > greatest(1, abs(nav) * 0.8, abs(nav1) * 0.8) END) THEN nav1 ELSE nav END, 6)::DOUBLE AS net_asset_per_share,
 round(CASE WHEN ocf1 IS NOT NULL AND (ocf IS NULL OR CASE WHEN ocf = 0 OR ocf1 = 0 THEN abs(ocf - ocf1) > 1 ELSE ocf * ocf1 < 0 OR abs(ocf - ocf1) > greatest(1, abs(ocf) * 0.8, abs(ocf1) * 0.8) END) THEN ocf1 ELSE ocf END, 6)::DOUBLE AS operating_cf_per_share FROM z""")
_sheets("c10b_record_fill", lambda s: E.record_fill(s["balance"]).select(*_K3.split(", "), "equity_total_equity", "asset_liability_ratio"), f"SELECT {_K3}, coalesce(equity_total_equity, asset_total_assets - liability_total_liabilities) AS equity_total_equity, liability_total_liabilities * 100 / nullif(asset_total_assets, 0) AS asset_liability_ratio FROM balance")
_sheets("r25_r26_return_prechecks", lambda s: E.return_prechecks(s["kpi"].withColumns({"roe": F.col("roe") * 3 + 5, "net_asset_per_share": F.col("net_asset_per_share") * 200, "operating_cf_per_share": F.col("operating_cf_per_share") * 50}), s["income"], s["balance"], s["cash"]), f""", x AS (SELECT {_K3}, k.roe * 3 + 5 AS roe, k.net_asset_per_share * 200 AS nav, k.operating_cf_per_share * 50 AS ocf, i.net_profit * 100 / nullif(b.equity_total_equity, 0) AS d, b.equity_total_equity AS e, c.operating_cf_net_amount AS o, CASE WHEN i.net_profit * 10000 / nullif(k.eps, 0) BETWEEN 1e6 AND 1e12 THEN i.net_profit * 10000 / nullif(k.eps, 0) END AS n FROM kpi k JOIN income i USING ({_K3}) LEFT JOIN balance b USING ({_K3}) LEFT JOIN cash c USING ({_K3})),
y AS (SELECT *, e * 10000 / n AS dn, o * 10000 / n AS dc, report_period LIKE '%FY' AND e > 0 AND abs(roe) <= 100 AS fy FROM x), g AS (SELECT * FROM y WHERE NOT coalesce(fy AND (abs(d) > 100 OR roe * d < 0), false))
SELECT {_K3}, 'roe_consistency_precheck' AS rule FROM g WHERE fy AND abs(roe - d) > greatest(8, abs(d) * 0.8, abs(roe) * 0.8) UNION ALL SELECT {_K3}, 'net_asset_per_share_consistency_precheck' FROM g WHERE nav * dn < 0 OR abs(nav - dn) > greatest(2, abs(nav) * 0.8, abs(dn) * 0.8)
UNION ALL SELECT {_K3}, 'operating_cf_per_share_consistency_precheck' FROM g WHERE ocf * dc < 0 OR abs(ocf - dc) > greatest(2, abs(ocf) * 0.8, abs(dc) * 0.8)""")
_sheets("b29_snapped", lambda s: E.snapped(s["cash"].select(*_K3.split(", "), "net_cash_flow"), ["net_cash_flow"]), f"SELECT {_K3}, CASE WHEN abs(net_cash_flow) <= 1e-3 THEN 0 ELSE net_cash_flow END AS net_cash_flow FROM cash")
_sheets("c19_page_grids", lambda s: E.only_without_long_grids(s["income"].select(F.col("stock_code").alias("source_name"), F.col("report_period").alias("table_name")), s["cash"].where("net_cash_flow > 0").select(F.col("stock_code").alias("source_name"), F.col("report_period").alias("table_name"))), "SELECT stock_code AS source_name, report_period AS table_name FROM income i WHERE NOT EXISTS (SELECT 1 FROM cash c WHERE c.stock_code = i.stock_code AND c.report_period = i.report_period AND net_cash_flow > 0)")
_on("k2_k3_body_pages", "documents", lambda d: E.body_pages(d, ["the ", " der ", " que "]).select("doc_id", F.md5(E.without_noise(F.col("text"), ["[%]{3}", "[*]{3}"]).cast("binary")).alias("clean")), "SELECT doc_id, md5(regexp_replace(text, '[%]{3}|[*]{3}', '', 'g')) AS clean FROM documents WHERE contains(text, 'the ')::INT + contains(text, ' der ')::INT + contains(text, ' que ')::INT < 2")
_on("k5_headings", "documents", lambda d: E.with_headings(d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")), "doc_id", "n", F.length("line") < 40).select("doc_id", "n", "section"), "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT - 1 AS n FROM l) SELECT doc_id, n, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM u")
_on("k11_captions", "pages", lambda p: p.select("page_id", F.array_join(E.captions(F.col("html"), "href=\"/[A-Za-z]+"), ",").alias("labels")), "WITH t AS (SELECT page_id, regexp_extract_all(html, 'href=\"/[A-Za-z]+') AS w FROM pages), u AS (SELECT page_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), m AS (SELECT page_id, x, min(i) AS i FROM u GROUP BY ALL) SELECT page_id, coalesce((SELECT string_agg(x, ',' ORDER BY i) FROM m WHERE m.page_id = t.page_id), '') AS labels FROM t")
_on("k24_cut_hits", "embeddings", lambda e: E.cut_hits(_hits(e).drop("rank"), "label", 4, 0.05).select("query_id", "vec_id", "label", "place", "clear"), _sqlhits + ", o AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS r1 FROM r QUALIFY r1 = 1) SELECT query_id, vec_id, label, row_number() OVER w::INT AS place, score - coalesce(lead(score) OVER w, 0) >= 0.05 AS clear FROM o WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY place <= 4".replace("row_number() OVER w::INT AS place", "(row_number() OVER w)::INT AS place"))
_on("k25_reranked", "embeddings", _once(lambda h: E.reranked(h, h.where("label % 2 = 1").select("query_id", "vec_id", (F.col("vec_id") % 17).alias("outside"))).select("query_id", "vec_id", "place")), _sqlhits + " SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN label % 2 = 1 THEN vec_id % 17 END DESC NULLS LAST, score DESC, vec_id))::INT AS place FROM r")
_on("k28_reference_rows", "embeddings", lambda e: E.reference_rows(_hits(e).select("query_id", "vec_id", F.col("rank").alias("place"), (F.col("label") == 9).alias("image"))).select("query_id", "vec_id", "place"), _sqlhits + ", x AS (SELECT query_id, vec_id, rank AS place, label = 9 AS image, max(CASE WHEN rank <= 5 THEN (label = 9)::INT END) OVER (PARTITION BY query_id) AS a, min(CASE WHEN rank > 5 AND label = 9 THEN rank END) OVER (PARTITION BY query_id) AS s FROM r WHERE rank <= 20) SELECT query_id, vec_id, place FROM x WHERE CASE WHEN a = 0 AND s IS NOT NULL THEN place < 5 OR place = s ELSE place <= 5 END")
_on("k31_fusion_rows", "embeddings", lambda e: E.fusion_rows(e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id")), _hits(e).withColumnRenamed("rank", "place")), _sqlhits + " SELECT q.vec_id AS query_id, count(r.vec_id) AS n_hits, coalesce(string_agg(CASE WHEN rank <= 3 THEN r.vec_id::VARCHAR END, ',' ORDER BY rank), '') AS preview FROM (SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0) q LEFT JOIN r ON r.query_id = q.vec_id GROUP BY 1")
_kinds = lambda d: d.select("doc_id", "source", F.when(F.length("text") > 500, "body").otherwise("short").alias("kind"))
_sqlkinds = "WITH k AS (SELECT doc_id, source, CASE WHEN length(text) > 500 THEN 'body' ELSE 'short' END AS kind FROM documents)"
_on("e14_corpus_statistics", "documents", lambda d: E.corpus_statistics(_kinds(d)), _sqlkinds + " SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs, count(DISTINCT CASE WHEN kind = 'body' THEN doc_id END) AS n_body FROM k GROUP BY 1")
_on("e15_sample_chunks", "documents", lambda d: E.sample_chunks(_kinds(d)), _sqlkinds + " SELECT source, kind, min(doc_id) AS doc_id FROM k GROUP BY ALL ORDER BY 1, 2 LIMIT 6")

def _statement_pages(c: DataFrame) -> DataFrame:
    """Pages of a document from the turns of a conversation: every third opens a sheet, every fourth the next one; some speak of an audit."""
    k = F.col("conv_id") + F.col("turn")
    head = F.when(k % 3 == 0, F.lit("一、合并利润表（续）：\n单位：万元\n营业收入 项目\n")).when(k % 4 == 1, F.lit("2. 合并现金流量表\n净利润\n")).when(k % 5 == 2, F.lit("审计报告 合并利润表\n")).otherwise(F.lit(""))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.concat(head, "text").alias("text"))


_on("c14_c16_page_ranges", "conversations", lambda c: E.page_ranges(_statement_pages(c), "income", ["合并利润表"], ["合并现金流量表"], 3), """WITH p AS (SELECT conv_id AS doc_id, turn AS page, text, (conv_id + turn) % 3 = 0 AS a, (conv_id + turn) % 3 <> 0 AND (conv_id + turn) % 4 = 1 AS b FROM conversations),
q AS (SELECT *, NOT a AND NOT b AND (doc_id + page) % 5 = 2 AS o, length(regexp_replace(text, '[^0-9]', '', 'g')) + CASE WHEN b THEN 1 ELSE 0 END AS digits FROM p),
s AS (SELECT x.doc_id, x.page AS first, min(y.page) AS stop FROM q x LEFT JOIN q y ON y.doc_id = x.doc_id AND y.page > x.page AND y.page <= x.page + 2 AND y.b WHERE x.a GROUP BY ALL),
t AS (SELECT s.doc_id, first, max(page) AS last, round(10 + 12 + 8 + 4 + least(sum(digits) / 80, 10) + CASE WHEN bool_or(b) THEN 22 ELSE 0 END - CASE WHEN bool_or(o) THEN 25 ELSE 0 END, 6) AS score
    FROM s JOIN q ON q.doc_id = s.doc_id AND page BETWEEN first AND coalesce(stop, first + 2) GROUP BY ALL)
SELECT doc_id, first, last, score FROM t QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, first) = 1""")
Q["l3_l7_topics_charts"] = lambda spark, d: questions(spark, d).select("question_id", E.topics(F.col("text"), ["净利润", "营业总收入", "公司"]).alias("topics"), E.chart_type(F.col("text"), {"前十": "bar", "公司": "table", "多少": "value"}).alias("chart"))
O["l3_l7_topics_charts"] = f"WITH {_QUESTIONS} SELECT question_id, CASE t WHEN 0 THEN '营业总收入' WHEN 1 THEN '净利润,公司' ELSE '营业总收入,公司' END AS topics, CASE t WHEN 0 THEN 'value' ELSE 'table' END AS chart FROM qs"


def _plan(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    return E.retrieval_plan(K.slots(q).join(K.companies(q, sheets(spark, d)["income"].select("stock_code", "stock_abbr").distinct()), "question_id", "left"))


Q["l11_retrieval_plan"] = _plan
O["l11_retrieval_plan"] = f"WITH {_QUESTIONS} SELECT question_id, CASE t WHEN 0 THEN 'stock' ELSE 'industry' END AS scope, CASE t WHEN 0 THEN 'sql' ELSE 'hybrid' END AS mode, CASE t WHEN 1 THEN 10 ELSE 5 END AS top_k FROM qs"
Q["l12_metric_columns"] = lambda spark, d: E.metric_columns(K.metrics(questions(spark, d), {"营业总收入": "revenue", "净利润": "profit"}), spark.createDataFrame([("revenue", "total_operating_revenue")], "metric string, column string"))
O["l12_metric_columns"] = f"WITH {_QUESTIONS} SELECT question_id, CASE t WHEN 1 THEN 'profit' ELSE 'revenue' END AS metric, CASE t WHEN 1 THEN NULL ELSE 'total_operating_revenue' END AS column, t <> 1 AS supported FROM qs"
Q["k19_report_metadata"] = lambda spark, d: E.report_metadata(_table(spark, d, "documents").select(F.col("doc_id").alias("report_id"), "source", F.when(F.col("lang") == "en", F.col("lang")).alias("lang")), ["source", "lang"]).select("report_id", F.col("metadata")["source"].alias("source"), F.size("metadata").alias("n"))
O["k19_report_metadata"] = "SELECT doc_id AS report_id, source, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS n FROM documents"
Q["k20_descriptions"] = lambda spark, d: E.described(_table(spark, d, "nation").select(F.col("n_name").alias("field"), F.when(F.col("n_regionkey") == 1, F.lit("given")).alias("description")), _table(spark, d, "nation").where("n_nationkey < 12").select(F.col("n_name").alias("field"), F.lit("default").alias("description")))
O["k20_descriptions"] = "SELECT n_name AS field, coalesce(CASE WHEN n_regionkey = 1 THEN 'given' END, CASE WHEN n_nationkey < 12 THEN 'default' END) AS description FROM nation"
_on("k23_retried", "embeddings", lambda e: _once(lambda h: E.retried(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id")), h.where("query_id % 40 = 0 and rank <= 2").select("query_id", "vec_id"), h.where("rank <= 4").select("query_id", "vec_id")))(e), _sqlhits + " SELECT query_id, vec_id, 1 AS pass FROM r WHERE query_id % 40 = 0 AND rank <= 2 UNION ALL SELECT query_id, vec_id, 2 FROM r WHERE query_id % 40 <> 0 AND rank <= 4")
def _k18(spark: SparkSession, d: str) -> DataFrame:
    """Questions on a company's third quarters, every second one also on its industry, one in four without the company; reports of all records."""
    x = sheets(spark, d)["income"].withColumn("id", F.concat_ws("-", "stock_code", "report_period"))
    y = F.col("report_year")
    asked = x.where("report_period like '%Q3'").select(
        F.col("id").alias("question_id"), F.concat_ws(" ", "stock_abbr", "report_period", F.when(y % 2 == 0, F.lit("行业"))).alias("text"),
        F.when(y % 4 != 1, F.array("stock_abbr")).alias("companies"), F.array("report_period").alias("topics"),
    )
    kind = F.when((F.col("stock_code").cast("int") + y) % 3 == 0, "industry").otherwise("stock")
    reports = x.select(F.col("id").alias("report_id"), kind.alias("kind"), F.concat(F.col("report_period"), F.lit(" 点评")).alias("title"), F.col("stock_abbr").alias("company"), F.lit("").alias("organization"))
    return K.metadata_scores(asked, reports, 5)


Q["k18_metadata_scores"] = _k18
O["k18_metadata_scores"] = f"""WITH {ORACLE_BASE}, x AS (SELECT concat_ws('-', stock_code, report_period) AS id, stock_abbr AS n, report_period AS p, report_year AS y, (stock_code::INT + report_year) % 3 = 0 AS wide FROM income),
s AS (SELECT q.id AS question_id, r.id AS report_id, round(CASE WHEN q.n = r.n AND q.y % 4 <> 1 THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN q.n = r.n THEN 0.2 ELSE 0 END + CASE WHEN q.p = r.p THEN 2.2 ELSE 0 END + CASE WHEN r.wide AND q.y % 2 = 0 THEN 1 ELSE 0 END - CASE WHEN NOT r.wide AND q.y % 4 <> 1 AND q.n <> r.n THEN 2.5 ELSE 0 END, 6)::DOUBLE AS score
    FROM x q, x r WHERE q.p LIKE '%Q3')
SELECT *, (row_number() OVER (PARTITION BY question_id ORDER BY score DESC, report_id))::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= 5"""
_cited = lambda spark, d: _hits(_table(spark, d, "embeddings")).where("rank <= 10").select("query_id", F.col("vec_id").alias("doc_id"), F.when(F.col("label") < 5, "the ").when(F.col("label") < 8, "zzz").alias("company"), F.array(F.lit("License"), F.lit("token")).alias("terms"), F.col("label").alias("page"))
_lines = lambda spark, d: _table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "text"))
_sqllines = _sqlhits + ", l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), c AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1)::INT - 1 AS chunk FROM l), e AS (SELECT query_id, vec_id AS doc_id, CASE WHEN label < 5 THEN 'the ' WHEN label < 8 THEN 'zzz' END AS company, label AS page FROM r WHERE rank <= 10)"
Q["k26_best_chunk"] = lambda spark, d: E.best_chunk(_cited(spark, d), _lines(spark, d).withColumns({"kind": F.when(F.col("chunk") % 2 == 0, "body").otherwise("visual"), "section": F.when(F.col("chunk") % 3 == 0, F.lit("1")), "figures": F.col("chunk") % 5 == 1}))
O["k26_best_chunk"] = _sqllines + ", s AS (SELECT query_id, doc_id, chunk, round(CASE WHEN chunk % 2 = 0 THEN 2.0 ELSE 0 END + CASE WHEN chunk % 3 = 0 THEN 0.5 ELSE 0 END - CASE WHEN length(text) < 30 THEN 1.5 ELSE 0 END + CASE WHEN company IS NULL THEN 0 WHEN contains(text, company) THEN 2.0 ELSE -0.8 END + contains(text, 'License')::INT + contains(text, 'token')::INT + CASE WHEN chunk % 5 = 1 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS chunk_score FROM e JOIN c USING (doc_id)) SELECT query_id, doc_id, chunk, chunk_score FROM s QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_score DESC, chunk) = 1"
Q["k27_best_visual"] = lambda spark, d: E.best_visual(_cited(spark, d), _lines(spark, d).where("chunk % 2 = 1").withColumns({"caption": F.when(F.col("chunk") % 3 == 0, F.substring("text", 1, 9)), "page": (F.col("chunk") / 2).cast("int")}))
O["k27_best_visual"] = _sqllines + ", v AS (SELECT query_id, doc_id, chunk, c.text, company, CASE WHEN chunk % 3 = 0 THEN substr(c.text, 1, 9) END AS caption, abs(e.page - chunk // 2) AS gap, e.page > 0 AND chunk // 2 > 0 AS paged FROM e JOIN c USING (doc_id) WHERE chunk % 2 = 1), s AS (SELECT *, round(CASE WHEN caption <> '' THEN 1.0 ELSE 0 END + CASE WHEN contains(text, company) THEN 1.5 ELSE 0 END + contains(text, 'License')::INT + contains(text, 'token')::INT + CASE WHEN NOT paged THEN 0 WHEN gap = 0 THEN 1.2 WHEN gap <= 2 THEN 0.6 WHEN gap <= 4 THEN 0.2 ELSE 0 END, 6)::DOUBLE AS chunk_score FROM v) SELECT query_id, doc_id, chunk, chunk_score FROM s WHERE chunk_score >= 1 QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY chunk_score DESC, chunk) = 1"
_on("b24_b27_page_heads", "documents", lambda d: d.select("doc_id", T.first_line_with(F.col("text"), ["License", "token"]).alias("title"), T.file_key(F.concat(F.col("source"), F.lit(" (1).PDF"))).alias("key")), "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, 'License') OR contains(x, 'token'))[1] AS title, source || '1' AS key FROM documents")
_sheets("r27_relaxed_cash_flow", lambda s: s["cash"].withColumns({c: F.coalesce(F.col(c) * 1000, F.lit(0.0)) for c, t in s["cash"].dtypes if t == "double"}).where(E.relaxed_cash_gap()).select(*_K3.split(", ")), f", z AS (SELECT {_K3}, coalesce(net_cash_flow, 0) * 1000 AS n, (coalesce(operating_cf_net_amount, 0) * 1000 + coalesce(investing_cf_net_amount, 0) * 1000 + coalesce(financing_cf_net_amount, 0) * 1000) AS t FROM cash) SELECT {_K3} FROM z WHERE abs(n - t) > greatest(100, abs(n) * 0.05) AND abs(n) > 1e-3")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the questions on the facts: reports of the company asked for and of two others, some on another event."""
    x = sheets(spark, d)["income"].where("report_period like '%Q3'")
    own = x.select(F.concat_ws("-", "stock_code", "report_period").alias("question_id"), F.col("stock_code").cast("int").alias("k"), "report_year")
    rows = own.withColumn("place", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])))
    number = F.col("k") + F.col("place") % 3
    return rows.select(
        "question_id", "place", F.when((F.col("k") + F.col("place")) % 4 == 0, "industry").otherwise("stock").alias("source_type"),
        F.concat(F.lit("supplier#"), F.lpad(number.cast("string"), 9, "0"), F.lit("股份有限公司")).alias("company"),
        F.when(F.col("place") % 2 == 0, "集采中标").otherwise("季度点评").alias("title"), F.lit("").alias("snippet"),
    )


def _asked(spark: SparkSession, d: str) -> DataFrame:
    x = sheets(spark, d)["income"].where("report_period like '%Q3'")
    return x.select(F.concat_ws("-", "stock_code", "report_period").alias("question_id"), F.when(F.col("report_year") % 2 == 0, "哪些公司中标集采").otherwise("有哪些公司").alias("text"))


def _k29(spark: SparkSession, d: str) -> DataFrame:
    names = _table(spark, d, "supplier").select(F.col("s_name").alias("stock_abbr"))
    out = K.evidence_companies(_asked(spark, d), _evidence(spark, d), names)
    return out.select("question_id", F.array_join("companies", ",").alias("companies"))


Q["k29_evidence_companies"] = _k29
O["k29_evidence_companies"] = f"""WITH {ORACLE_BASE}, x AS (SELECT concat_ws('-', stock_code, report_period) AS question_id, stock_code::INT AS k, report_year, unnest([1, 2, 3, 4]) AS place FROM income WHERE report_period LIKE '%Q3'),
e AS (SELECT question_id, place, 'Supplier#' || lpad((k + place % 3)::VARCHAR, 9, '0') AS name FROM x WHERE (k + place) % 4 <> 0 AND (report_year % 2 = 1 OR place % 2 = 0)),
m AS (SELECT question_id, name, min(place) AS place FROM e JOIN supplier ON s_name = name GROUP BY ALL)
SELECT question_id, string_agg(name, ',' ORDER BY place, name) AS companies FROM m GROUP BY 1"""


def _c10(spark: SparkSession, d: str) -> DataFrame:
    s = sheets(spark, d)
    rows = C.with_adjacent_growth(_adjacent(s["income"]), "income")
    return rows.select(*KEY, F.round("operating_revenue_yoy_growth", 6).alias("operating_revenue_yoy_growth"), F.round("net_profit_yoy_growth", 6).alias("net_profit_yoy_growth"))


def _adjacent(income: DataFrame) -> DataFrame:
    """Records with the figures of the column beside them (three quarters of the revenue; the profit with the other sign)."""
    given = F.when(F.col("report_year") % 3 == 0, F.lit(0.0)).when(F.col("report_year") % 3 == 1, F.when(F.col("report_period").endswith("H1"), 5_000.0).otherwise(12.5))
    return income.withColumns({"total_operating_revenue_previous": F.col(REV) * 0.75, "net_profit_previous": F.when(F.col("report_year") % 2 == 0, -F.col("net_profit")), "operating_revenue_yoy_growth": given, "net_profit_yoy_growth": F.lit(None).cast("double")})


Q["c10_adjacent_growth"] = _c10
O["c10_adjacent_growth"] = f"""WITH {ORACLE_BASE}, x AS (SELECT stock_code, report_period, report_year, {REV} AS r, {REV} * 0.75 AS r0, net_profit AS p, CASE WHEN report_year % 2 = 0 THEN -net_profit END AS p0, CASE report_year % 3 WHEN 0 THEN 0.0 WHEN 1 THEN CASE WHEN report_period LIKE '%H1' THEN 5000 ELSE 12.5 END END AS g FROM income)
SELECT stock_code, report_period, report_year, round(CASE WHEN (coalesce(g, 0) = 0 OR abs(g) > 1000) AND r IS NOT NULL AND r0 <> 0 THEN (r - r0) / abs(r0) * 100 ELSE g END, 6)::DOUBLE AS operating_revenue_yoy_growth,
    round(CASE WHEN p IS NOT NULL AND p0 <> 0 THEN (p - p0) / abs(p0) * 100 END, 6)::DOUBLE AS net_profit_yoy_growth FROM x"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    found = K.slots(q).join(K.companies(q, sheets(spark, d)["income"].select("stock_code", "stock_abbr").distinct()), "question_id", "left")
    found = found.join(K.metrics(q, {"营业总收入": "revenue"}), "question_id").join(q, "question_id")
    count = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, ",")))
    kind = K.question_type(F.col("text"), F.lit(None).cast("string"), count(F.col("companies")), count(F.col("metrics")), F.size("periods"))
    return found.select("question_id", kind.alias("question_type"))


Q["l8_question_types"] = _typed
O["l8_question_types"] = f"WITH {_QUESTIONS} SELECT question_id, CASE t WHEN 0 THEN 'single_company_metric' WHEN 1 THEN 'ranking' ELSE 'filter' END AS question_type FROM qs"
_on("b26_page_unit", "documents", lambda d: d.select("doc_id", T.page_unit(F.concat(F.repeat(F.lit("\n"), (F.col("doc_id") % 100).cast("int")), F.lit("单位：万元\n"), F.col("text"))).alias("unit")), "SELECT doc_id, CASE WHEN doc_id % 100 < 80 THEN '万元' END AS unit FROM documents")
_on("b28_caption_text", "nation", lambda n: n.select("n_nationkey", E.caption_text(F.when(F.col("n_regionkey") > 0, F.col("n_name")), F.concat(F.lit("region "), F.col("n_regionkey").cast("string"))).alias("caption")), "SELECT n_nationkey, concat_ws('：', CASE WHEN n_regionkey > 0 THEN n_name END, 'region ' || n_regionkey) AS caption FROM nation")
_on("c20_first_method", "lineitem", lambda x: C.first_method(x.select(F.col("l_orderkey").alias("grid"), F.col("l_returnflag").alias("sheet"), (F.col("l_orderkey") % 5_000).alias("page"), F.col("l_linenumber").alias("method_order"))), "SELECT l_orderkey AS grid, l_returnflag AS sheet, l_orderkey % 5000 AS page, l_linenumber AS method_order FROM lineitem QUALIFY l_linenumber = min(l_linenumber) OVER (PARTITION BY l_returnflag, l_orderkey % 5000)")
_sheets("b24_cover", lambda s: s["income"].select(*_K3.split(", "), T.cover(F.when(F.col("report_year") % 2 == 0, F.concat(F.lit("证券代码 "), "stock_code", F.lit("\n"), (F.col("report_year") + 10).cast("string"), F.lit("年第三季度报告摘要"))).otherwise(F.lit("目录")), F.concat("stock_code", F.lit("："), (F.col("report_year") + 20).cast("string"), F.lit("年年度报告.pdf"))).alias("x")).select(*_K3.split(", "), "x.*"), f"SELECT {_K3}, (report_year + CASE WHEN report_year % 2 = 0 THEN 10 ELSE 20 END)::INT AS year, CASE WHEN report_year % 2 = 0 THEN 'Q3' ELSE 'FY' END AS period, report_year % 2 = 0 AS summary, stock_code AS code FROM income")
_sheets("d15_names", lambda s: D.enrich_names(s["income"].select(F.concat_ws("-", "stock_code", "report_period").alias("id"), F.when(F.col("report_year") % 3 > 0, F.col("stock_code")).alias("stock_code"), F.when(F.col("report_year") % 3 < 2, F.when(F.col("report_period").endswith("Q1"), "none").otherwise(F.col("stock_abbr"))).alias("stock_abbr")), s["income"].select("stock_code", "stock_abbr").distinct()).select("id", "name", "code"), "SELECT concat_ws('-', stock_code, report_period) AS id, CASE WHEN report_year % 3 < 2 AND report_period LIKE '%Q1' THEN 'none' ELSE stock_abbr END AS name, CASE WHEN report_year % 3 = 0 AND report_period LIKE '%Q1' THEN '000000' ELSE stock_code END AS code FROM income")


def _kpi_grid(spark: SparkSession, d: str) -> DataFrame:
    """Grids of key figures: amounts of two years and a growth rate, a label over two rows, rates beyond reason, a breakdown by quarters."""
    n = lambda c: T.cents(F.col(c)).cast("string")
    none = F.lit(None).cast("string")
    row = lambda label, *cells: F.array(F.lit(label), *cells, *[none] * (4 - len(cells)))
    wild = F.when(F.col("report_year") % 2 == 0, "5,000.00%").otherwise("-8.25%")
    grid = F.array(
        row("（一）营业收入（元）", n(REV), n("net_profit"), wild),
        row("归属于上市公司股东的"), row("净利润", n("net_profit"), n(REV), F.lit("600.00"), F.lit("7.5%")),
        row("归属于上市公司股东的扣除非经常性损益的净利润", n("net_profit"), n(REV), F.lit("3.25"), F.lit("1,200.5%")),
        row("其中：营业收入", F.lit("1"), F.lit("2"), F.lit("12％")),
        row("第一季度第二季度"), row("营业收入", F.lit("1"), F.lit("2"), F.lit("99%")),
    )
    x = sheets(spark, d)["income"].where(f"{REV} is not null and net_profit is not null")
    return x.select(F.concat_ws("-", "stock_code", "report_period").alias("record"), F.lit("kpi").alias("sheet"), F.posexplode(grid).alias("row_idx", "cells"))


Q["c11_kpi_growth"] = lambda spark, d: C.kpi_growth(_kpi_grid(spark, d), F.col("record").endswith("Q3"), 1_000.0)
O["c11_kpi_growth"] = f"""WITH {ORACLE_BASE} SELECT concat_ws('-', stock_code, report_period) AS record, CASE WHEN report_year % 2 = 0 THEN 12.0 ELSE -8.25 END::DOUBLE AS operating_revenue_yoy_growth, 7.5::DOUBLE AS net_profit_yoy_growth,
    CASE WHEN report_period LIKE '%Q3' THEN 1200.5 ELSE 3.25 END::DOUBLE AS net_profit_excl_non_recurring_yoy FROM income WHERE {REV} IS NOT NULL AND net_profit IS NOT NULL"""
