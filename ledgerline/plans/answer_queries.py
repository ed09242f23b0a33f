"""Registered queries of versions of reports (A-3, A-4, A-17), routes (L-8), references and fused rows (K-28, K-31), drawings (M-2, M-3) and the view's other rules
(V-3, V-4), with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators import references as N
from ..operators import retrieval as K
from ..operators import routing as L
from ..operators import versions as A
from ..operators import view as V
from ..sources.statements import KEY, ORACLE_BASE, sheets
from ..sources.tables import stored
from .statement_queries import INV, NP, ORACLE_VIEW, REV, P, view
from .text_queries import _hits, _sqlhits, _table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}

#: Forms of names of report files; {c}: company, {y}: year, {p}: part of the year.
NAMES = ("{c}：{y}年{p}报告.pdf", " {c} ： {c}{y}年{p}报告（更新后）.PDF", "{c}：{y}年{p}报告（更正后）全文.pdf", "{c}：{y}年{p}报告（更正后）(1).pdf", "{c}：{y}年{p}报告（英文版）更正后.pdf", "{c}：{y}年{p}报告摘要.pdf", "{c}：{y}年{p}报告摘要(1).pdf", "{c} {y}年{p}报告.pdf", "{c}：{y}年报.pdf", "{c}：{y}年{p}报告.doc")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Names of files of all periods; which forms there are depends on company and year, so that each rule of choice decides somewhere."""
    x = sheets(spark, d)["income"].select(F.col("stock_code").cast("int").alias("k"), "report_year", F.col("stock_abbr").alias("c"), (F.col("report_year") + 20).cast("string").alias("y"), "report_period")
    part = F.when(F.col("report_period").endswith("Q1"), "第一季度").when(F.col("report_period").endswith("H1"), "半年度").when(F.col("report_period").endswith("Q3"), "三季度").otherwise("年度")
    x = x.withColumn("p", part).select("*", F.posexplode(F.array(*map(F.lit, NAMES))).alias("i", "form")).where((F.col("k") + F.col("report_year") * 3 + F.col("i") * 5) % 7 > 2)
    name = F.col("form")
    for letter in "cyp":
        name = F.replace(name, F.lit("{" + letter + "}"), F.col(letter))
    return A.titled(x.select(name.alias("name")))


_sqlfiles = f"""WITH {ORACLE_BASE}, n AS (SELECT replace(replace(replace(form, '{{c}}', stock_abbr), '{{y}}', (report_year + 20)::VARCHAR), '{{p}}', CASE report_period[5:6] WHEN 'Q1' THEN '第一季度' WHEN 'H1' THEN '半年度' WHEN 'Q3' THEN '三季度' ELSE '年度' END) AS name
    FROM (SELECT *, unnest([{", ".join(f"'{n}'" for n in NAMES)}]) AS form, unnest(range(10)) AS i FROM income) WHERE (stock_code::INT + report_year * 3 + i * 5) % 7 > 2),
t AS (SELECT name, regexp_replace(split_part(name, '：', 1), '\\s+', '', 'g') AS company, trim(regexp_replace(substr(name, strpos(name, '：') + 1), '(?i)\\.pdf$', '')) AS tail FROM n),
u AS (SELECT name, company, CASE WHEN starts_with(replace(tail, ' ', ''), company) THEN trim(substr(tail, length(company) + 1)) ELSE tail END AS rest FROM t),
pf AS (SELECT name, lower(name) LIKE '%.pdf' AND contains(name, '：') AND regexp_matches(rest, '20[0-9]{{2}}年') AND regexp_matches(rest, '季度|年度') AS parsed, company, regexp_extract(rest, '(20[0-9]{{2}})年', 1) AS y, replace(regexp_extract(rest, '第?[一三]季度|半?年度'), '第', '') AS period,
    CASE WHEN contains(rest, '摘要') THEN '摘要' ELSE '全文' END AS report_type, CASE WHEN contains(rest, '更正后') THEN '更正后' WHEN contains(rest, '更新后') THEN '更新后' ELSE '' END AS correction, suffix(rest, '(1)') AS duplicate, contains(rest, '英文') AS english FROM u),
f AS (SELECT * REPLACE (y::INT AS y) FROM pf WHERE parsed)"""
Q["a3_a4_titled_versions"] = lambda spark, d: A.versions(_files(spark, d)).select("name", "company", "year", "period", "report_type", "correction", "duplicate", "english", "canonical_name", "group_key", "group_size", "selected", "selected_source", "selection_reason")
O["a3_a4_titled_versions"] = _sqlfiles + """, r AS (SELECT *, count(*) OVER w AS group_size, first_value(name) OVER best AS selected_source, first_value(correction) OVER best AS c FROM f
    WINDOW w AS (PARTITION BY company, y, period, report_type), best AS (PARTITION BY company, y, period, report_type ORDER BY correction = '', correction <> '更正后', english, duplicate, NOT contains(name, '全文'), name DESC))
SELECT name, company, y AS year, period, report_type, correction, duplicate, english, company || '：' || y || '年' || period || '报告' || report_type || '.pdf' AS canonical_name, concat_ws('|', company, y, period, report_type) AS group_key, group_size,
    name = selected_source AS selected, selected_source, CASE WHEN c = '' THEN 'single_or_best_available' ELSE 'corrected_preferred' END AS selection_reason FROM r"""
Q["a17_selection_summary"] = lambda spark, d: A.selection_summary(stored(_files(spark, d)))
O["a17_selection_summary"] = _sqlfiles + """ SELECT (SELECT count(*) FROM f) AS parsed_files, (SELECT count(*) FROM pf WHERE NOT parsed) AS unparsable_files, count(*) AS selected_files, count(*) FILTER (WHERE n > 1) AS groups_with_multiple_candidates,
    (SELECT string_agg(name, ',' ORDER BY name) FROM (SELECT name FROM pf WHERE NOT parsed ORDER BY name LIMIT 20)) AS unparsable_examples FROM (SELECT count(*) AS n FROM f GROUP BY company, y, period, report_type)"""

#: Forms of questions; {c}: company, {y}: year.
ASKED = ("{c}{y}年第三季度净利润是多少", "{c}{y}年第三季度净利润的柱状图", "{c}净利润的原因，画图表", "{c}为什么", "行业观点与库存", "{c}行业观点有哪些", "行业景气度", "{c}的渠道", "净利润超过10亿的企业", "{c}净利润与渠道", "结合研报说明{c}净利润", "你好", "{c}的行业", "各公司前十", "观点", "{c}", "可视化", "板块的净利润")
METRICS, TOPICS = ("营业总收入", "净利润"), ("渠道", "品牌")


def _routed(spark: SparkSession, d: str) -> DataFrame:
    x = sheets(spark, d)["income"].where("report_period like '%Q3'").select(F.concat_ws("-", "stock_code", "report_period").alias("record"), F.col("stock_abbr").alias("c"), F.col("report_year").cast("string").alias("y"), F.posexplode(F.array(*map(F.lit, ASKED))).alias("i", "form"))
    x = x.withColumn("text", F.replace(F.replace(F.col("form"), F.lit("{c}"), F.col("c")), F.lit("{y}"), F.col("y")))
    words = lambda of: F.array_compact(F.array(*[F.when(F.col("text").contains(w), F.lit(w)) for w in of]))
    t = F.col("text")
    found = {"companies": F.when(F.contains(t, F.col("c")), F.array("c")), "metrics": words(METRICS), "periods": K.periods(t), "topics": words(TOPICS), "top_n": K.top_n(t), "threshold": K.threshold(t)}
    x = x.select(F.concat_ws("-", "record", "i").alias("question_id"), "text", *[v.alias(c) for c, v in found.items()])
    return L.routed(x).select("question_id", "intent", "needs_sql", "needs_retrieval")


Q["l8_routes"] = _routed
_any = lambda of: f"regexp_matches(text, '{'|'.join(of)}')"
O["l8_routes"] = f"""WITH {ORACLE_BASE}, asked AS (SELECT concat_ws('-', stock_code, report_period, i) AS question_id, replace(replace(form, '{{c}}', stock_abbr), '{{y}}', report_year::VARCHAR) AS text FROM (SELECT *, unnest([{", ".join(f"'{a}'" for a in ASKED)}]) AS form, unnest(range({len(ASKED)})) AS i FROM income WHERE report_period LIKE '%Q3')),
w AS (SELECT question_id, contains(text, 'Supplier#') AS named, {_any(L.CHART)} AS chart, {_any(L.REASON)} AS why, {_any(L.INDUSTRY)} AS wide, {_any(L.REPORTS)} AS strong, {_any(TOPICS)} AS topic, {_any(L.SCREENING)} OR {_any(METRICS)} OR regexp_matches(text, '[0-9]{{4}}年|前十') AS sql FROM asked),
i AS (SELECT question_id, CASE WHEN chart AND sql AND NOT why THEN ['sql_chart', 't', 'f'] WHEN why THEN ['causal_analysis', sql::VARCHAR, 't'] WHEN strong AND wide AND NOT named THEN ['industry_open_analysis', sql::VARCHAR, 't'] WHEN strong AND sql THEN ['hybrid_sql_rag', 't', 't']
    WHEN wide AND NOT named AND NOT sql THEN ['industry_open_analysis', 'f', 't'] WHEN sql AND NOT topic AND NOT wide AND NOT strong THEN ['sql_only', 't', 'f'] WHEN sql THEN ['hybrid_sql_rag', 't', 't'] WHEN wide THEN ['industry_open_analysis', 'f', 't'] WHEN named OR topic THEN ['rag_only', 'f', 't'] ELSE ['open_analysis', 'f', 't'] END AS x FROM w)
SELECT question_id, x[1] AS intent, x[2]::BOOLEAN AS needs_sql, x[3]::BOOLEAN AS needs_retrieval FROM i"""


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Hits with the texts of documents, paths of several folders, and captions of their own, of their chunk and of a drawing nearby."""
    v = F.col("vec_id")
    hits = _hits(_table(spark, d, "embeddings")).join(_table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left")
    end = F.concat(v.cast("string"), F.lit(".pdf"))
    path = F.when(v % 5 == 0, F.concat(F.lit("/data/正式数据/附件5：研报数据/"), end)).when(v % 5 == 1, F.concat(F.lit("/data/a/正式数据/x//"), end, F.lit("/"))).when(v % 5 == 2, F.concat(F.lit("/data/out/"), end)).when(v % 5 == 3, F.concat(F.lit("/other/正式数据/"), end))
    return hits.select(
        "query_id", F.col("rank").alias("place"), path.alias("path"), F.when(v % 3 > 0, F.col("text")).alias("text"), F.concat(F.lit(" chunk "), v.cast("string")).alias("chunk_text"),
        F.when((F.col("label") == 9) & (v % 2 == 0), F.array(F.lit("图1"), F.lit(" "), F.concat(F.lit("图"), v.cast("string")), F.lit("图4"))).alias("captions"),
        F.when(v % 23 == 0, F.array(N.caption(F.lit("表1"), F.when(v % 2 == 0, "收入")))).alias("chunk_captions"), F.when(v % 29 == 0, "图1").when(v % 31 == 0, "附图").alias("visual"),
    )


Q["k28_references"] = lambda spark, d: N.references(_cited(spark, d), "/data")
O["k28_references"] = _sqlhits + """, c AS (SELECT r.*, d.text FROM r LEFT JOIN documents d ON d.doc_id = r.vec_id WHERE rank <= 20),
p AS (SELECT query_id, rank AS place, CASE vec_id % 5 WHEN 0 THEN '../附件 5：研报数据/' || vec_id || '.pdf' WHEN 1 THEN '../x/' || vec_id || '.pdf' WHEN 2 THEN './out/' || vec_id || '.pdf' WHEN 3 THEN '/other/正式数据/' || vec_id || '.pdf' ELSE '' END AS path,
    substr(CASE WHEN vec_id % 3 > 0 AND trim(coalesce(text, '')) <> '' THEN trim(text) ELSE 'chunk ' || vec_id END, 1, 600) AS text,
    CASE WHEN label = 9 AND vec_id % 2 = 0 THEN '图1；图' || vec_id WHEN vec_id % 23 = 0 THEN CASE WHEN vec_id % 2 = 0 THEN '表1：收入' ELSE '表1' END END AS own, CASE WHEN vec_id % 29 = 0 THEN '图1' WHEN vec_id % 31 = 0 THEN '附图' END AS seen FROM c),
x AS (SELECT query_id, place, path, text, CASE WHEN own IS NULL THEN seen WHEN seen IS NULL OR contains(own, seen) THEN own ELSE own || '；' || seen END AS picture FROM p),
s AS (SELECT query_id, min(place) AS spare FROM x WHERE picture IS NOT NULL GROUP BY 1 HAVING min(place) > 5)
SELECT query_id, (CASE WHEN place > 5 THEN 5 ELSE place END)::INT AS place, path, text, picture FROM x LEFT JOIN s USING (query_id) WHERE place < 5 OR place = coalesce(spare, 5)"""


def _fusable(spark: SparkSession, d: str) -> DataFrame:
    """Questions on every tenth vector; rows and evidence from hits, for some of them only."""
    e = _table(spark, d, "embeddings")
    hits = stored(_hits(e))
    rows = hits.where("query_id % 3 > 0 and label < 4").select("query_id", F.col("rank").alias("place"), F.to_json(F.struct("vec_id", "label")).alias("row"))
    evidence = hits.where("query_id % 60 > 0").select("query_id", F.col("rank").alias("place"), F.concat(F.lit("report "), F.col("vec_id").cast("string")).alias("title"), F.when(F.col("label") % 4 == 0, " ").when(F.col("label") % 4 == 1, "stock").when(F.col("label") % 4 == 2, "industry").alias("source_type"))
    return N.fused(e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id")), rows, evidence, 9)


Q["k31_fused_rows"] = _fusable
O["k31_fused_rows"] = _sqlhits + """, q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 10 = 0),
s AS (SELECT query_id, count(*) AS n, list('{"vec_id":' || vec_id || ',"label":' || label || '}' ORDER BY rank) FILTER (WHERE rank <= 9) AS x FROM r WHERE query_id % 3 > 0 AND label < 4 GROUP BY 1),
k AS (SELECT *, CASE label % 4 WHEN 1 THEN 'stock' WHEN 2 THEN 'industry' ELSE 'unknown' END AS kind FROM r WHERE query_id % 60 > 0),
e AS (SELECT query_id, count(*) AS n, list('report ' || vec_id ORDER BY rank) FILTER (WHERE rank <= 9) AS x FROM k GROUP BY 1),
b AS (SELECT query_id, '{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}' AS x FROM (SELECT query_id, kind, count(*) AS n FROM k GROUP BY ALL) GROUP BY 1)
SELECT query_id, coalesce(s.n, 0) AS sql_row_count, coalesce(e.n, 0) AS evidence_count, coalesce(s.x, []) AS sql_preview, coalesce(e.x, []) AS evidence_titles, coalesce(b.x, '{}') AS source_breakdown FROM q LEFT JOIN s USING (query_id) LEFT JOIN e USING (query_id) LEFT JOIN b USING (query_id)"""

Q["m2_collapsed_chart"] = lambda spark, d: C.charted(view(spark, d).select("stock_code", NP), "stock_code", NP, n=15)
O["m2_collapsed_chart"] = f"WITH {ORACLE_VIEW}, c AS (SELECT stock_code, CASE WHEN (SELECT quantile_cont({NP}, 0.75) FROM v) <= 0 THEN min({NP}) ELSE max({NP}) END AS {NP} FROM v GROUP BY 1) SELECT *, row_number() OVER (ORDER BY {NP} DESC NULLS LAST, stock_code)::INT AS place FROM c ORDER BY place LIMIT 15"
_written = lambda v: v.select("report_period", "stock_code", F.when(F.col(REV) % 7 < 1, "-").otherwise(F.floor(REV).cast("string")).alias("figure"))
Q["m2_series_chart"] = lambda spark, d: C.charted(_written(view(spark, d)), "stock_code", "figure", series="report_period", n=4, collapse=False, ascending=True)
O["m2_series_chart"] = f"WITH {ORACLE_VIEW}, w AS (SELECT report_period, stock_code, CASE WHEN {REV} % 7 < 1 THEN '-' ELSE floor({REV})::BIGINT::VARCHAR END AS figure FROM v) SELECT *, row_number() OVER (PARTITION BY report_period ORDER BY try_cast(figure AS DOUBLE) NULLS LAST, stock_code)::INT AS place FROM w QUALIFY place <= 4"
_drawn = (REV, "gross_profit_margin", INV)
Q["m3_scaled_columns"] = lambda spark, d: C.scaled(view(spark, d).where(F.col("report_period") == P).select("stock_code", (F.col(REV) * 1000).alias(REV), "gross_profit_margin", INV), list(_drawn))
_scaled = lambda c: f"CASE WHEN max(abs({c})) OVER () >= 1e5 THEN coalesce({c}, 0) / 10000 ELSE coalesce({c}, 0) END AS {c}, CASE WHEN max(abs({c})) OVER () >= 1e5 THEN '万元' ELSE '' END AS {c}_unit"
O["m3_scaled_columns"] = f"WITH {ORACLE_VIEW}, x AS (SELECT stock_code, {REV} * 1000 AS {REV}, gross_profit_margin, {INV} FROM v WHERE report_period = '{P}') SELECT stock_code, {_scaled(REV)}, coalesce(gross_profit_margin, 0) AS gross_profit_margin, '%' AS gross_profit_margin_unit, {_scaled(INV)} FROM x"

#: Figures that the sheets lack, from those that they have: name to (sheet, figure, factor, missing where company number and year, added, leave 0 by this number).
MORE_FLOWS = {
    "total_profit": ("income", NP, 1.25, 5), "operating_profit": ("income", NP, 1.5, 7), "operating_expense_administrative_expenses": ("income", "operating_expense_selling_expenses", 0.5, 11), "operating_expense_financial_expenses": ("income", "operating_expense_rnd_expenses", 0.25, 13),
    "operating_expense_taxes_and_surcharges": ("income", REV, 0.125, 3), "total_operating_expenses": ("income", "operating_expense_cost_of_sales", 1.5, 17), "other_income": ("income", NP, 0.5, 2), "asset_impairment_loss": ("income", NP, -0.25, 19), "credit_impairment_loss": ("income", NP, -0.125, 23),
    "operating_cf_cash_from_sales": ("cash", "operating_cf_net_amount", 2.0, 4), "investing_cf_cash_for_investments": ("cash", "investing_cf_net_amount", -1.5, 6), "investing_cf_cash_from_investment_recovery": ("cash", "investing_cf_net_amount", 0.5, 8), "financing_cf_cash_from_borrowing": ("cash", "financing_cf_net_amount", 0.75, 9), "financing_cf_cash_for_debt_repayment": ("cash", "financing_cf_net_amount", -0.25, 10),
}


def _all_flows(spark: SparkSession, d: str) -> DataFrame:
    s = dict(sheets(spark, d))
    for sheet in ("income", "cash"):
        s[sheet] = s[sheet].withColumns({c: F.when((F.col("stock_code").cast("int") + F.col("report_year")) % gap > 0, F.col(of) * factor) for c, (of_sheet, of, factor, gap) in MORE_FLOWS.items() if of_sheet == sheet})
    out = V.wide(*[s[n] for n in ("income", "kpi", "balance", "cash")], flows=V.ALL_FLOWS)
    return out.where(V.suffix(F.col("report_period")).isin("Q2", "Q4")).select(*KEY, "stock_abbr", *V.ALL_FLOWS, "asset_total_assets")


Q["v3_all_flows"] = _all_flows
_more = lambda sheet: ", ".join(f"CASE WHEN (stock_code::INT + report_year) % {gap} > 0 THEN {of} * {factor} END AS {c}" for c, (s, of, factor, gap) in MORE_FLOWS.items() if s == sheet)
_pair = lambda a, b: ", ".join(f"a.{c} - b.{c} AS {c}" for c in V.ALL_FLOWS) + f" FROM w a JOIN w b USING (stock_code, report_year) WHERE a.report_period[5:6] = '{a}' AND b.report_period[5:6] = '{b}'"
O["v3_all_flows"] = f"""WITH {ORACLE_BASE}, i2 AS (SELECT *, {_more("income")} FROM income), c2 AS (SELECT *, {_more("cash")} FROM cash),
w AS (SELECT stock_code, report_period, report_year, coalesce(i.stock_abbr, k.stock_abbr) AS stock_abbr, i.* EXCLUDE (stock_code, stock_abbr, report_period, report_year, {REV}), coalesce(i.{REV}, k.{REV}) AS {REV}, k.net_profit_excl_non_recurring, c.* EXCLUDE (stock_code, stock_abbr, report_period, report_year, net_cash_flow)
    FROM i2 i JOIN kpi k USING (stock_code, report_period, report_year) JOIN c2 c USING (stock_code, report_period, report_year)),
x AS (SELECT stock_code, report_year, report_year || 'Q2' AS report_period, a.stock_abbr, {_pair("H1", "Q1")} UNION ALL SELECT stock_code, report_year, report_year || 'Q4', a.stock_abbr, {_pair("FY", "Q3")})
SELECT *, NULL::DOUBLE AS asset_total_assets FROM x WHERE coalesce({", ".join(V.ALL_FLOWS)}) IS NOT NULL"""
#: Names and factors of key figures, so that limits are reached: shares, amounts, and a name that says neither.
_stretched = {"gross_profit_margin": ("gross_profit_margin", 12), "ROE": ("roe", 2000), "net_profit_10k_yuan": ("net_profit_10k_yuan", 2e8), "net_asset_per_share": ("net_asset_per_share", 3e9), "eps": ("eps", 1e10), "经营现金流净额": ("operating_cf_per_share", 5e9), "净利率": ("net_profit_margin", 1000)}
Q["v4_clamped_by_name"] = lambda spark, d: V.clamped_by_name(sheets(spark, d)["kpi"].select(*KEY, *[(F.col(of) * by).alias(c) for c, (of, by) in _stretched.items()]))
_limits = {"gross_profit_margin": 1e3, "ROE": 1e3, "net_profit_10k_yuan": 1e8, "net_asset_per_share": 1e8, "经营现金流净额": 1e8, "净利率": 1e3}
O["v4_clamped_by_name"] = f"WITH {ORACLE_BASE} SELECT {', '.join(KEY)}, " + ", ".join((f"CASE WHEN abs({of} * {by}) <= {_limits[c]} THEN {of} * {by} END" if c in _limits else f"{of} * {by}") + f' AS "{c}"' for c, (of, by) in _stretched.items()) + " FROM kpi"
