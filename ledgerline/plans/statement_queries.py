"""Registered queries of the V, D and Q families, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import periods as D
from ..operators import shapes as S
from ..operators import view as V
from ..sources.statements import KEY, ORACLE_BASE, sheets

FLOWS = V.FLOWS
REV, NP, COST, ASSETS, LIAB, INV = "total_operating_revenue", "net_profit", "operating_expense_cost_of_sales", "asset_total_assets", "liability_total_liabilities", "asset_inventory"
_diff = lambda a, b: ", ".join(f"max(CASE WHEN report_period[5:6] = '{a}' THEN {c} END) - max(CASE WHEN report_period[5:6] = '{b}' THEN {c} END) AS {c}" for c in FLOWS)
ORACLE_VIEW = (
    ORACLE_BASE
    + f""",
v0 AS (SELECT stock_code, report_period, report_year, coalesce(i.stock_abbr, k.stock_abbr, b.stock_abbr, c.stock_abbr) AS stock_abbr,
    coalesce(i.{REV}, k.{REV}) AS {REV}, coalesce(i.net_profit, k.net_profit_10k_yuan) AS net_profit,
    i.{COST}, i.operating_expense_selling_expenses, i.operating_expense_rnd_expenses, k.{REV} AS {REV}_kpi, k.eps, k.roe, k.gross_profit_margin, k.net_profit_margin,
    b.{ASSETS}, b.{LIAB}, b.{INV}, b.equity_total_equity, c.operating_cf_net_amount, c.investing_cf_net_amount, c.financing_cf_net_amount, c.net_cash_flow
    FROM income i FULL JOIN kpi k USING (stock_code, report_period, report_year) FULL JOIN balance b USING (stock_code, report_period, report_year) FULL JOIN cash c USING (stock_code, report_period, report_year)),
d AS (SELECT stock_code, max(stock_abbr) AS stock_abbr, report_year, 'Q2' AS s, {_diff("H1", "Q1")} FROM v0 GROUP BY stock_code, report_year
    UNION ALL SELECT stock_code, max(stock_abbr), report_year, 'Q4', {_diff("FY", "Q3")} FROM v0 GROUP BY stock_code, report_year),
v1 AS (SELECT * FROM v0 UNION ALL BY NAME SELECT stock_code, stock_abbr, report_year, concat(report_year, s) AS report_period, {", ".join(FLOWS)} FROM d WHERE coalesce({", ".join(FLOWS)}) IS NOT NULL),
v AS (SELECT *, operating_expense_rnd_expenses * 100 / nullif({REV}, 0) AS rnd_expense_ratio, {COST} / nullif({INV}, 0) AS inventory_turnover_ratio FROM v1)
"""
)
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sheets(spark, sf_dir)
    return V.wide(*[s[n] for n in ("income", "kpi", "balance", "cash")])


def _on_view(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    Q[name] = lambda spark, d: f(view(spark, d))
    O[name] = f"WITH {ORACLE_VIEW} {sql}"


def _on_sheets(name: str, f: Callable[[dict[str, DataFrame]], DataFrame], sql: str) -> None:
    Q[name] = lambda spark, d: f(sheets(spark, d))
    O[name] = f"WITH {ORACLE_BASE} {sql}"


W, P, P0 = "stock_code, stock_abbr", "1997Q3", "1996Q3"
VIEW_COLUMNS = [*KEY, "stock_abbr", REV, NP, COST, "rnd_expense_ratio", "inventory_turnover_ratio", ASSETS, "operating_cf_net_amount", "net_cash_flow"]
_on_view("v1_wide_view", lambda v: v.select(*VIEW_COLUMNS), f"SELECT {', '.join(VIEW_COLUMNS)} FROM v")
_on_view("v4_clamped_view", lambda v: V.clamped(v).select(*KEY, REV, "gross_profit_margin", "rnd_expense_ratio"), f"SELECT {', '.join(KEY)}, CASE WHEN abs({REV}) <= 1e8 THEN {REV} END AS {REV}, CASE WHEN abs(gross_profit_margin) <= 1000 THEN gross_profit_margin END AS gross_profit_margin, CASE WHEN abs(rnd_expense_ratio) <= 1000 THEN rnd_expense_ratio END AS rnd_expense_ratio FROM v")
_on_view("v3_derived_quarters", lambda v: v.where(F.substring("report_period", 5, 2).isin("Q2", "Q4")).select(*KEY, *FLOWS), f"SELECT {', '.join(KEY)}, {', '.join(FLOWS)} FROM v WHERE report_period[5:6] IN ('Q2', 'Q4')")
_on_sheets(
    "v2_spine_view",
    lambda s: V.spine(s["income"], s["kpi"], s["balance"], s["cash"]).where(~F.substring("report_period", 5, 2).isin("Q2", "Q4")).select(*KEY, "stock_abbr", "revenue", "eps", "total_assets", "operating_cf", "selling_to_inventory_ratio"),
    f", keys AS (SELECT stock_code, stock_abbr, report_period, report_year FROM income UNION SELECT stock_code, stock_abbr, report_period, report_year FROM kpi UNION SELECT stock_code, stock_abbr, report_period, report_year FROM balance UNION SELECT stock_code, stock_abbr, report_period, report_year FROM cash) SELECT stock_code, report_period, report_year, k.stock_abbr, i.{REV} AS revenue, p.eps, b.{ASSETS} AS total_assets, c.operating_cf_net_amount AS operating_cf, i.operating_expense_selling_expenses / nullif(b.{INV}, 0) AS selling_to_inventory_ratio FROM keys k LEFT JOIN income i USING (stock_code, report_period, report_year) LEFT JOIN kpi p USING (stock_code, report_period, report_year) LEFT JOIN balance b USING (stock_code, report_period, report_year) LEFT JOIN cash c USING (stock_code, report_period, report_year)",
)
_on_sheets(
    "v5_one_per_key",
    lambda s: V.one_per_key(s["kpi"].select(*KEY, "stock_abbr", REV, "roe").unionByName(s["kpi"].select(*KEY, "stock_abbr", (F.col(REV) * 2).alias(REV), (F.col("roe") + 1).alias("roe"))), ["stock_abbr"]),
    f", u AS (SELECT stock_code, report_period, report_year, stock_abbr, {REV}, roe FROM kpi UNION ALL SELECT stock_code, report_period, report_year, stock_abbr, {REV} * 2, roe + 1 FROM kpi) SELECT stock_code, report_period, report_year, min(stock_abbr) AS stock_abbr, arg_max({REV}, abs({REV})) AS {REV}, median(roe) AS roe FROM u GROUP BY ALL",
)
_on_sheets("v6_extended_view", lambda s: V.extended(s["income"].select(*KEY, REV), s["balance"]), f"SELECT stock_code, report_period, report_year, i.{REV}, liability_contract_liabilities AS contract_liabilities FROM income i LEFT JOIN balance b USING (stock_code, report_period, report_year)")

# D: derivation and periods
_on_sheets("d3_balance_derivation", lambda s: D.derive_balance(s["balance"]).select(*KEY, "liability_contract_liabilities", "equity_total_equity", "asset_liability_ratio"), f"SELECT stock_code, report_period, report_year, coalesce(liability_contract_liabilities, liability_advance_from_customers) AS liability_contract_liabilities, CASE WHEN equity_total_equity IS NULL OR abs(equity_total_equity - ({ASSETS} - {LIAB})) > greatest(100, abs({ASSETS}) * 0.02) THEN {ASSETS} - {LIAB} ELSE equity_total_equity END AS equity_total_equity, {LIAB} * 100 / nullif({ASSETS}, 0) AS asset_liability_ratio FROM balance")
_cf = """, n AS (SELECT * REPLACE (coalesce(net_cash_flow, operating_cf_net_amount + investing_cf_net_amount + financing_cf_net_amount) AS net_cash_flow) FROM cash),
o AS (SELECT * REPLACE (coalesce(operating_cf_net_amount, net_cash_flow - investing_cf_net_amount - financing_cf_net_amount) AS operating_cf_net_amount) FROM n),
i AS (SELECT * REPLACE (coalesce(investing_cf_net_amount, net_cash_flow - operating_cf_net_amount - financing_cf_net_amount) AS investing_cf_net_amount) FROM o),
f AS (SELECT * REPLACE (coalesce(financing_cf_net_amount, net_cash_flow - operating_cf_net_amount - investing_cf_net_amount) AS financing_cf_net_amount) FROM i)"""
_on_sheets("d4_cash_imputation", lambda s: D.impute_cash(s["cash"]).drop("stock_abbr"), _cf + " SELECT * EXCLUDE (stock_abbr), " + ", ".join(f"{x}_cf_net_amount * 100 / nullif(net_cash_flow, 0) AS {x}_cf_ratio_of_net_cf" for x in ("operating", "investing", "financing")) + " FROM f")
_parts = ("operating", "investing", "financing")
_sum = " + ".join(f"{x}_cf_net_amount" for x in _parts)
_big = "greatest(" + ", ".join(f"abs({x}_cf_net_amount)" for x in _parts) + f", abs({_sum}))"
_fixed = f", w AS (SELECT *, ({_sum}) IS NOT NULL AND (net_cash_flow IS NULL OR (abs(net_cash_flow) <= 1e-3 AND {_big} >= 100) OR (abs(net_cash_flow) <= 1 AND {_big} >= 10000)) AS swap FROM cash2), x AS (SELECT * REPLACE (CASE WHEN swap THEN {_sum} ELSE net_cash_flow END AS net_cash_flow) FROM w)"
_ratio = lambda x: f"CASE WHEN net_cash_flow IS NULL OR net_cash_flow = 0 OR {x}_cf_net_amount IS NULL THEN {x}_cf_ratio_of_net_cf WHEN swap OR {x}_cf_ratio_of_net_cf IS NULL OR abs({x}_cf_ratio_of_net_cf) > 1000 OR abs({x}_cf_ratio_of_net_cf - {x}_cf_net_amount / net_cash_flow * 100) > greatest(10, abs({x}_cf_net_amount / net_cash_flow * 100) * 0.2) THEN {x}_cf_net_amount / net_cash_flow * 100 ELSE {x}_cf_ratio_of_net_cf END AS {x}_cf_ratio_of_net_cf"
_on_sheets("d14_cash_repair", lambda s: D.repair_cash(s["cash2"]).select(*KEY, "net_cash_flow", *[f"{x}_cf_ratio_of_net_cf" for x in _parts]), f"{_fixed} SELECT stock_code, report_period, report_year, net_cash_flow, {', '.join(map(_ratio, _parts))} FROM x")


def _d7(s: dict[str, DataFrame]) -> DataFrame:
    x = s["income"].join(s["kpi"].select(*KEY, F.col(REV).alias("kr"), "net_profit_10k_yuan"), KEY)
    return x.select(*KEY, D.plausible_revenue(F.col(REV), F.col("kr"), F.col(COST), F.col("net_profit_10k_yuan")).alias("revenue"))


_bad = lambda r: f"(CASE WHEN ({r} - {COST}) * 100 / nullif({r}, 0) BETWEEN -100 AND 100 THEN 0 ELSE 1 END + CASE WHEN np * 100 / nullif({r}, 0) BETWEEN -100 AND 100 THEN 0 ELSE 1 END + CASE WHEN {r} = 0 THEN 1 ELSE 0 END)"
_on_sheets("d7_plausible_revenue", _d7, f", x AS (SELECT stock_code, report_period, report_year, i.{REV} AS r, k.{REV} AS kr, {COST}, k.net_profit_10k_yuan AS np FROM income i JOIN kpi k USING (stock_code, report_period, report_year)) SELECT stock_code, report_period, report_year, CASE WHEN r IS NULL THEN kr WHEN kr IS NULL THEN r WHEN {_bad('r')} < {_bad('kr')} OR ({_bad('r')} = {_bad('kr')} AND abs(r) >= abs(kr)) THEN r ELSE kr END AS revenue FROM x")
_on_sheets("d8_sanitation", lambda s: D.sanitize(s["kpi"]).select(*KEY, "gross_profit_margin", "eps", "net_asset_per_share", "roe"), "SELECT stock_code, report_period, report_year, CASE WHEN abs(gross_profit_margin) <= 1000 THEN gross_profit_margin END AS gross_profit_margin, CASE WHEN abs(eps) <= 20 THEN eps END AS eps, CASE WHEN abs(net_asset_per_share) <= 200 THEN net_asset_per_share END AS net_asset_per_share, CASE WHEN abs(roe) <= 1000 THEN roe END AS roe FROM kpi")
_sq = f""", y AS (SELECT stock_code, report_year, {", ".join(f"max(CASE WHEN report_period[5:6] = '{s}' THEN {REV} END) AS p{s}" for s in ("Q1", "H1", "Q3", "FY"))} FROM income GROUP BY ALL),
s AS (SELECT stock_code, report_year, pQ1 AS q1, pH1 - pQ1 AS q2, pQ3 - pH1 AS q3, pFY - pQ3 AS q4 FROM y),
l AS (SELECT stock_code, report_year, 0 AS ord, 'Q1' AS x, q1 AS single FROM s UNION ALL SELECT stock_code, report_year, 1, 'H1', q2 FROM s UNION ALL SELECT stock_code, report_year, 2, 'Q3', q3 FROM s UNION ALL SELECT stock_code, report_year, 3, 'FY', q4 FROM s)"""
_on_sheets("d9_single_quarters", lambda s: D.single_quarters(s["income"], REV), _sq + " SELECT * FROM s")
_on_sheets("d10_qoq", lambda s: D.qoq(s["income"], REV), _sq + ", z AS (SELECT l.*, concat(report_year, x) AS report_period FROM l), h AS (SELECT z.*, last_value(single IGNORE NULLS) OVER (PARTITION BY stock_code, report_year ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM z SEMI JOIN income i ON z.stock_code = i.stock_code AND z.report_period = i.report_period) SELECT stock_code, report_period, report_year, single, CASE WHEN ord > 0 THEN (single - b) * 100 / nullif(abs(b), 0) END AS qoq FROM h")
_on_sheets("d11_first_quarter_qoq", lambda s: D.first_quarter_qoq(s["income"], REV), _sq + " SELECT a.stock_code, a.report_year, (a.q1 - b.q4) * 100 / nullif(abs(b.q4), 0) AS qoq FROM s a JOIN s b ON a.stock_code = b.stock_code AND a.report_year = b.report_year + 1 WHERE a.q1 IS NOT NULL AND b.q4 IS NOT NULL")
_on_sheets("d12_yoy", lambda s: D.yoy(s["income"], REV), f"SELECT stock_code, report_period, report_year, ({REV} - b) * 100 / nullif(abs(b), 0) AS yoy FROM (SELECT *, last_value({REV} IGNORE NULLS) OVER (PARTITION BY stock_code, report_period[5:6] ORDER BY report_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM income)")
_on_sheets("d13_resolved_metrics", lambda s: D.resolved(s["kpi"], s["income"]).select(*KEY, REV, "net_profit_10k_yuan"), f"SELECT stock_code, report_period, report_year, coalesce(k.{REV}, i.{REV}) AS {REV}, coalesce(k.net_profit_10k_yuan, i.net_profit) AS net_profit_10k_yuan FROM kpi k LEFT JOIN income i USING (stock_code, report_period, report_year)")


def _d2(s: dict[str, DataFrame]) -> DataFrame:
    methods = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(("pdfplumber.combined_pages", "camelot.stream[0]", "fitz.combined_text"))])
    x = s["income"].withColumn("x", F.explode(methods)).withColumn("k", F.col("stock_code").cast("int"))
    value = lambda c, j: F.when((F.col("k") + F.col("report_year") + F.col("x.i") * j) % 3 != 0, F.col(c) + F.col("x.i")).alias(c)
    rows = x.select(*KEY, F.col("x.m").alias("source_method"), value(REV, 1), value("net_profit", 2))
    return D.consolidate(rows, [REV, "net_profit"])


_on_sheets(
    "d2_consolidation",
    _d2,
    f""", m AS (SELECT * FROM (VALUES (0, 'pdfplumber.combined_pages', -4), (1, 'camelot.stream[0]', -3), (2, 'fitz.combined_text', -1)) AS t(i, m, r)),
c AS (SELECT stock_code, report_period, report_year, m, r, CASE WHEN (CAST(stock_code AS INT) + report_year + i) % 3 <> 0 THEN {REV} + i END AS a, CASE WHEN (CAST(stock_code AS INT) + report_year + i * 2) % 3 <> 0 THEN net_profit + i END AS b FROM income, m)
SELECT stock_code, report_period, report_year, first(a ORDER BY r, m) FILTER (WHERE a IS NOT NULL) AS {REV}, first(b ORDER BY r, m) FILTER (WHERE b IS NOT NULL) AS net_profit, string_agg(m, ';' ORDER BY r, m) AS sources FROM c GROUP BY stock_code, report_period, report_year""",
)

# Q: shapes on the view
_p = f"report_period = '{P}'"
_on_view("q1_point_lookup", lambda v: S.lookup(v, "000003", P, [REV, NP]), f"SELECT {W}, report_period, {REV}, {NP} FROM v WHERE stock_code = '000003' AND {_p}")
_on_view("q2_median_and_mean", lambda v: S.above_median_below_mean(v, P, REV, COST), f", one AS (SELECT * FROM v WHERE {_p}) SELECT {W}, {REV}, {COST} FROM one WHERE {REV} > (SELECT median({REV}) FROM one) AND {COST} < (SELECT avg({COST}) FROM one)")
_three = ["1995Q3", "1996Q3", "1997Q3"]
_in3 = "report_period IN ('1995Q3', '1996Q3', '1997Q3')"
_on_view("q3_consecutive_above", lambda v: S.consecutive_above(v, _three, [REV, NP], [10.0, -5.0]), f"SELECT {W}, report_period, {REV}, {NP} FROM v WHERE {_in3} AND stock_code IN (SELECT stock_code FROM v WHERE {_in3} AND {REV} > 10 AND {NP} > -5 GROUP BY 1 HAVING count(DISTINCT report_period) = 3)")
_on_view("q4_always_positive", lambda v: S.always_positive(v, _three, NP), f"SELECT {W}, min({NP}) AS least FROM v WHERE {_in3} GROUP BY ALL HAVING count(*) = 3 AND min({NP}) > 0")
_cagr = f", c AS (SELECT {W}, max(CASE WHEN report_period = '1995Q3' THEN {REV} END) AS a, max(CASE WHEN report_period = '1998Q3' THEN {REV} END) AS b FROM v GROUP BY {W}), g AS (SELECT {W}, (pow(b / a, 1.0 / 3) - 1) * 100 AS cagr FROM c WHERE a > 0 AND b > 0)"
_on_view("q5_cagr", lambda v: S.cagr(v, "1995Q3", "1998Q3", 3, REV), _cagr + " SELECT * FROM g")
_on_view("q6_cagr_histogram", lambda v: S.cagr_histogram(v, "1995Q3", "1998Q3", 3, REV), _cagr + " SELECT (floor(cagr / 10) * 10)::BIGINT AS bin, count(*) AS companies FROM g WHERE (SELECT count(*) FROM g) >= 2 GROUP BY 1")
_on_view("q7_count_companies", lambda v: S.count_companies(v, P, F.col(NP) > 0), f"SELECT count(DISTINCT stock_code) AS companies FROM v WHERE {_p} AND {NP} > 0")
_on_view("q8_screen", lambda v: S.screen(v, P, [F.col(REV) > 50, F.col(NP) < 0], [REV, NP]), f"SELECT {W}, {REV}, {NP} FROM v WHERE {_p} AND {REV} > 50 AND {NP} < 0")
_on_view("q9_cumulative_qoq", lambda v: S.cumulative_qoq(v, 1997, REV), f", x AS (SELECT {W}, max(CASE WHEN report_period = '1997Q1' THEN {REV} END) AS a, max(CASE WHEN report_period = '1997H1' THEN {REV} END) AS b, max(CASE WHEN {_p} THEN {REV} END) AS c FROM v GROUP BY {W}) SELECT {W}, b - a AS q2, c - b AS third, ((c - b) - (b - a)) * 100 / nullif(abs(b - a), 0) AS growth FROM x WHERE b - a IS NOT NULL AND c - b IS NOT NULL")
_on_view("q10_two_period_growth", lambda v: S.two_period_growth(v, P0, P, REV), f"SELECT b.stock_code, b.stock_abbr, a.{REV} AS before, b.{REV} AS now, (b.{REV} - a.{REV}) * 100 / abs(a.{REV}) AS growth FROM v b JOIN v a ON a.stock_code = b.stock_code AND a.report_period = '{P0}' WHERE b.{_p} AND a.{REV} <> 0 AND b.{REV} IS NOT NULL")
_top = lambda m, n=10, p=P, d="DESC": f"(SELECT * FROM v WHERE report_period = '{p}' AND {m} IS NOT NULL ORDER BY {m} {d}, stock_code LIMIT {n})"
_rk = lambda m, r, n=10, p=P: f"(SELECT {W}, {m}, row_number() OVER (ORDER BY {m} DESC, stock_code)::INT AS {r} FROM {_top(m, n, p)})"
_on_view("q11_top_of_both", lambda v: S.top_of_both(v, P, REV, NP, 20), f"SELECT a.stock_code, a.stock_abbr, {REV}, rank_a, {NP}, rank_b FROM {_rk(REV, 'rank_a', 20)} a JOIN {_rk(NP, 'rank_b', 20)} b ON a.stock_code = b.stock_code")
_on_view("q12_average_change", lambda v: S.average_change(v, P0, P, REV), f", x AS (SELECT avg(CASE WHEN report_period = '{P0}' THEN {REV} END) AS mean_before, avg(CASE WHEN {_p} THEN {REV} END) AS mean_now FROM v) SELECT mean_before, mean_now, (mean_now - mean_before) * 100 / abs(mean_before) AS growth FROM x")
_on_view("q13_below_first_mean", lambda v: S.below_first_mean(v, P, REV), f", f AS (SELECT {W}, {REV} FROM v WHERE {_p} ORDER BY stock_code LIMIT 10), g AS (SELECT *, avg({REV}) OVER () AS mean FROM f) SELECT * FROM g WHERE {REV} < mean")
_on_view("q14_largest_growth", lambda v: S.largest_growth(v, P0, P, ASSETS), f", x AS (SELECT {W}, max(CASE WHEN report_period = '{P0}' THEN {ASSETS} END) AS before, max(CASE WHEN {_p} THEN {ASSETS} END) AS now FROM v GROUP BY {W}) SELECT *, now - before AS change FROM x WHERE now - before IS NOT NULL ORDER BY change DESC, stock_code LIMIT 1")
_on_view("q15_top_with_status", lambda v: S.top_with_status(v, P, REV), f"SELECT {W}, {REV}, avg({REV}) OVER () AS mean, CASE WHEN {REV} > 2 * avg({REV}) OVER () THEN 'abnormal' ELSE 'normal' END AS status FROM {_top(REV)}")
_on_view("q16_top_n", lambda v: S.top(v, P, REV, 10, [REV]), f"SELECT {W}, {REV} FROM {_top(REV)}")
_on_view("q17_top_absolute", lambda v: S.top(v, P, F.abs(F.col(REV) - F.col(COST)), 10, [REV, COST]), f"SELECT {W}, {REV}, {COST} FROM {_top(f'abs({REV} - {COST})')}")
_on_view("q18_top_then_lookup", lambda v: S.top_then_lookup(v, P, P0, REV), f"SELECT t.stock_code, t.stock_abbr, t.{REV}, o.{REV} AS other, t.{REV} / nullif(o.{REV}, 0) AS ratio FROM {_top(REV)} t LEFT JOIN v o ON o.stock_code = t.stock_code AND o.report_period = '{P0}'")
_on_view("q19_above_industry_ratio", lambda v: S.above_industry_ratio(v, P, COST, REV), f", x AS (SELECT {W}, {COST} / nullif({REV}, 0) AS ratio FROM v WHERE {_p}), m AS (SELECT avg(ratio) AS mean FROM x) SELECT * FROM x, m WHERE ratio > mean")
_on_view("q20_bucket_counts", lambda v: S.bucket_counts(v, P, REV, [20.0, 50.0, 80.0]), f"SELECT ({REV} >= 20)::INT + ({REV} >= 50)::INT + ({REV} >= 80)::INT AS bucket, count(*) AS companies FROM v WHERE {_p} AND {REV} IS NOT NULL GROUP BY 1")
_on_view("q21_sign_groups", lambda v: S.sign_groups(v, P, NP), f"SELECT CASE WHEN {NP} > 0 THEN 'gain' WHEN {NP} < 0 THEN 'loss' ELSE 'zero' END AS sign, count(*) AS companies, avg({NP}) AS mean FROM v WHERE {_p} AND {NP} IS NOT NULL GROUP BY 1")
_on_view("q22_around_average", lambda v: S.around_average(v, P, REV, NP), f", x AS (SELECT * FROM v WHERE {_p} AND {REV} IS NOT NULL) SELECT CASE WHEN {REV} > (SELECT avg({REV}) FROM x) THEN 'above' ELSE 'below' END AS side, count(*) AS companies, avg({NP}) AS mean_other FROM x GROUP BY 1")
_on_view("q23_trend", lambda v: S.trend(v, REV), f"SELECT report_period, avg({REV}) AS mean, count({REV}) AS companies FROM v GROUP BY 1")
_on_view("q24_both_ends", lambda v: S.both_ends(v, P, NP), f"SELECT {W}, {NP}, 'top' AS side FROM {_top(NP)} UNION ALL SELECT {W}, {NP}, 'bottom' FROM {_top(NP, d='ASC')}")
_on_view("q25_top_by_period", lambda v: S.top_by_period(v, [P0, P], REV), f"SELECT *, '{P0}' AS report_period FROM {_rk(REV, 'rank', 10, P0)} UNION ALL SELECT *, '{P}' FROM {_rk(REV, 'rank')}")
_on_view("q26_rank_changes", lambda v: S.rank_changes(v, P0, P, REV), f", r AS (SELECT {W}, report_period, row_number() OVER (PARTITION BY report_period ORDER BY {REV} DESC, stock_code)::INT AS place FROM v WHERE report_period IN ('{P0}', '{P}') AND {REV} IS NOT NULL), x AS (SELECT {W}, max(CASE WHEN report_period = '{P0}' THEN place END) AS before, max(CASE WHEN {_p} THEN place END) AS now FROM r GROUP BY {W}) SELECT *, before - now AS change FROM x WHERE before - now IS NOT NULL ORDER BY abs(change) DESC, stock_code LIMIT 10")
_on_view("q27_cohort_mean", lambda v: S.cohort_mean(v, P, F.col(NP) > 0, REV), f"SELECT {W}, {REV}, avg({REV}) OVER () AS mean FROM v WHERE {_p} AND {NP} > 0")
_on_view("q28_lag_growth", lambda v: S.lag_growth(v, "Q3", REV), f"SELECT stock_code, report_period, {REV}, ({REV} - b) * 100 / nullif(abs(b), 0) AS growth FROM (SELECT *, lag({REV}) OVER (PARTITION BY stock_code ORDER BY report_year) AS b FROM v WHERE report_period LIKE '%Q3')")
_on_view("q29_series", lambda v: S.series(v, "000003", REV), f"SELECT stock_code, report_period, {REV}, row_number() OVER (ORDER BY report_year, list_position(['Q1', 'Q2', 'H1', 'Q3', 'Q4', 'FY'], report_period[5:6]))::INT AS place FROM v WHERE stock_code = '000003'")
_on_view("q30_cohort_ratio", lambda v: S.cohort_ratio(v, P, REV, COST), f"SELECT sum({REV}::DECIMAL(28,6))::DOUBLE / sum({COST}::DECIMAL(28,6))::DOUBLE AS ratio FROM {_top(REV)}")
_on_view("q31_row_ratio", lambda v: S.row_ratio(v, P, COST, INV), f"SELECT {W}, {COST} / nullif({INV}, 0) AS ratio FROM v WHERE {_p}")
_on_view("q32_top_below_mean", lambda v: S.top_below_mean(v, P, ASSETS, NP), f"SELECT {W}, {ASSETS}, {NP}, m.mean, CASE WHEN {NP} < m.mean THEN 'below' ELSE 'not below' END AS side FROM {_top(ASSETS, 5)} t, (SELECT avg({NP}) AS mean FROM v WHERE {_p}) m")
_on_view("q33_ever_negative", lambda v: S.ever_negative(v, NP), f"SELECT DISTINCT {W}, report_period FROM v WHERE {NP} < 0")
_on_view("q34_named_like", lambda v: S.named_like(v, "%7", P, REV), f"SELECT {W}, {REV} FROM v WHERE {_p} AND stock_abbr LIKE '%7'")
_on_view("q35_averages", lambda v: S.averages(v, P, [REV, NP, ASSETS]), f"SELECT avg({REV}) AS mean_{REV}, avg({NP}) AS mean_{NP}, avg({ASSETS}) AS mean_{ASSETS} FROM v WHERE {_p}")
_on_view("q36_coverage", lambda v: S.coverage(v, _three), f", r AS (SELECT DISTINCT stock_code, report_period FROM v WHERE {_in3}) SELECT report_period, count(*) AS companies FROM r GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM (SELECT stock_code FROM r GROUP BY 1 HAVING count(*) = 3)")
_on_view("q36_available_periods", S.available_periods, ", r AS (SELECT *, row_number() OVER (PARTITION BY stock_code ORDER BY report_year DESC, list_position(['Q1', 'Q2', 'H1', 'Q3', 'Q4', 'FY'], report_period[5:6]) DESC) AS n FROM v) SELECT stock_code, string_agg(report_period, ',' ORDER BY n) AS periods FROM r WHERE n <= 8 GROUP BY 1")
_on_view("q37_relevant_rows", lambda v: S.relevant(v, [INV, "eps"]).select(*KEY, INV, "eps"), f"SELECT stock_code, report_period, report_year, {INV}, eps FROM v WHERE coalesce({INV}, eps) IS NOT NULL")
_on_view("q38_validation", lambda v: S.validation(v, ["gross_profit_margin"], [REV, NP]), f"SELECT count(*) AS n_rows, count(DISTINCT report_period) AS n_periods, count(*) FILTER (WHERE NOT regexp_matches(report_period, '^[0-9]{{4}}(Q1|Q2|H1|Q3|Q4|FY)$')) AS odd_periods, bool_and(greatest(abs(coalesce({REV}, 0)), abs(coalesce({NP}, 0))) = 0) AS all_zero, quantile_cont(abs(gross_profit_margin), 0.9) > 1000 AS gross_profit_margin_too_large FROM v")
_on_view("q39_without_flat_growth", lambda v: S.without_flat_growth(v.select(*KEY, F.lit(0.0).alias("revenue_growth"), (F.col(NP) * 0 + 1).alias("profit_yoy"))), f"SELECT stock_code, report_period, report_year, {NP} * 0 + 1 AS profit_yoy FROM v")
