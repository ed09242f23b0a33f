"""Registered queries of the R, E and M families, with their DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.statements import KEY
from .statement_queries import ASSETS, COST, LIAB, NP, ORACLE_BASE, REV, _on_sheets, _on_view, _p, P

K = "stock_code, report_period, report_year"
_r = f"""(CASE WHEN i.{REV} IS NULL THEN k.{REV} WHEN k.{REV} IS NULL THEN i.{REV}
  WHEN bi < bk OR (bi = bk AND abs(i.{REV}) >= abs(k.{REV})) THEN i.{REV} ELSE k.{REV} END)"""
_b = lambda r: f"(CASE WHEN ({r} - i.{COST}) * 100 / nullif({r}, 0) BETWEEN -100 AND 100 THEN 0 ELSE 1 END + CASE WHEN i.{NP} * 100 / nullif({r}, 0) BETWEEN -100 AND 100 THEN 0 ELSE 1 END)"
# single quarters of a figure at each period (a gap resets), and their growth over the quarter just before
_growth = lambda c, n: f"""w{n} AS (SELECT stock_code, report_year, max(CASE WHEN report_period LIKE '%Q1' THEN {c} END) AS a1, max(CASE WHEN report_period LIKE '%H1' THEN {c} END) AS a2, max(CASE WHEN report_period LIKE '%Q3' THEN {c} END) AS a3, max(CASE WHEN report_period LIKE '%FY' THEN {c} END) AS a4 FROM income GROUP BY ALL),
u{n} AS (SELECT stock_code, report_year, 'Q1' AS sfx, report_year * 4 AS at, a1 AS x FROM w{n} UNION ALL SELECT stock_code, report_year, 'H1', report_year * 4 + 1, a2 - a1 FROM w{n} UNION ALL SELECT stock_code, report_year, 'Q3', report_year * 4 + 2, a3 - a2 FROM w{n} UNION ALL SELECT stock_code, report_year, 'FY', report_year * 4 + 3, a4 - a3 FROM w{n}),
g{n} AS (SELECT n.stock_code, n.report_year, concat(n.report_year, n.sfx) AS report_period, (n.x - b.x) * 100 / nullif(abs(b.x), 0) AS y FROM u{n} n JOIN u{n} b ON n.stock_code = b.stock_code AND n.at = b.at + 1)"""  # noqa: E731
_rules = f""", j AS (SELECT {K}, i.{COST} AS cost, i.{NP} AS np, k.eps, k.roe, k.gross_profit_margin AS gpm, k.net_profit_margin AS npm, k.net_asset_per_share AS nav, k.operating_cf_per_share AS ocps,
  b.{ASSETS} AS a, b.{LIAB} AS l, b.equity_total_equity AS e, c.operating_cf_net_amount AS o, c.investing_cf_net_amount AS v, c.financing_cf_net_amount AS f, c.net_cash_flow AS n, c.operating_cf_ratio_of_net_cf AS ro, c.investing_cf_ratio_of_net_cf AS ri, c.financing_cf_ratio_of_net_cf AS rf, b.asset_liability_ratio AS al, {_b(f'i.{REV}')} AS bi, {_b(f'k.{REV}')} AS bk, {_r} AS r
  FROM income i FULL JOIN kpi k USING ({K}) FULL JOIN balance2 b USING ({K}) FULL JOIN cash2 c USING ({K})),
s AS (SELECT *, CASE WHEN np * 10000 / nullif(eps, 0) BETWEEN 1e6 AND 1e12 THEN np * 10000 / nullif(eps, 0) END AS sh, np * 100 / nullif(e, 0) AS xroe FROM j),
{_growth(REV, 'r')}, {_growth(NP, 'p')},
gy AS (SELECT {K}, (x - b) * 100 / nullif(abs(b), 0) AS y FROM (SELECT {K}, net_profit_excl_non_recurring AS x, last_value(net_profit_excl_non_recurring IGNORE NULLS) OVER (PARTITION BY stock_code, report_period[5:6] ORDER BY report_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM kpi)),
d AS (SELECT {K}, unnest([
  {{'rule': 'balance_equation', 'x': l + e, 'y': a, 't': 1.0, 'u': 0.02, 's': 'near'}}, {{'rule': 'cash_flow_equation', 'x': n, 'y': o + v + f, 't': 1.0, 'u': 0.03, 's': 'near'}},
  {{'rule': 'gross_profit_margin_consistency', 'x': gpm, 'y': (r - cost) * 100 / nullif(r, 0), 't': 3.0, 'u': 0.08, 's': 'near'}}, {{'rule': 'net_profit_margin_consistency', 'x': npm, 'y': np * 100 / nullif(r, 0), 't': 3.0, 'u': 0.08, 's': 'near'}},
  {{'rule': 'margin_order_consistency', 'x': npm, 'y': gpm, 't': 20.0, 'u': 0.0, 's': 'upper'}}, {{'rule': 'eps_net_profit_sign_consistency', 'x': CASE WHEN eps <> 0 AND np <> 0 THEN eps END, 'y': np, 't': 0.0, 'u': 0.0, 's': 'sign'}},
  {{'rule': 'roe_consistency', 'x': CASE WHEN report_period LIKE '%FY' AND e > 0 AND abs(roe) <= 100 AND abs(xroe) <= 100 AND roe * xroe > 0 THEN roe END, 'y': xroe, 't': 8.0, 'u': 0.8, 's': 'near'}},
  {{'rule': 'net_asset_per_share_consistency', 'x': nav, 'y': e * 10000 / sh, 't': 0.2, 'u': 0.08, 's': 'near'}}, {{'rule': 'operating_cf_per_share_consistency', 'x': ocps, 'y': o * 10000 / sh, 't': 0.2, 'u': 0.08, 's': 'near'}},
  {{'rule': 'operating_cf_ratio_consistency', 'x': ro, 'y': o * 100 / nullif(n, 0), 't': 2.0, 'u': 0.05, 's': 'near'}}, {{'rule': 'investing_cf_ratio_consistency', 'x': ri, 'y': v * 100 / nullif(n, 0), 't': 2.0, 'u': 0.05, 's': 'near'}},
  {{'rule': 'financing_cf_ratio_consistency', 'x': rf, 'y': f * 100 / nullif(n, 0), 't': 2.0, 'u': 0.05, 's': 'near'}}, {{'rule': 'asset_liability_ratio_consistency', 'x': al, 'y': l * 100 / nullif(a, 0), 't': 1.0, 'u': 0.02, 's': 'near'}}], recursive := true) FROM s
  UNION ALL SELECT {K}, 'operating_revenue_qoq_consistency', operating_revenue_qoq_growth, y, 5.0, 0.15, 'near' FROM kpi2 JOIN gr USING ({K})
  UNION ALL SELECT {K}, 'net_profit_qoq_consistency', net_profit_qoq_growth, y, 5.0, 0.15, 'near' FROM kpi2 JOIN gp USING ({K})
  UNION ALL SELECT {K}, 'net_profit_excl_non_recurring_yoy_consistency', net_profit_excl_non_recurring_yoy, y, 5.0, 0.15, 'near' FROM kpi2 JOIN gy USING ({K})),
det AS (SELECT {K}, rule, x AS actual, y AS expected, abs(x - y) AS difference, CASE s WHEN 'upper' THEN x <= y + t WHEN 'sign' THEN x * y > 0 ELSE abs(x - y) <= t OR abs(x - y) / greatest(abs(y), 1.0) <= u END AS passed FROM d WHERE x IS NOT NULL AND y IS NOT NULL),
sm AS (SELECT rule, count(*) AS applicable, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed FROM det GROUP BY 1)"""
detail = lambda s: R.accounting_rules(s["income"], s["kpi2"], s["balance2"], s["cash2"])
_on_sheets("r1_r13_rule_detail", detail, _rules + " SELECT * FROM det")
_on_sheets("e12_rule_summary", lambda s: R.rule_summary(detail(s)), _rules + " SELECT *, round(passed / applicable, 4) AS pass_rate FROM sm")
_on_sheets("e12_overall", lambda s: R.overall(R.rule_summary(detail(s))), _rules + " SELECT count(*) AS rules, sum(applicable)::BIGINT AS applicable, sum(passed)::BIGINT AS passed, sum(failed)::BIGINT AS failed FROM sm")
_on_sheets("r17_required_fields", lambda s: R.required_fields(s["income"], ["stock_code", "stock_abbr", REV]), f"SELECT {K}, '{REV}' AS missing FROM income WHERE {REV} IS NULL")
_on_sheets("r18_duplicate_keys", lambda s: R.duplicate_keys(s["income"].unionByName(s["income"].where("report_year = 1995"))), f"SELECT {K}, count(*) AS n FROM (SELECT * FROM income UNION ALL SELECT * FROM income WHERE report_year = 1995) GROUP BY ALL HAVING count(*) > 1")
_on_sheets(
    "r20_r24_prechecks",
    lambda s: R.prechecks(s["income"], s["kpi"], s["balance2"], s["cash2"]),
    f""", x AS (SELECT {K}, b.{ASSETS} AS a, b.{LIAB} AS l, b.equity_total_equity AS e, c.net_cash_flow AS n, c.operating_cf_net_amount + c.investing_cf_net_amount + c.financing_cf_net_amount AS fl, i.{REV} AS r, i.{COST} AS cost, i.{NP} AS np, k.gross_profit_margin AS g, k.net_profit_margin AS m, b.asset_liability_ratio AS al, c.operating_cf_net_amount AS o, c.investing_cf_net_amount AS v, c.financing_cf_net_amount AS fi, c.operating_cf_ratio_of_net_cf AS ro, c.investing_cf_ratio_of_net_cf AS ri, c.financing_cf_ratio_of_net_cf AS rf
FROM balance2 b FULL JOIN cash2 c USING ({K}) FULL JOIN income i USING ({K}) FULL JOIN kpi k USING ({K}))
SELECT {K}, 'balance_equation_precheck' AS rule FROM x WHERE abs(l + e - a) > greatest(100, abs(a) * 0.02) UNION ALL SELECT {K}, 'cash_flow_equation_precheck' FROM x WHERE abs(n - fl) > greatest(100, abs(n) * 0.05)
UNION ALL SELECT {K}, 'gross_profit_margin_consistency_precheck' FROM x WHERE abs(g - (r - cost) * 100 / nullif(r, 0)) > 5 UNION ALL SELECT {K}, 'net_profit_margin_consistency_precheck' FROM x WHERE abs(m - np * 100 / nullif(r, 0)) > 5
UNION ALL SELECT {K}, 'asset_liability_ratio_consistency' FROM x WHERE abs(l / nullif(a, 0) * 100 - al) > 5 UNION ALL SELECT {K}, 'operating_cf_ratio_of_net_cf_consistency_precheck' FROM x WHERE abs(o / nullif(n, 0) * 100 - ro) > 10
UNION ALL SELECT {K}, 'investing_cf_ratio_of_net_cf_consistency_precheck' FROM x WHERE abs(v / nullif(n, 0) * 100 - ri) > 10 UNION ALL SELECT {K}, 'financing_cf_ratio_of_net_cf_consistency_precheck' FROM x WHERE abs(fi / nullif(n, 0) * 100 - rf) > 10""",
)
_on_sheets("e8_anomalies", lambda s: R.anomalies(s["kpi"]).select(*KEY, "field", "value", "anomaly"), f"SELECT {K}, 'gross_profit_margin' AS field, gross_profit_margin AS value, 'percentage' AS anomaly FROM kpi WHERE abs(gross_profit_margin) > 1000 UNION ALL SELECT {K}, 'net_profit_margin', net_profit_margin, 'percentage' FROM kpi WHERE abs(net_profit_margin) > 1000")
_on_sheets("e9_anomaly_counts", lambda s: R.anomaly_counts(R.anomalies(s["kpi"])), "SELECT 'gross_profit_margin' AS field, 'percentage' AS anomaly, count(*) AS n FROM kpi WHERE abs(gross_profit_margin) > 1000 HAVING count(*) > 0 UNION ALL SELECT 'net_profit_margin', 'percentage', count(*) FROM kpi WHERE abs(net_profit_margin) > 1000 HAVING count(*) > 0")
_two = lambda s: {"income": s["income"], "cash": s["cash"]}
_fields = {"income": [REV, COST, "operating_expense_selling_expenses", "operating_expense_rnd_expenses", NP], "cash": ["operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount", "net_cash_flow"]}
_cov = " UNION ALL ".join(f"SELECT '{t}' AS sheet, '{c}' AS field, count(*) AS n_records, count({c}) AS n_filled, count(*) - count({c}) AS n_missing, round(count({c}) / count(*), 4) AS coverage FROM {t}" for t, cs in _fields.items() for c in cs)
_on_sheets("e1_sheet_sizes", lambda s: R.sheet_sizes(_two(s)), " UNION ALL ".join(f"SELECT '{t}' AS sheet, count(*) AS n_records, round(avg({' + '.join(f'({c} IS NOT NULL)::INT' for c in cs)}), 2) AS mean_fields FROM {t}" for t, cs in _fields.items()))
_on_sheets("e2_field_coverage", lambda s: R.field_coverage(_two(s)), _cov)
_on_sheets("e3_missing_examples", lambda s: R.missing_examples(s["cash"]), " UNION ALL ".join(f"SELECT '{c}' AS field, string_agg(k, ';' ORDER BY k) AS keys FROM (SELECT concat(stock_code, '|', report_period) AS k FROM cash WHERE {c} IS NULL ORDER BY 1 LIMIT 10)" for c in _fields["cash"]))
_on_sheets("e4_mean_coverage", lambda s: R.mean_coverage(R.field_coverage(_two(s))), f", c AS ({_cov}) SELECT sheet, round(avg(coverage), 4) AS mean_coverage, coalesce(string_agg(CASE WHEN coverage < 0.5 THEN field END, ',' ORDER BY field), '') AS low_fields FROM c GROUP BY 1")
_gap = "'likely_extraction_gap'"
_ratio = lambda x: f"CASE WHEN net_cash_flow IS NULL THEN 'upstream_net_cash_flow_missing' WHEN {x}_cf_net_amount IS NULL THEN 'upstream_cash_flow_missing' ELSE 'derivation_inputs_incomplete' END"
_why = {  # field: reason, table
    **{c: (_gap, "cash2") for c in _fields["cash"]}, **{f"{x}_cf_ratio_of_net_cf": (_ratio(x), "cash2") for x in ("operating", "investing", "financing")},
    "eps": (_gap, "kpi2"), "gross_profit_margin": ("'derivable_but_inputs_missing'", "kpi2"), "net_asset_per_share": ("CASE WHEN eps IS NULL THEN 'missing_share_basis' ELSE 'derivation_inputs_incomplete' END", "kpi2"),
    "operating_cf_per_share": ("'upstream_cash_flow_missing'", "kpi2"), "operating_revenue_qoq_growth": (f"CASE WHEN right(report_period, 2) IN ('FY', 'H1') THEN 'likely_not_disclosed_in_source' ELSE {_gap} END", "kpi2"),
}
_miss = " UNION ALL ".join(f"SELECT '{c}' AS field, {why} AS reason FROM {t} WHERE {c} IS NULL" for c, (why, t) in _why.items())
_reasons = lambda s: reduce(DataFrame.unionByName, [R.missing_reasons(s[t].select(*KEY, *[c for c, (_, u) in _why.items() if u == t])) for t in ("cash2", "kpi2")])
_on_sheets("e5_e6_missing_reasons", _reasons, f""", m AS ({_miss}), c AS (SELECT field, reason, count(*) AS n FROM m GROUP BY ALL) SELECT field, sum(n)::BIGINT AS n_missing, first(reason ORDER BY n DESC, reason) AS reason, concat('{{', string_agg(concat('"', reason, '":', n), ',' ORDER BY n DESC, reason), '}}') AS reasons FROM c GROUP BY 1""")
_on_sheets("e7_most_missing", lambda s: R.most_missing(R.field_coverage(_two(s)), 3), f", c AS ({_cov}), r AS (SELECT sheet, field, n_missing, row_number() OVER (PARTITION BY sheet ORDER BY n_missing DESC, field)::INT AS place FROM c WHERE n_missing > 0) SELECT * FROM r WHERE place <= 3")
_on_sheets("e10_audit_sample", lambda s: R.audit_sample(s["cash"], _fields["cash"]), f"SELECT {K}, concat_ws(';', " + ", ".join(f"concat('{c}=', {c} IS NOT NULL)" for c in _fields["cash"]) + ") AS filled FROM cash ORDER BY report_period, stock_code LIMIT 8")
_on_sheets("e16_collapsed", lambda s: R.collapsed(s["income"], "stock_code", NP), f"SELECT stock_code, CASE WHEN (SELECT quantile_cont({NP}, 0.75) FROM income) <= 0 THEN min({NP}) ELSE max({NP}) END AS value FROM income GROUP BY 1")
_on_sheets("e17_skewed", lambda s: R.skewed(s["kpi"], "gross_profit_margin"), "SELECT count(*) AS n, count(*) >= 5 AND max(abs(gross_profit_margin)) / median(abs(gross_profit_margin)) >= 50 AS skewed FROM kpi WHERE abs(gross_profit_margin) > 0")
_on_sheets("e18_first_seen", lambda s: R.first_seen(s["income"].where("net_profit < -1").withColumn("year", F.col("report_year").cast("string")), "year", "stock_code", "stock_abbr"), "SELECT report_year::VARCHAR AS year, string_agg(stock_abbr, ',' ORDER BY c, stock_abbr) AS entities FROM (SELECT report_year, stock_abbr, min(stock_code) AS c FROM income WHERE net_profit < -1 GROUP BY ALL) GROUP BY 1")
_on_sheets("e19_constant_columns", lambda s: R.constant_columns(s["income"].withColumn("verdict", F.lit("fair "))), "SELECT 'verdict' AS name FROM income HAVING count(*) > 0")
_on_sheets("s1_numeric_first", lambda s: R.numeric_first(s["income"].select("stock_code", "report_period", F.col("report_year").cast("string").alias("y")), "y", 3).select("y"), "SELECT report_year::VARCHAR AS y FROM income ORDER BY report_year DESC LIMIT 3")
_on_view("m1_profile", lambda v: R.profile(v.select("report_period", REV, NP), [REV, NP], "report_period"), "SELECT count(*) AS n_rows, 3 AS n_columns, 2 AS n_numeric, count(DISTINCT report_period) AS n_periods FROM v")
_on_view("m2_chart_table", lambda v: R.chart_table(v.select("report_period", "stock_code", REV), "report_period", REV, 3), f"SELECT report_period, stock_code, {REV}, row_number() OVER (PARTITION BY report_period ORDER BY {REV} DESC NULLS LAST, stock_code)::INT AS place FROM v QUALIFY place <= 3")
_on_view("m3_display_scale", lambda v: R.display_scale(v.where(F.col("report_period") == P).select("stock_code", REV), REV), f"SELECT stock_code, CASE WHEN max(abs({REV})) OVER () >= 1e5 THEN {REV} / 10000 ELSE {REV} END AS {REV}, CASE WHEN max(abs({REV})) OVER () >= 1e5 THEN 'x10k' ELSE 'x1' END AS unit FROM v WHERE {_p}")
_on_view("m4_pie_shares", lambda v: R.pie_shares(v.where(F.col("report_period") == P).select("stock_code", NP), NP), f", x AS (SELECT stock_code, greatest({NP}, 0) AS {NP} FROM v WHERE {_p}) SELECT stock_code, {NP}, {NP} / (SELECT sum({NP}::DECIMAL(28,6))::DOUBLE FROM x) AS share FROM x")
__all__ = ["ORACLE_BASE"]
