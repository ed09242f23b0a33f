"""Registered queries of reviews of extracted sheets (C-13, E-1, E-9, E-10, E-19), with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audits as A
from ..operators import rules as R
from ..sources.statements import ORACLE_BASE, sheets
from .statement_queries import NP, REV
from .text_queries import _table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}

#: Labels that the given texts hold some of, by sheet.
LABELS = {"kpi": ["License", "licensed", "the software (a)"], "income": ["conditions of", "warranties"], "balance": ["no such label"], "cash": []}


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as pages, some with a heading of contents or of a financial report."""
    k = F.col("doc_id")
    head = F.when(k % 7 == 0, "目 录\n").when(k % 11 == 0, "目录 第十节 财务报告\n").when(k % 5 == 0, "the software（a）： ").otherwise("")
    return _table(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


Q["c13_pages_of_sheets"] = lambda spark, d: A.candidate_pages(_pages(spark, d), LABELS).select("doc_id", "sheet", "hits", "digits")
_hit = lambda w: f"contains(c, '{w.replace(' ', '')}')::INT"
O["c13_pages_of_sheets"] = "WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '目 录' || chr(10) WHEN doc_id % 11 = 0 THEN '目录 第十节 财务报告' || chr(10) WHEN doc_id % 5 = 0 THEN 'the software（a）： ' ELSE '' END || coalesce(text, '') AS t FROM documents), " + f"""
c AS (SELECT doc_id, length(regexp_replace(t, '\\P{{Nd}}', '', 'g'))::INT AS digits, replace(replace(replace(regexp_replace(t, '\\s+', '', 'g'), '（', '('), '）', ')'), '：', ':') AS c FROM p),
s AS (SELECT doc_id, digits, unnest([{", ".join(f"{{'sheet': '{s}', 'hits': {' + '.join(map(_hit, words)) or '0'}, 'least': {2 if s == 'kpi' else 1}}}" for s, words in LABELS.items())}], recursive := true) FROM c WHERE NOT contains(c, '目录') OR contains(c, '财务报告'))
SELECT doc_id, sheet, hits, digits FROM s WHERE hits >= least OR digits >= 80"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    """Missing figures of two sheets (errors) and repeated keys (warnings)."""
    s = sheets(spark, d)
    missing = lambda name, columns: R.required_fields(s[name], columns).select(F.lit(name).alias("sheet"), F.concat(F.lit("missing_"), "missing").alias("rule"), F.lit("error").alias("severity"))
    twice = R.duplicate_keys(s["income"].unionByName(s["income"].where("report_year % 3 = 0"))).select(F.lit("income").alias("sheet"), F.lit("duplicate_key").alias("rule"), F.lit("warning").alias("severity"))
    return missing("income", [REV, NP]).unionByName(missing("cash", ["operating_cf_net_amount", "net_cash_flow"])).unionByName(twice)


def _anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Key figures as they are, and balances a hundred thousand times as large."""
    s = sheets(spark, d)
    large = s["balance"].withColumns({c: F.col(c) * 1e5 for c, t in s["balance"].dtypes if t == "double"})
    return R.anomalies(s["kpi"]).withColumn("sheet", F.lit("kpi")).unionByName(R.anomalies(large).withColumn("sheet", F.lit("balance")))


_sqlissues = f"""is1 AS (SELECT 'income' AS sheet, 'missing_{REV}' AS rule, 'error' AS severity FROM income WHERE {REV} IS NULL UNION ALL SELECT 'income', 'missing_{NP}', 'error' FROM income WHERE {NP} IS NULL
    UNION ALL SELECT 'cash', 'missing_operating_cf_net_amount', 'error' FROM cash WHERE operating_cf_net_amount IS NULL UNION ALL SELECT 'cash', 'missing_net_cash_flow', 'error' FROM cash WHERE net_cash_flow IS NULL UNION ALL SELECT 'income', 'duplicate_key', 'warning' FROM income WHERE report_year % 3 = 0)"""
Q["e1_issue_counts"] = lambda spark, d: A.issue_counts(_issues(spark, d))
O["e1_issue_counts"] = f"WITH {ORACLE_BASE}, {_sqlissues} SELECT sheet || '|' || severity AS issue, count(*) AS n FROM is1 GROUP BY ALL"
Q["e9_anomaly_summary"] = lambda spark, d: A.anomaly_summary(_anomalies(spark, d), _issues(spark, d))
_amounts = ("asset_total_assets", "liability_total_liabilities", "asset_inventory", "equity_total_equity", "liability_contract_liabilities", "liability_advance_from_customers")
O["e9_anomaly_summary"] = f"""WITH {ORACLE_BASE}, {_sqlissues}, an AS (SELECT 'kpi' AS sheet, unnest(['gross_profit_margin', 'net_profit_margin', 'roe']) AS field, 'percentage' AS anomaly, unnest([gross_profit_margin, net_profit_margin, roe]) AS x, 1000 AS most FROM kpi
    UNION ALL SELECT 'kpi', unnest(['{REV}', 'net_profit_10k_yuan', 'net_profit_excl_non_recurring']), 'amount', unnest([{REV}, net_profit_10k_yuan, net_profit_excl_non_recurring]), 1e8 FROM kpi
    UNION ALL SELECT 'balance', unnest([{", ".join(f"'{c}'" for c in _amounts)}]), 'amount', unnest([{", ".join(f"{c} * 1e5" for c in _amounts)}]), 1e8 FROM balance)
SELECT sheet, field, anomaly, count(*) AS n FROM an WHERE abs(x) > most GROUP BY ALL UNION ALL SELECT sheet, rule, 'validation_' || severity, count(*) FROM is1 GROUP BY ALL"""


def _rounded(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Three sheets with figures of two places."""
    s = sheets(spark, d)
    return {n: s[n].select(*[T.cents(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in s[n].dtypes]) for n in ("income", "kpi", "cash")}


Q["e10_rows_to_check"] = lambda spark, d: A.rows_to_check(_rounded(spark, d))
_has = {"income": [REV, NP], "kpi": A.FOCUS["kpi"], "cash": A.FOCUS["cash"]}
_json = lambda n: " || ',' || ".join(f"""'"{c}":' || {f"coalesce({c}::DECIMAL(18,2)::VARCHAR, 'null')" if c in _has[n] else "'null'"}""" for c in A.FOCUS[n])
O["e10_rows_to_check"] = f"WITH {ORACLE_BASE} " + " UNION ALL ".join(f"(SELECT '{n}' AS sheet, stock_code, stock_abbr, report_period, report_year, '{{' || {_json(n)} || '}}' AS sampled_field_values, '' AS audit_status, '' AS audit_notes FROM {n} ORDER BY report_period, stock_code LIMIT 8)" for n in _has)
Q["e19_shared_remarks"] = lambda spark, d: A.shared_remarks(_table(spark, d, "documents").select("lang", F.when(F.col("doc_id") % 3 == 0, " 稳健 ").when(F.col("doc_id") % 3 == 1, "稳健").otherwise("  ").alias("总体评价"), F.col("source").alias("来源说明"), F.lit(None).cast("string").alias("结论"), F.lit("x").alias("备注"), F.concat(F.lit("n"), F.floor(F.length("text") / 1e9).cast("string")).alias("判断")))
O["e19_shared_remarks"] = "WITH x AS (SELECT unnest(['总体评价', '来源说明', '判断']) AS \"column\", unnest([CASE WHEN doc_id % 3 < 2 THEN '稳健' END, nullif(trim(source), ''), 'n' || floor(length(text) / 1e9)::INT]) AS v FROM documents) SELECT \"column\", '研报证据支撑：' || min(v) AS note FROM x WHERE v IS NOT NULL GROUP BY 1 HAVING count(DISTINCT v) = 1"
