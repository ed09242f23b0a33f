"""Registered queries of samples that are filled up, worst rules, keys of gaps, skew and fallback hits, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import retrieval as K
from ..operators import rules as R
from ..sources.statements import ORACLE_BASE, sheets
from ..sources.tables import stored
from .rule_queries import _rules, detail
from .statement_queries import COST, NP, ORACLE_VIEW, REV, view
from .text_queries import _hits, _kinds, _sqlhits, _sqlkinds, _table

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}

Q["a14_filled_sample"] = lambda spark, d: K.filled_round_robin(_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source"), "lang", "source", 25)
O["a14_filled_sample"] = """WITH o AS (SELECT source, min((lang, doc_id)) AS x FROM documents GROUP BY 1), t AS (SELECT x[1] AS lang, x[2] AS id, source FROM o),
w AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY id) AS own FROM t), f AS (SELECT *, row_number() OVER (ORDER BY own, lang) AS turn FROM w ORDER BY turn LIMIT 25),
b AS (SELECT id, lang, source, 0 AS late, turn FROM f UNION ALL SELECT doc_id, lang, source, 1, 0 FROM documents WHERE doc_id NOT IN (SELECT id FROM f))
SELECT id, lang, source, row_number() OVER (ORDER BY late, turn, id)::INT AS place FROM b ORDER BY place LIMIT 25"""
Q["a15_ordered_sample"] = lambda spark, d: K.ordered_sample(_table(spark, d, "benchmark").select("item_id"), "item_id", 20, 7)
O["a15_ordered_sample"] = "SELECT item_id, row_number() OVER (ORDER BY item_id)::INT AS place FROM (SELECT item_id FROM benchmark ORDER BY md5('7:' || item_id), item_id LIMIT 20)"
Q["e15_filled_samples"] = lambda spark, d: E.sample_filled(_kinds(_table(spark, d, "documents")), 30)
O["e15_filled_samples"] = _sqlkinds + """, f AS (SELECT source, kind, min(doc_id) AS doc_id, row_number() OVER (ORDER BY source, kind) AS turn FROM k GROUP BY source, kind QUALIFY turn <= 30),
b AS (SELECT doc_id, source, kind, 0 AS late, turn FROM f UNION ALL SELECT doc_id, source, kind, 1, 0 FROM k WHERE doc_id NOT IN (SELECT doc_id FROM f))
SELECT doc_id, source, kind, row_number() OVER (ORDER BY late, turn, doc_id)::INT AS place FROM b ORDER BY place LIMIT 30"""
Q["e12_worst_rules"] = lambda spark, d: R.worst_rules(R.rule_summary(detail(sheets(spark, d))))
O["e12_worst_rules"] = f"WITH {ORACLE_BASE} {_rules} SELECT rule, round(failed / applicable, 4) AS failure_rate, failed, row_number() OVER (ORDER BY round(failed / applicable, 4) DESC, rule)::INT AS place FROM sm ORDER BY place LIMIT 8"
_gap = lambda c: f"SELECT '{c}' AS field, stock_code, report_period FROM cash2 WHERE {c} IS NULL"
_cash = [*[f"{x}_cf_net_amount" for x in ("operating", "investing", "financing")], "net_cash_flow", *[f"{x}_cf_ratio_of_net_cf" for x in ("operating", "investing", "financing")]]
Q["e6_missing_keys"] = lambda spark, d: R.missing_keys(sheets(spark, d)["cash2"])
O["e6_missing_keys"] = f"WITH {ORACLE_BASE}, g AS ({' UNION ALL '.join(map(_gap, _cash))}), firsts AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY stock_code, report_period) AS place FROM g QUALIFY place <= 10) SELECT field, string_agg(stock_code || '|' || report_period, ' | ' ORDER BY place) AS sample_keys FROM firsts GROUP BY 1"
_skewed = (REV, NP, COST, "gross_profit_margin", "inventory_turnover_ratio")
Q["m1_skew_flags"] = lambda spark, d: R.skew_flags(view(spark, d), list(_skewed))
O["m1_skew_flags"] = f"WITH {ORACLE_VIEW} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, coalesce(count(*) >= 5 AND max(abs({c})) / median(abs({c})) >= 50, false) AS skewed FROM v WHERE abs({c}) > 0" for c in _skewed)


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    """A search that finds nothing for every second query, and one that finds all."""
    hits = stored(_hits(_table(spark, d, "embeddings"), 10))
    return K.with_fallback(hits.where("query_id % 40 = 0").select("query_id", "vec_id", "score"), hits.select("query_id", "vec_id", "score"))


Q["k21_fallback_hits"] = _fallback
O["k21_fallback_hits"] = _sqlhits + " SELECT query_id, vec_id, score, query_id % 40 <> 0 AS fallback FROM r WHERE rank <= 10"
