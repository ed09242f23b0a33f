"""The four statement sheets, derived from the order tables (FIXTURES.md): one SQL text for Spark and for DuckDB.

The base is computed once an application, as long as its tables stay as they are, and kept in the shared folder; the sheets are projections of it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .tables import stamp, stored_path

KEY = ["stock_code", "report_period", "report_year"]

FACTS = """
q AS (
  SELECT l_suppkey, CAST(extract(year FROM l_shipdate) AS INT) AS yr, CAST(extract(quarter FROM l_shipdate) AS INT) AS qt,
    SUM(CAST(l_extendedprice*(1-l_discount) AS DECIMAL(18,4))) AS rev, SUM(CAST(l_quantity*p_retailprice*0.5 AS DECIMAL(18,4))) AS cost,
    SUM(CAST(l_extendedprice*l_discount AS DECIMAL(18,4))) AS sell, SUM(CAST(l_extendedprice*l_tax AS DECIMAL(18,4))) AS rnd,
    SUM(CAST(l_extendedprice*(l_tax-0.04) AS DECIMAL(18,4))) AS np,
    SUM(CAST(CASE WHEN l_returnflag='A' THEN l_extendedprice ELSE 0 END AS DECIMAL(18,4))) AS ocf,
    SUM(CAST(CASE WHEN l_returnflag='R' THEN -l_extendedprice ELSE 0 END AS DECIMAL(18,4))) AS icf,
    SUM(CAST(CASE WHEN l_returnflag='N' THEN -l_extendedprice*0.5 ELSE 0 END AS DECIMAL(18,4))) AS fcf,
    SUM(CAST(CASE WHEN l_linestatus='O' THEN l_extendedprice ELSE 0 END AS DECIMAL(18,4))) AS liab
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2, 3),
p AS (SELECT * FROM (VALUES ('Q1',1), ('H1',2), ('Q3',3), ('FY',4)) AS t(sfx, maxq)),
base AS (
  SELECT lpad(CAST(l_suppkey AS VARCHAR(10)),6,'0') AS stock_code, concat('Supplier#', lpad(CAST(l_suppkey AS VARCHAR(10)),9,'0')) AS stock_abbr,
    concat(CAST(yr AS VARCHAR(10)), sfx) AS report_period, yr AS report_year, sfx AS period_suffix, CAST(l_suppkey AS INT) AS k,
    CAST(SUM(rev) AS DOUBLE)/10000 AS revenue, CAST(SUM(cost) AS DOUBLE)/10000 AS cost, CAST(SUM(sell) AS DOUBLE)/10000 AS selling,
    CAST(SUM(rnd) AS DOUBLE)/10000 AS rnd, CAST(SUM(np) AS DOUBLE)/10000 AS net_profit, CAST(SUM(ocf) AS DOUBLE)/10000 AS ocf,
    CAST(SUM(icf) AS DOUBLE)/10000 AS icf, CAST(SUM(fcf) AS DOUBLE)/10000 AS fcf, CAST(SUM(liab) AS DOUBLE)/10000 AS liab
  FROM q JOIN p ON qt <= maxq WHERE (l_suppkey*7 + yr*3 + maxq) % 13 <> 0 GROUP BY l_suppkey, yr, sfx)"""
SHEETS = """
income AS (
  SELECT stock_code, stock_abbr, report_period, report_year, CASE WHEN (k + report_year) % 17 = 0 THEN NULL ELSE revenue END AS total_operating_revenue,
    cost AS operating_expense_cost_of_sales, selling AS operating_expense_selling_expenses, rnd AS operating_expense_rnd_expenses, net_profit FROM base),
kpi AS (
  SELECT stock_code, stock_abbr, report_period, report_year, CASE WHEN (k + report_year) % 19 = 0 THEN revenue * 10 ELSE revenue END AS total_operating_revenue,
    net_profit AS net_profit_10k_yuan, net_profit * 0.9 AS net_profit_excl_non_recurring,
    CASE WHEN (k + report_year) % 23 = 0 THEN 2000.0 WHEN (k + report_year) % 11 = 0 THEN (revenue - cost) / revenue * 100 + 7 ELSE (revenue - cost) / revenue * 100 END AS gross_profit_margin,
    net_profit / revenue * 100 AS net_profit_margin,
    CASE WHEN (k + report_year) % 29 = 0 THEN -1 ELSE 1 END * net_profit * 10000 / 50000000 AS eps,
    net_profit / (revenue + 2 * cost) * 100 AS roe, (revenue + 2 * cost) * 10000 / 50000000 AS net_asset_per_share, ocf * 10000 / 50000000 AS operating_cf_per_share FROM base),
balance AS (
  SELECT stock_code, stock_abbr, report_period, report_year, revenue + 2 * cost + liab AS asset_total_assets, liab AS liability_total_liabilities,
    CASE WHEN k % 31 = 0 THEN 0 ELSE cost * 0.4 END AS asset_inventory,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN (revenue + 2 * cost) * 1.1 ELSE revenue + 2 * cost END AS equity_total_equity,
    CASE WHEN k % 3 = 0 THEN NULL ELSE liab * 0.1 END AS liability_contract_liabilities, liab * 0.2 AS liability_advance_from_customers FROM base),
cash AS (
  SELECT stock_code, stock_abbr, report_period, report_year,
    CASE WHEN (k + report_year) % 5 = 1 THEN NULL ELSE ocf END AS operating_cf_net_amount, CASE WHEN (k + report_year) % 5 = 2 THEN NULL ELSE icf END AS investing_cf_net_amount,
    CASE WHEN (k + report_year) % 5 = 3 THEN NULL ELSE fcf END AS financing_cf_net_amount,
    CASE WHEN (k + report_year) % 5 = 4 THEN NULL WHEN k % 37 = 0 THEN 0 WHEN k % 9 = 0 THEN (ocf + icf + fcf) * 1.5 ELSE ocf + icf + fcf END AS net_cash_flow FROM base),
balance2 AS (
  SELECT b.*, CASE WHEN CAST(stock_code AS INT) % 11 = 0 THEN 9 ELSE 0 END + liability_total_liabilities * 100 / nullif(asset_total_assets, 0) AS asset_liability_ratio FROM balance b),
cash2 AS (
  SELECT c.*, CASE WHEN (CAST(stock_code AS INT) + report_year) % 7 = 0 THEN 60 ELSE 0 END + operating_cf_net_amount * 100 / nullif(net_cash_flow, 0) AS operating_cf_ratio_of_net_cf,
    CASE WHEN (CAST(stock_code AS INT) + report_year) % 8 = 0 THEN 60 ELSE 0 END + investing_cf_net_amount * 100 / nullif(net_cash_flow, 0) AS investing_cf_ratio_of_net_cf,
    CASE WHEN (CAST(stock_code AS INT) + report_year) % 11 = 0 THEN 60 ELSE 0 END + financing_cf_net_amount * 100 / nullif(net_cash_flow, 0) AS financing_cf_ratio_of_net_cf FROM cash c),
single AS (
  SELECT *, CASE period_suffix WHEN 'Q1' THEN 1 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 ELSE 4 END AS place, net_profit * 0.9 AS excl,
    revenue - coalesce(lag(revenue) OVER (PARTITION BY stock_code, report_year ORDER BY CASE period_suffix WHEN 'Q1' THEN 1 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 ELSE 4 END), 0) AS r1,
    net_profit - coalesce(lag(net_profit) OVER (PARTITION BY stock_code, report_year ORDER BY CASE period_suffix WHEN 'Q1' THEN 1 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 ELSE 4 END), 0) AS p1 FROM base),
before AS (
  SELECT stock_code, report_period, report_year, r1, p1, excl, lag(r1) OVER (PARTITION BY stock_code ORDER BY report_year, place) AS r0, lag(p1) OVER (PARTITION BY stock_code ORDER BY report_year, place) AS p0,
    lag(excl) OVER (PARTITION BY stock_code, period_suffix ORDER BY report_year) AS e0 FROM single),
kpi2 AS (
  SELECT k.*, (r1 - r0) * 100 / nullif(abs(r0), 0) AS operating_revenue_qoq_growth, (p1 - p0) * 100 / nullif(abs(p0), 0) AS net_profit_qoq_growth,
    (excl - e0) * 100 / nullif(abs(e0), 0) + CASE WHEN (CAST(k.stock_code AS INT) + k.report_year) % 6 = 0 THEN 400 ELSE 0 END AS net_profit_excl_non_recurring_yoy
  FROM kpi k JOIN before b ON k.stock_code = b.stock_code AND k.report_period = b.report_period)
"""
BASE = FACTS + "," + SHEETS
#: FACTS as Spark computes them, with the same results: rows are brought together by company before they are summed, in pieces of about equal size (also those of a
#: company with very many rows), so that a task holds few quarters, each of many rows. Amounts are summed as whole ten-thousandths in two halves (by BILLION), which no
#: sum overflows: sums of decimals that wide take several times as long.
_JOINED = "{lineitem} JOIN {part} ON l_partkey = p_partkey"
_NEEDED = "l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, p_retailprice"
_SUMMED = re.compile(r"SUM\(CAST\((.+?) AS DECIMAL\(18,4\)\)\) AS (\w+)")
_TOTAL = re.compile(r"CAST\(SUM\((\w+)\) AS DOUBLE\)")
BILLION = 1_000_000_000


def ten_thousandths(x: str) -> str:
    """SQL of CAST(x AS DECIMAL(18,4)) as a whole number of ten-thousandths. Only what is near a tie, or large, takes the slow way through a decimal."""
    y = f"(({x}) * 10000)"
    return f"CASE WHEN abs({y}) < 1e11 AND abs({y} - floor({y}) - 0.5D) > 0.001D THEN floor({y} + 0.5D) ELSE CAST(CAST({x} AS DECIMAL(18,4)) * 10000 AS BIGINT) END"


def whole_sum(name: str) -> str:
    """SQL of the double nearest to the sum of both halves of an amount; below 2**53 the sum itself is a double."""
    high, low = f"SUM({name}_high)", f"SUM({name}_low)"
    return f"CASE WHEN abs({high}) < 4000000 AND abs({low}) < {4_000_000 * BILLION} THEN CAST({high} * {BILLION} + {low} AS DOUBLE) / 10000 ELSE CAST((CAST({high} AS DECIMAL(19,0)) * {BILLION} + {low}) * 0.0001 AS DOUBLE) END"


def _spark_facts() -> str:
    amounts = ", ".join(f"{ten_thousandths(x)} AS {name}" for x, name in _SUMMED.findall(FACTS))
    rows = f"(SELECT l_suppkey, l_shipdate, {amounts} FROM (SELECT /*+ REBALANCE(place) */ * FROM (SELECT {_NEEDED}, hash(l_suppkey) AS place FROM {_JOINED})))"
    sql = _SUMMED.sub(lambda m: f"SUM({m[2]} div {BILLION}) AS {m[2]}_high, SUM({m[2]} % {BILLION}) AS {m[2]}_low", FACTS.replace(_JOINED, rows))
    return _TOTAL.sub(lambda m: whole_sum(m[1]), sql)


SPARK_FACTS = _spark_facts()
#: The same for DuckDB, where the tables are views of these names.
ORACLE_BASE = BASE.replace("{lineitem}", "lineitem").replace("{part}", "part")
#: What `sheets` offers. The last three are the sheets with growth and ratio columns.
NAMES = ("income", "kpi", "balance", "cash", "kpi2", "balance2", "cash2")


#: Where the base of an application and of its tables, as they were last changed, is kept.
_kept: dict[tuple, str] = {}


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each company and cumulative period, computed once an application and version of the tables, and stored."""
    paths = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")]
    base = spark.sql(f"WITH {SPARK_FACTS} SELECT * FROM base", **dict(zip(("lineitem", "part"), map(spark.read.parquet, paths), strict=True)))
    key = (spark.sparkContext.applicationId, *paths, *(stamp(spark, p) for p in paths))
    if key not in _kept or stamp(spark, _kept[key]) is None:
        _kept[key] = stored_path(base)
    return spark.read.schema(base.schema).parquet(_kept[key])


def sheets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The sheets by name, projections of one stored base."""
    base = facts(spark, sf_dir)
    return {n: spark.sql(f"WITH {SHEETS.replace('FROM base', 'FROM {base}')} SELECT * FROM {n}", base=base) for n in NAMES}
