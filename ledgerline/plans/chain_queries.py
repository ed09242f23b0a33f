"""Registered queries of rules and repeated passes over the sheets (D-5, D-8) and of seeding between rows and evidence (J-15), with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import field_rules as R
from ..operators import resolution as L
from ..operators import retrieval as K
from ..sources.statements import KEY, ORACLE_BASE, sheets
from .statement_queries import COST, REV

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}
_K3 = ", ".join(KEY)
_FIELDS = [f"{s}.{f}" for s, fields in R.RULES.items() for f in fields]


def ruled_sheets(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The sheets with gaps and wild values for the rules: some records have no balance, some figures are missing, 0 or beyond reason."""
    s, y = sheets(spark, d), F.col("report_year")
    gone = lambda c, n, i: F.when((F.col("stock_code").cast("int") + y) % n != i, F.col(c)).alias(c)
    kpi = s["kpi2"].withColumns({c: gone(c, 3, i % 3) for i, c in enumerate((REV, "net_profit_10k_yuan", "roe", "net_asset_per_share", "operating_cf_per_share", "gross_profit_margin", "net_profit_margin"))})
    kpi = kpi.withColumns({"operating_revenue_yoy_growth": F.when(y % 4 == 0, 7.0), "net_profit_yoy_growth": F.lit(None).cast("double")})
    income = s["income"].withColumns({"operating_revenue_yoy_growth": (y % 9).cast("double"), "net_profit_yoy_growth": F.when(y % 2 == 0, (y % 5).cast("double"))})
    balance = s["balance2"].where((F.col("stock_code").cast("int") + y) % 6 != 0).withColumn("asset_liability_ratio", gone("asset_liability_ratio", 4, 1) * F.when(y % 5 == 0, 1_000).otherwise(1))
    cash = s["cash2"].withColumns({f"{x}_cf_ratio_of_net_cf": gone(f"{x}_cf_ratio_of_net_cf", 3, 1) for x in ("operating", "investing", "financing")})
    return {"income": income, "balance": balance, "cash": cash, "kpi": kpi}


_short = {name: name.replace(".", "_") for name in _FIELDS}
Q["d5_field_rules"] = lambda spark, d: R.apply_rules(ruled_sheets(spark, d)).select(*KEY, *[F.col(f"`{n}`").alias(a) for n, a in _short.items()])
_k = "(stock_code::INT + report_year)"
_gone = lambda c, n, i: f"CASE WHEN {_k} % {n} <> {i} THEN {c} END"
_missing = {c: _gone(c, 3, i % 3) for i, c in enumerate((REV, "net_profit_10k_yuan", "roe", "net_asset_per_share", "operating_cf_per_share", "gross_profit_margin", "net_profit_margin"))}
_wild = lambda c, new: f"CASE WHEN {c} IS NULL OR abs({c}) > 1000 THEN coalesce({new}, {c}) ELSE {c} END"
_three = ("operating", "investing", "financing")
O["d5_field_rules"] = f"""WITH {ORACLE_BASE},
k AS (SELECT {_K3}, eps, net_profit_excl_non_recurring AS x, operating_revenue_qoq_growth, net_profit_qoq_growth, net_profit_excl_non_recurring_yoy, {", ".join(f"{v} AS {c}" for c, v in _missing.items())}, CASE WHEN report_year % 4 = 0 THEN 7.0 END AS ry FROM kpi2),
i AS (SELECT {_K3}, {REV} AS r, net_profit AS p, {COST} AS c, report_year % 9 AS gy, CASE WHEN report_year % 2 = 0 THEN report_year % 5 END AS py FROM income),
b AS (SELECT {_K3}, true AS hb, asset_total_assets AS a, liability_total_liabilities AS l, equity_total_equity AS e, liability_contract_liabilities AS lc, {_gone("asset_liability_ratio", 4, 1)} * CASE WHEN report_year % 5 = 0 THEN 1000 ELSE 1 END AS alr FROM balance2 WHERE {_k} % 6 <> 0),
c AS (SELECT {_K3}, {", ".join(f"{x}_cf_net_amount AS {x}, {_gone(f'{x}_cf_ratio_of_net_cf', 3, 1)} AS {x}_r" for x in _three)}, net_cash_flow AS n FROM cash2),
w AS (SELECT *, coalesce(e, a - l) AS e1, coalesce(n, operating + investing + financing) AS n1, coalesce({REV}, r) AS r1, coalesce(net_profit_10k_yuan, p) AS p1 FROM k FULL JOIN i USING ({_K3}) FULL JOIN b USING ({_K3}) FULL JOIN c USING ({_K3})),
v AS (SELECT *, coalesce(nullif(r, 0), r1) AS rr, coalesce(nullif(p, 0), p1) AS pp FROM w),
u AS (SELECT *, CASE WHEN abs(pp * 10000 / nullif(eps, 0)) BETWEEN 1e6 AND 1e12 THEN pp * 10000 / nullif(eps, 0) END AS sh FROM v)
SELECT {_K3}, ({_wild("alr", "l / nullif(a, 0) * 100")})::DOUBLE AS balance_asset_liability_ratio, (e1)::DOUBLE AS balance_equity_total_equity, (lc)::DOUBLE AS balance_liability_contract_liabilities, (n1)::DOUBLE AS cash_net_cash_flow,
 {", ".join(f"({_wild(f'{x}_r', f'{x} / nullif(n1, 0) * 100')})::DOUBLE AS cash_{x}_cf_ratio_of_net_cf" for x in _three)},
 (eps)::DOUBLE AS kpi_eps, (r1)::DOUBLE AS kpi_total_operating_revenue, (coalesce(ry, gy))::DOUBLE AS kpi_operating_revenue_yoy_growth, (operating_revenue_qoq_growth)::DOUBLE AS kpi_operating_revenue_qoq_growth,
 (p1)::DOUBLE AS kpi_net_profit_10k_yuan, py::DOUBLE AS kpi_net_profit_yoy_growth, (net_profit_qoq_growth)::DOUBLE AS kpi_net_profit_qoq_growth, (coalesce(net_asset_per_share, e1 * 10000 / sh))::DOUBLE AS kpi_net_asset_per_share,
 ({_wild("roe", "pp / nullif(e1, 0) * 100")})::DOUBLE AS kpi_roe, (coalesce(operating_cf_per_share, operating * 10000 / sh))::DOUBLE AS kpi_operating_cf_per_share, (x)::DOUBLE AS kpi_net_profit_excl_non_recurring, (net_profit_excl_non_recurring_yoy)::DOUBLE AS kpi_net_profit_excl_non_recurring_yoy,
 ({_wild("gross_profit_margin", "(rr - c) / nullif(rr, 0) * 100")})::DOUBLE AS kpi_gross_profit_margin, ({_wild("net_profit_margin", "pp / nullif(rr, 0) * 100")})::DOUBLE AS kpi_net_profit_margin, (x / nullif(e1, 0) * 100)::DOUBLE AS kpi_roe_weighted_excl_non_recurring FROM u"""

# D-8: the chain
_CHAIN = (REV, "net_profit_10k_yuan", "gross_profit_margin", "net_profit_margin", "roe", "roe_weighted_excl_non_recurring", "net_asset_per_share", "operating_cf_per_share", "eps")


def _settled(spark: SparkSession, d: str) -> DataFrame:
    """Key figures whose revenue is ten times too large in some periods: the margins of the first pass follow it, those of the second the replaced one."""
    s = sheets(spark, d)
    y = F.col("report_year")
    kpi = s["kpi"].withColumns({"net_profit_10k_yuan": F.when(y % 4 == 0, F.lit(0.0)).otherwise(F.col("net_profit_10k_yuan")), "roe": F.when(y % 3 == 1, 1_500.0).otherwise(F.col("roe")), "net_asset_per_share": F.when(y % 5 == 0, 900.0).otherwise(F.col("net_asset_per_share"))})
    out = E.settled_kpi(kpi, s["income"], s["balance"], s["cash"])
    steps = lambda name: F.array_join(F.array_sort(F.transform(F.filter("history", lambda h: h["step"] == name), lambda h: h["field"])), ",").alias(name.replace(" ", "_"))
    return out.select(*KEY, *[F.round(c, 6).alias(c) for c in _CHAIN], *map(steps, ("sanitize", "enrich 1", "check 1", "enrich 2")))


def _enrich_sql(source: str, name: str) -> str:
    """One pass: r0, p0, g, m, roe, w, nav, ocf of `source` to those of `name`; r, p, c, e, f, x, eps stay."""
    odd = "CASE WHEN abs(gm) > 100 THEN 1000 + abs(gm) ELSE 0 END + CASE WHEN abs(nm) > 100 THEN 1000 + abs(nm) ELSE 0 END + CASE WHEN gm < -50 THEN -gm - 50 ELSE 0 END + CASE WHEN nm < -50 THEN -nm - 50 ELSE 0 END + CASE WHEN nm > gm + 20 THEN nm - gm + 480 ELSE 0 END"
    amount = lambda a, b: f"CASE WHEN {b} IS NOT NULL AND ({a} IS NULL OR NOT fy AND ({a} = 0 AND abs({b}) > 100 OR {a} <> 0 AND ({a} * {b} < 0 OR abs({a} - {b}) > greatest(100, abs({b}) * 0.3)))) THEN {b} ELSE {a} END"
    margin = lambda a, b: f"CASE WHEN {b} IS NOT NULL AND ({a} IS NULL OR abs({a}) > 1000 OR abs({a} - {b}) > 20) THEN {b} ELSE {a} END"
    wild = lambda a, b: f"CASE WHEN {b} IS NOT NULL AND ({a} IS NULL OR abs({a}) > 1000) THEN {b} ELSE {a} END"
    share = lambda a, b: f"CASE WHEN {b} IS NOT NULL AND ({a} IS NULL OR CASE WHEN {a} = 0 OR {b} = 0 THEN abs({a} - {b}) > 1 ELSE {a} * {b} < 0 OR abs({a} - {b}) > greatest(1, abs({a}) * 0.8, abs({b}) * 0.8) END) THEN {b} ELSE {a} END"
    return f"""{name}1 AS (SELECT {_K3}, v AS rev, (v - c) * 100 / v AS gm, p * 100 / v AS nm FROM (SELECT *, unnest([r, r0]) AS v FROM {source}) WHERE v > 0),
{name}2 AS (SELECT {_K3}, rev FROM {name}1 QUALIFY row_number() OVER (PARTITION BY {_K3} ORDER BY {odd}, rev DESC) = 1),
{name}3 AS (SELECT s.*, coalesce(rev, nullif(r, 0), r0) AS v, CASE WHEN abs(p * 10000 / nullif(eps, 0)) BETWEEN 1e6 AND 1e12 THEN p * 10000 / eps END AS n FROM {source} s LEFT JOIN {name}2 USING ({_K3})),
{name}4 AS (SELECT *, (v - c) * 100 / nullif(v, 0) AS g1, p * 100 / nullif(v, 0) AS m1, p * 100 / nullif(e, 0) AS roe1, x * 100 / nullif(e, 0) AS w1, e * 10000 / n AS nav1, f * 10000 / n AS ocf1 FROM {name}3),
{name} AS (SELECT {_K3}, fy, r, p, c, e, f, x, eps, {amount("r0", "r")} AS r0, {amount("p0", "p")} AS p0, {margin("g", "g1")} AS g, {margin("m", "m1")} AS m, {wild("roe", "roe1")} AS roe, {wild("w", "w1")} AS w, {share("nav", "nav1")} AS nav, {share("ocf", "ocf1")} AS ocf FROM {name}4)"""


_names = {"r0": REV, "p0": "net_profit_10k_yuan", "g": "gross_profit_margin", "m": "net_profit_margin", "roe": "roe", "w": "roe_weighted_excl_non_recurring", "nav": "net_asset_per_share", "ocf": "operating_cf_per_share"}
_changes = lambda a, b, name: "array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {a}.{k} IS DISTINCT FROM {b}.{k} THEN '{v}' END" for k, v in {**_names, "eps": "eps", "x": "net_profit_excl_non_recurring"}.items()) + f"], lambda z: z IS NOT NULL)), ',') AS {name}"
_limits = {"r0": 1e8, "p0": 1e8, "x": 1e8, "g": 1000, "m": 1000, "roe": 1000, "w": 1000, "nav": 200, "ocf": 200, "eps": 20}
_pct = ("g", "m", "roe", "w")
Q["d8_settled_kpi"] = _settled
O["d8_settled_kpi"] = f"""WITH {ORACLE_BASE},
s0 AS (SELECT {_K3}, report_period LIKE '%FY' AS fy, i.{REV} AS r, i.net_profit AS p, i.{COST} AS c, b.equity_total_equity AS e, c.operating_cf_net_amount AS f, k.net_profit_excl_non_recurring AS x, k.eps, k.{REV} AS r0, CASE WHEN report_year % 4 = 0 THEN 0 ELSE k.net_profit_10k_yuan END AS p0,
    k.gross_profit_margin AS g, k.net_profit_margin AS m, CASE WHEN report_year % 3 = 1 THEN 1500 ELSE k.roe END AS roe, NULL::DOUBLE AS w, CASE WHEN report_year % 5 = 0 THEN 900 ELSE k.net_asset_per_share END AS nav, k.operating_cf_per_share AS ocf
    FROM kpi k LEFT JOIN income i USING ({_K3}) LEFT JOIN balance b USING ({_K3}) LEFT JOIN cash c USING ({_K3})),
s1 AS (SELECT * REPLACE ({", ".join(f"CASE WHEN abs({c}) <= {v} THEN {c} END AS {c}" for c, v in _limits.items())}) FROM s0),
{_enrich_sql("s1", "s2")}, s3 AS (SELECT * REPLACE ({", ".join(f"CASE WHEN abs({c}) <= 1000 THEN {c} END AS {c}" for c in _pct)}) FROM s2), {_enrich_sql("s3", "s4")}
SELECT {", ".join(f"s4.{k}" for k in KEY)}, {", ".join(f"round(s4.{k}, 6)::DOUBLE AS {v}" for k, v in _names.items())}, round(s4.eps, 6)::DOUBLE AS eps, {_changes("s0", "s1", "sanitize")}, {_changes("s1", "s2", "enrich_1")}, {_changes("s2", "s3", "check_1")}, {_changes("s3", "s4", "enrich_2")}
FROM s0 JOIN s1 USING ({_K3}) JOIN s2 USING ({_K3}) JOIN s3 USING ({_K3}) JOIN s4 USING ({_K3})"""


# J-15: rows seed retrieval, evidence seeds rows
def seeding(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions on third quarters, their rows (seven for each, some twice, none for every fifth question), companies of their evidence, and the pool of all third quarters."""
    x = sheets(spark, d)["income"].where("report_period like '%Q3'")
    k, y = F.col("stock_code").cast("int"), F.col("report_year")
    name = lambda n: F.concat(F.lit("Supplier#"), F.lpad(n.cast("string"), 9, "0"))
    none = F.lit(None).cast("array<string>")
    text = F.when((k + y) % 4 == 0, "哪些公司集采中标").when((k + y) % 4 == 1, "这家公司为什么增长").otherwise("为什么增长")
    q = x.select(
        F.concat_ws("-", "stock_code", "report_period").alias("question_id"), text.alias("text"), F.when(k % 3 < 2, "causal_analysis").otherwise("sql_only").alias("intent"), (y % 5 != 0).alias("needs_retrieval"), (y % 3 != 0).alias("needs_sql"),
        F.when(k % 2 == 0, "hybrid").otherwise("industry").alias("scope"), F.when(k % 7 == 0, F.array(F.lit("given"))).otherwise(none).alias("companies"), F.when(y % 4 == 1, F.array(F.lit("said before"), F.lit(" said before "), F.lit(""))).alias("context"), k.alias("k"), y.alias("y"),
    )
    rows = q.where("(k + y) % 5 <> 0").select("question_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("place"), "k").select("question_id", "place", F.when(F.col("place") == 3, "").otherwise(name(F.col("k") + F.col("place") % 7)).alias("stock_abbr"))
    evidence = q.where("y % 2 = 0").select("question_id", F.array(name(F.col("k") + 1), name(F.col("k") + 2), name(F.col("k") + 1)).alias("companies"))
    pool = x.select("stock_abbr", F.lit(0).alias("place")).distinct()
    return q.drop("k", "y"), rows, evidence, pool


def _by_rows(spark: SparkSession, d: str) -> DataFrame:
    q, rows, _, _ = seeding(spark, d)
    return K.seeded_by_rows(q, rows).select("question_id", F.array_join("companies", ",").alias("companies"), "scope", "seeded")


def _by_evidence(spark: SparkSession, d: str) -> DataFrame:
    q, rows, evidence, pool = seeding(spark, d)
    return K.seeded_by_evidence(q, rows, evidence, pool).select("question_id", "place", "stock_abbr")


_SEED = f"""{ORACLE_BASE}, t AS (SELECT * FROM income WHERE report_period LIKE '%Q3'),
asked AS (SELECT concat_ws('-', stock_code, report_period) AS question_id, stock_code::INT AS k, report_year AS y FROM t),
r AS (SELECT question_id, k, unnest(range(1, 10))::INT AS place FROM asked WHERE (k + y) % 5 <> 0),
rows_ AS (SELECT question_id, place, CASE WHEN place = 3 THEN '' ELSE 'Supplier#' || lpad((k + place % 7)::VARCHAR, 9, '0') END AS stock_abbr FROM r)"""
Q["j15_seeded_by_rows"], Q["j15_seeded_by_evidence"] = _by_rows, _by_evidence
O["j15_seeded_by_rows"] = f"""WITH {_SEED}, f AS (SELECT question_id, stock_abbr, min(place) AS place FROM rows_ WHERE stock_abbr <> '' GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS n FROM f),
n AS (SELECT question_id, string_agg(stock_abbr, ',' ORDER BY n) AS names, min(CASE WHEN n = 1 THEN stock_abbr END) AS first FROM g WHERE n <= 5 GROUP BY 1),
x AS (SELECT asked.*, names, first, y % 5 <> 0 AND k % 3 < 2 AND k % 7 <> 0 AND (y % 4 = 1 OR names IS NOT NULL) AS s FROM asked LEFT JOIN n USING (question_id)), z AS (SELECT *, NOT s AND k % 7 <> 0 AND names IS NOT NULL AND (k + y) % 4 = 1 AS alone FROM x)
SELECT question_id, CASE WHEN alone THEN first WHEN s THEN CASE WHEN y % 4 = 1 THEN 'said before' ELSE names END WHEN k % 7 = 0 THEN 'given' ELSE '' END AS companies, CASE WHEN alone OR (s AND k % 2 = 0) THEN 'stock' WHEN k % 2 = 0 THEN 'hybrid' ELSE 'industry' END AS scope, alone OR s AS seeded FROM z"""
O["j15_seeded_by_evidence"] = f"""WITH {_SEED}, m AS (SELECT *, y % 3 <> 0 AND k % 7 <> 0 AS free, (k + y) % 4 = 0 AS decides, y % 2 = 0 AS named, (k + y) % 5 <> 0 AS has FROM asked), w AS (SELECT *, free AND named AND (NOT has OR decides) AS anew, free AND decides AND NOT named AS cleared FROM m)
SELECT question_id, place, stock_abbr FROM rows_ JOIN w USING (question_id) WHERE NOT anew AND NOT cleared
UNION ALL SELECT question_id, 0, stock_abbr FROM (SELECT question_id, 'Supplier#' || lpad((k + unnest([1, 2]))::VARCHAR, 9, '0') AS stock_abbr FROM w WHERE anew) JOIN (SELECT DISTINCT stock_abbr FROM t) USING (stock_abbr)"""


# L-1: companies of questions
def named_questions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions that name companies by name, by codes of six and three digits, with spaces in a name, after a hint, or by an alias; names and aliases."""
    x = sheets(spark, d)["income"].where("report_period like '%Q3'")
    k = F.col("stock_code").cast("int")
    nxt = F.concat(F.lit("Supplier#"), F.lpad((k + 1).cast("string"), 9, "0"))
    short = lambda c: F.lpad(c.cast("string"), F.when(c < 1_000, 3).otherwise(6), "0")  # noqa: E731  from 1,000 on three digits would be another company's
    text = F.when(k % 5 == 0, F.concat("stock_abbr", F.lit("2023年的利润是多少"))).when(k % 5 == 1, F.concat(F.lit("比较"), "stock_code", F.lit("和"), short(k + 1), F.lit("的收入")))
    text = text.when(k % 5 == 2, F.concat(F.lit("Sup plier（集团）#"), F.lpad(k.cast("string"), 9, "0"), F.lit(" 怎么样"))).when(k % 5 == 3, F.concat(F.lit("公司名称："), "stock_abbr", F.lit("集团，利润？")))
    q = x.select(F.concat_ws("-", "stock_code", "report_period").alias("question_id"), text.otherwise(F.concat(F.lit("<"), k.cast("string"), F.lit(">与"), nxt, F.lit("相比"))).alias("text"))
    names = x.select("stock_code", "stock_abbr").distinct()
    return q, names, names.select(F.concat(F.lit("<"), F.col("stock_code").cast("int").cast("string"), F.lit(">")).alias("alias"), "stock_abbr")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    out = L.resolved_companies(*named_questions(spark, d))
    return out.select("question_id", F.array_join("companies", ",").alias("companies"), F.array_join("codes", ",").alias("codes"))


Q["l1_resolved_companies"] = _resolved
O["l1_resolved_companies"] = f"""WITH {ORACLE_BASE}, t AS (SELECT concat_ws('-', stock_code, report_period) AS question_id, stock_code::INT AS k FROM income WHERE report_period LIKE '%Q3'), n AS (SELECT DISTINCT stock_code, stock_abbr FROM income WHERE report_period LIKE '%Q3'),
u AS (SELECT question_id, unnest(CASE WHEN k % 5 IN (1, 4) THEN [k, k + 1] ELSE [k] END) AS c FROM t)
SELECT question_id, string_agg(stock_abbr, ',' ORDER BY c) AS companies, string_agg(stock_code, ',' ORDER BY c) AS codes FROM u JOIN n ON stock_code::INT = c GROUP BY 1"""
