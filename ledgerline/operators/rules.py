"""Accounting rules (R family) and profiling (E family).

All rules of a row are computed in one pass: the joined sheets get an array of (rule, actual, expected, tolerances), which is exploded."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.statements import KEY
from ..sources.tables import stored
from .periods import plausible_revenue, qoq_reset, yoy
from .quantiles import percentiles
from .view import kind, suffix

DETAIL = "array<struct<rule:string,actual:double,expected:double,abs_tol:double,rel_tol:double,style:string>>"


def rule(name: str, actual: Column, expected: Column, abs_tol: float, rel_tol: float, style: str = "near", gate: Column | None = None) -> Column:
    """A rule's values in a row; null where it does not apply."""
    applies = actual.isNotNull() & expected.isNotNull()
    applies = applies & F.coalesce(gate, F.lit(False)) if gate is not None else applies
    fields = F.struct(F.lit(name).alias("rule"), actual.cast("double").alias("actual"), expected.cast("double").alias("expected"), F.lit(abs_tol).alias("abs_tol"), F.lit(rel_tol).alias("rel_tol"), F.lit(style).alias("style"))
    return F.when(applies, fields)


def share_count(profit: Column, eps: Column, allow_negative: bool = False) -> Column:
    """B-21: profit (10k) over eps as a number of shares, if plausible."""
    n = F.try_divide(profit * 10_000, eps)
    return F.when((F.abs(n) if allow_negative else n).between(1e6, 1e12), n)


def evaluate(joined: DataFrame, rules: list[Column]) -> DataFrame:
    """Key, rule, actual, expected, difference, passed of every rule that applies."""
    rows = joined.select(*KEY, F.explode(F.array_compact(F.array(*rules))).alias("x")).select(*KEY, "x.*")
    gap = F.abs(F.col("actual") - F.col("expected"))
    near = (gap <= F.col("abs_tol")) | (gap / F.greatest(F.abs("expected"), F.lit(1.0)) <= F.col("rel_tol"))
    passed = F.when(F.col("style") == "upper", F.col("actual") <= F.col("expected") + F.col("abs_tol")).when(F.col("style") == "sign", F.col("actual") * F.col("expected") > 0).otherwise(near)
    return rows.select(*KEY, "rule", "actual", "expected", gap.alias("difference"), passed.alias("passed"))


def accounting_rules(income: DataFrame, kpi: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """R-1 to R-13 in one pass over the joined sheets, and R-14 to R-16 on single quarters and years."""
    names = {"k": kpi.withColumnRenamed("total_operating_revenue", "kpi_revenue"), "b": balance, "c": cash}
    x = income
    for df in names.values():
        x = x.join(df.drop("stock_abbr"), KEY, "full_outer")
    col = F.col
    a, li, e = col("asset_total_assets"), col("liability_total_liabilities"), col("equity_total_equity")
    o, i, f, net = col("operating_cf_net_amount"), col("investing_cf_net_amount"), col("financing_cf_net_amount"), col("net_cash_flow")
    cost, profit, eps = col("operating_expense_cost_of_sales"), col("net_profit"), col("eps")
    r = plausible_revenue(col("total_operating_revenue"), col("kpi_revenue"), cost, profit)
    pct = lambda p, q: F.try_divide(p * 100, q)
    shares = share_count(profit, eps)
    roe = pct(profit, e)
    fy = suffix(col("report_period")) == "FY"
    rules = [
        rule("balance_equation", li + e, a, 1.0, 0.02),
        rule("cash_flow_equation", net, o + i + f, 1.0, 0.03),
        rule("gross_profit_margin_consistency", col("gross_profit_margin"), pct(r - cost, r), 3.0, 0.08),
        rule("net_profit_margin_consistency", col("net_profit_margin"), pct(profit, r), 3.0, 0.08),
        rule("margin_order_consistency", col("net_profit_margin"), col("gross_profit_margin"), 20.0, 0.0, "upper"),
        rule("eps_net_profit_sign_consistency", eps, profit, 0.0, 0.0, "sign", (eps != 0) & (profit != 0)),
        rule("roe_consistency", col("roe"), roe, 8.0, 0.8, gate=fy & (e > 0) & (F.abs("roe") <= 100) & (F.abs(roe) <= 100) & (col("roe") * roe > 0)),
        rule("net_asset_per_share_consistency", col("net_asset_per_share"), F.try_divide(e * 10_000, shares), 0.2, 0.08),
        rule("operating_cf_per_share_consistency", col("operating_cf_per_share"), F.try_divide(o * 10_000, shares), 0.2, 0.08),
    ]
    for name, flow in (("operating", o), ("investing", i), ("financing", f)):
        ratio = f"{name}_cf_ratio_of_net_cf"
        if ratio in x.columns:
            rules.append(rule(f"{name}_cf_ratio_consistency", col(ratio), pct(flow, F.nullif(net, F.lit(0.0))), 2.0, 0.05))
    if "asset_liability_ratio" in x.columns:
        rules.append(rule("asset_liability_ratio_consistency", col("asset_liability_ratio"), pct(li, a), 1.0, 0.02))
    out = evaluate(x, rules)
    for name, column, expected in (
        ("operating_revenue_qoq_consistency", "operating_revenue_qoq_growth", lambda: qoq_reset(income, "total_operating_revenue")),
        ("net_profit_qoq_consistency", "net_profit_qoq_growth", lambda: qoq_reset(income, "net_profit")),
        ("net_profit_excl_non_recurring_yoy_consistency", "net_profit_excl_non_recurring_yoy", lambda: yoy(kpi, "net_profit_excl_non_recurring").withColumnRenamed("yoy", "expected")),
    ):
        if column in kpi.columns:
            rows = kpi.select(*KEY, F.col(column).alias("actual")).join(expected(), KEY)
            out = out.unionByName(evaluate(rows, [rule(name, col("actual"), col("expected"), 5.0, 0.15)]))
    return out


def rule_summary(detail: DataFrame) -> DataFrame:
    """E-12: applicable, passed and failed rows of each rule, and the pass rate."""
    out = detail.groupBy("rule").agg(F.count("*").alias("applicable"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return out.withColumn("pass_rate", F.round(F.col("passed") / F.col("applicable"), 4))


def overall(summary: DataFrame) -> DataFrame:
    """E-12: all rules together."""
    return summary.agg(F.count("*").alias("rules"), F.sum("applicable").alias("applicable"), F.sum("passed").alias("passed"), F.sum("failed").alias("failed"))


def worst_rules(summary: DataFrame, n: int = 8) -> DataFrame:
    """E-12: the n rules with the largest share of failures, by name on ties, with their place."""
    rate = F.round(F.try_divide("failed", "applicable"), 4)
    first = summary.select("rule", F.coalesce(rate, F.lit(0.0)).alias("failure_rate"), "failed").orderBy(F.desc("failure_rate"), "rule").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc("failure_rate"), "rule")))  # over n rows


def prechecks(income: DataFrame, kpi: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """R-20 to R-24: issues found before loading: key, rule. (R-17 to R-19 are required_fields, duplicate_keys, anomalies.)"""
    x = balance.join(cash.drop("stock_abbr"), KEY, "full_outer").join(income.drop("stock_abbr"), KEY, "full_outer").join(kpi.select(*KEY, "gross_profit_margin", "net_profit_margin"), KEY, "full_outer")

    def far(rule: str, ratio: str, part: Column, whole: Column, gap: float) -> dict[str, Column]:
        return {rule: F.abs(F.try_divide(part, F.nullif(whole, F.lit(0.0))) * 100 - F.col(ratio)) > gap} if ratio in x.columns else {}

    col = F.col
    a, net = col("asset_total_assets"), col("net_cash_flow")
    flows = col("operating_cf_net_amount") + col("investing_cf_net_amount") + col("financing_cf_net_amount")
    r = col("total_operating_revenue")
    found = {
        "balance_equation_precheck": F.abs(col("liability_total_liabilities") + col("equity_total_equity") - a) > F.greatest(F.lit(100.0), F.abs(a) * 0.02),
        "cash_flow_equation_precheck": F.abs(net - flows) > F.greatest(F.lit(100.0), F.abs(net) * 0.05),
        "gross_profit_margin_consistency_precheck": F.abs(col("gross_profit_margin") - F.try_divide((r - col("operating_expense_cost_of_sales")) * 100, r)) > 5,
        "net_profit_margin_consistency_precheck": F.abs(col("net_profit_margin") - F.try_divide(col("net_profit") * 100, r)) > 5,
    }
    found |= far("asset_liability_ratio_consistency", "asset_liability_ratio", col("liability_total_liabilities"), a, 5)
    for flow in ("operating", "investing", "financing"):
        found |= far(f"{flow}_cf_ratio_of_net_cf_consistency_precheck", f"{flow}_cf_ratio_of_net_cf", col(f"{flow}_cf_net_amount"), net, 10)
    return x.select(*KEY, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))).alias("rule"))


def required_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """R-17"""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return df.select(*KEY, F.explode(missing).alias("missing"))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """R-18, E-11"""
    return df.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def unpivoted(df: DataFrame) -> DataFrame:
    """Key, field, value of all doubles."""
    fields = [c for c, t in df.dtypes if t == "double"]
    return df.unpivot(KEY, fields, "field", "value")


def anomalies(df: DataFrame) -> DataFrame:
    """E-8, R-19: percentages over 1,000, but for shares of the net cash flow, and amounts over 1e8."""
    kinds = {c: kind(c, t) for c, t in df.dtypes if not c.endswith("_ratio_of_net_cf")}
    of = F.when(F.col("field").isin([c for c, k in kinds.items() if k == "ratio"]) & (F.abs("value") > 1000), "percentage").when(F.col("field").isin([c for c, k in kinds.items() if k == "amount"]) & (F.abs("value") > 1e8), "amount")
    return unpivoted(df).withColumn("anomaly", of).where("anomaly is not null")


def anomaly_counts(found: DataFrame) -> DataFrame:
    """E-9"""
    return found.groupBy("field", "anomaly").agg(F.count("*").alias("n"))


def sheet_sizes(sheets: dict[str, DataFrame]) -> DataFrame:
    """E-1: rows of each sheet, and their mean number of filled figures."""
    def one(name: str, df: DataFrame) -> DataFrame:
        filled = sum((F.col(c).isNotNull().cast("int") for c, t in df.dtypes if t == "double"), F.lit(0))
        return df.agg(F.lit(name).alias("sheet"), F.count("*").alias("n_records"), F.round(F.avg(filled), 2).alias("mean_fields"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in sheets.items()])


def field_coverage(sheets: dict[str, DataFrame]) -> DataFrame:
    """E-2: filled and missing values of each field, also of an empty sheet."""
    def one(name: str, df: DataFrame) -> DataFrame:
        fields = [c for c, t in df.dtypes if t == "double"]
        counts = df.agg(F.count("*").alias("n_records"), *[F.count(c).alias(c) for c in fields])
        return counts.unpivot(["n_records"], fields, "field", "n_filled").withColumn("sheet", F.lit(name))
    rows = reduce(DataFrame.unionByName, [one(n, d) for n, d in sheets.items()])
    return rows.select("sheet", "field", "n_records", "n_filled", (F.col("n_records") - F.col("n_filled")).alias("n_missing"), F.round(F.try_divide("n_filled", "n_records"), 4).alias("coverage"))


def mean_coverage(coverage: DataFrame) -> DataFrame:
    """E-4: mean coverage of each sheet, and its fields under one half."""
    low = F.array_join(F.sort_array(F.collect_list(F.when(F.col("coverage") < 0.5, F.col("field")))), ",")
    return coverage.groupBy("sheet").agg(F.round(F.avg("coverage"), 4).alias("mean_coverage"), low.alias("low_fields"))


def missing_examples(df: DataFrame, n: int = 10) -> DataFrame:
    """E-3: the first n keys that miss a field. The field's rows are numbered with a limit before they are gathered."""
    fields = [c for c, t in df.dtypes if t == "double"]
    gone = F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields])))
    rows = df.select(F.concat_ws("|", "stock_code", "report_period").alias("key"), gone.alias("field"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy("key"))).where(F.col("r") <= n)
    return first.groupBy("field").agg(F.array_join(F.sort_array(F.collect_list("key")), ";").alias("keys"))


#: For fields of each form, figures without which they are missing and the reasons then, in order, and the reason otherwise.
MISSING = (
    (r"^net_asset_per_share$", (("eps", "missing_share_basis"),), "derivation_inputs_incomplete"),
    (r"^operating_cf_per_share$", (("operating_cf_net_amount", "upstream_cash_flow_missing"), ("eps", "missing_share_basis")), "derivation_inputs_incomplete"),
    (r"^net_cash_flow_yoy_growth$", (("net_cash_flow", "upstream_net_cash_flow_missing"),), "prior_period_value_unavailable"),
    (r"^(.*)_ratio_of_net_cf$", (("net_cash_flow", "upstream_net_cash_flow_missing"), (r"\1_net_amount", "upstream_cash_flow_missing")), "derivation_inputs_incomplete"),
    (r"^equity_unappropriated_profit$", (), "statement_tail_not_stable"),
    (r"^(gross_profit_margin|net_profit_margin|roe_weighted_excl_non_recurring)$", (), "derivable_but_inputs_missing"),
)


def missing_reason(field: str, columns: list[str]) -> Column:
    """E-5: why a row lacks a field. Figures that the rows don't have at all count as missing."""
    if field.endswith("_qoq_growth"):
        return F.when(suffix(F.col("report_period")).isin("FY", "H1"), "likely_not_disclosed_in_source").otherwise("likely_extraction_gap")
    for form, needs, otherwise in MISSING:
        if found := re.match(form, field):
            gone = [(F.col(c).isNull() if c in columns else F.lit(True), why) for c, why in ((found.expand(c), why) for c, why in needs)]
            return F.coalesce(*[F.when(g, F.lit(why)) for g, why in gone], F.lit(otherwise))
    return F.lit("likely_extraction_gap")


def missing_reasons(df: DataFrame) -> DataFrame:
    """E-5, E-6: missing values of each field, the most frequent reason (by name on ties), and all reasons with their numbers as JSON."""
    fields = [c for c, t in df.dtypes if t == "double"]
    gaps = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("field"), missing_reason(c, df.columns).alias("reason"))) for c in fields]
    counts = df.select(F.explode(F.array_compact(F.array(*gaps))).alias("x")).groupBy("x.field", "x.reason").agg(F.count("*").alias("n"))
    by = F.struct((-F.col("n")).alias("n"), F.col("reason").alias("r"))
    listed = F.transform(F.array_sort(F.collect_list(by)), lambda x: F.struct(x["r"], -x["n"]))
    return counts.groupBy("field").agg(F.sum("n").alias("n_missing"), F.min(by)["r"].alias("reason"), F.to_json(F.map_from_entries(listed)).alias("reasons"))


def missing_keys(df: DataFrame, n: int = 10) -> DataFrame:
    """E-6: for each field with gaps the first n keys without it, by code and period, as code|period."""
    fields = [c for c, t in df.dtypes if t == "double"]
    gaps = df.select("stock_code", "report_period", F.explode(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields]))).alias("field"))
    first = gaps.withColumn("place", F.row_number().over(Window.partitionBy("field").orderBy("stock_code", "report_period"))).where(F.col("place") <= n)
    key = F.struct("place", F.concat_ws("|", F.coalesce("stock_code", F.lit("")), F.coalesce("report_period", F.lit(""))).alias("key"))
    return first.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["key"]), " | ").alias("sample_keys"))


def most_missing(coverage: DataFrame, n: int = 8) -> DataFrame:
    """E-7"""
    place = F.row_number().over(Window.partitionBy("sheet").orderBy(F.desc("n_missing"), "field"))
    return coverage.where("n_missing > 0").withColumn("place", place).where(F.col("place") <= n).select("sheet", "field", "n_missing", "place")


def audit_sample(df: DataFrame, fields: list[str], n: int = 8) -> DataFrame:
    """E-10: the first n rows by period and code, with focus fields as text."""
    first = df.orderBy("report_period", "stock_code").limit(n)
    return first.select(*KEY, F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.col(c).isNotNull().cast("string")) for c in fields]).alias("filled"))


def skewed(df: DataFrame, column: str) -> DataFrame:
    """E-17: whether the largest size is 50 times the median's, of 5 values or more."""
    sizes = df.where(F.abs(column) > 0).select(F.abs(column).alias("size"))
    [mid] = percentiles(sizes, [("size", 0.5)])
    x = sizes.agg(F.count("*").alias("n"), F.max("size").alias("most"))
    return x.select("n", F.coalesce((F.col("n") >= 5) & (F.try_divide("most", F.lit(mid).cast("double")) >= 50), F.lit(False)).alias("skewed"))


def collapsed(df: DataFrame, category: str, value: str) -> DataFrame:
    """E-16: one value a category: the smallest if three quarters of all are 0 or less, else the largest."""
    [q] = percentiles(df, [(value, 0.75)])
    return df.groupBy(category).agg((F.min(value) if q is not None and q <= 0 else F.max(value)).alias("value"))


def first_seen(df: DataFrame, group: str, order: str, entity: str) -> DataFrame:
    """E-18: distinct entities of each group in order of first appearance."""
    first = df.groupBy(group, entity).agg(F.min(order).alias("at"))
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", entity))), lambda x: x[entity]), ",").alias("entities"))


def constant_columns(df: DataFrame) -> DataFrame:
    """E-19: text columns with one value."""
    names = [c for c, t in df.dtypes if t == "string"]
    counts = df.agg(*[F.countDistinct(F.trim(c)).alias(c) for c in names])
    return counts.unpivot([], names, "name", "n").where("n = 1").select("name")


def numeric_first(df: DataFrame, column: str, n: int) -> DataFrame:
    """S-1: numeric order if any value is a number (one aggregation decides), else that of text; then the first n."""
    number = F.try_to_number(F.col(column), F.lit("999999999999.999999")).cast("double")
    any_ = df.agg(F.bool_or(number.isNotNull())).first()[0]
    return df.orderBy((number if any_ else F.col(column)).desc_nulls_last(), column).limit(n)


def display_scale(df: DataFrame, column: str) -> DataFrame:
    """M-3: figures in 10k units if the largest is 1e5 or more, with the unit."""
    most = df.agg(F.max(F.abs(column)).alias("most"))
    large = F.col("most") >= 1e5
    return df.join(F.broadcast(most)).select(*[c for c in df.columns if c != column], F.when(large, F.col(column) / 10_000).otherwise(F.col(column)).alias(column), F.when(large, "x10k").otherwise("x1").alias("unit"))


def pie_shares(df: DataFrame, value: str) -> DataFrame:
    """M-4: shares of values with negatives as 0; nothing if they sum to 0."""
    x = df.withColumn(value, F.greatest(F.col(value), F.lit(0.0)))
    total = x.agg(F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("total")).where("total > 0")
    return x.join(F.broadcast(total)).withColumn("share", F.col(value) / F.col("total")).drop("total")


def profile(df: DataFrame, numbers: list[str], period: str) -> DataFrame:
    """M-1: rows, columns, numeric columns and distinct periods of a result."""
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.lit(len(numbers)).alias("n_numeric"), F.countDistinct(period).alias("n_periods"))


def skew_flags(df: DataFrame, numbers: list[str]) -> DataFrame:
    """M-1, E-17: for each numeric column the number of sizes over 0 and whether the largest is 50 times their median, of 5 or more."""
    sizes = stored(df.select(*[F.when(F.abs(c) > 0, F.abs(c)).alias(c) for c in numbers]))
    mids = percentiles(sizes, [(c, 0.5) for c in numbers])
    aggs = sizes.agg(*[F.struct(F.count(c).alias("n"), F.max(c).alias("most"), F.lit(mid).cast("double").alias("mid")).alias(c) for c, mid in zip(numbers, mids, strict=True)])
    rows = aggs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("x")) for c in numbers])).alias("r")).select("r.column", "r.x.*")
    return rows.select("column", "n", F.coalesce((F.col("n") >= 5) & (F.try_divide("most", "mid") >= 50), F.lit(False)).alias("skewed"))


def chart_table(df: DataFrame, series: str, value: str, n: int) -> DataFrame:
    """M-2: the n largest of each series, with their place."""
    place = F.row_number().over(Window.partitionBy(series).orderBy(F.desc_nulls_last(value), *[c for c in df.columns if c not in (series, value)]))
    return df.withColumn("place", place).where(F.col("place") <= n)
