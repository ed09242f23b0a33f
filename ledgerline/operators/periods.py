"""Record consolidation, derivation and period algebra (D family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.statements import KEY
from .view import kind, suffix

CUMULATIVE = ("Q1", "H1", "Q3", "FY")


def source_rank(method: Column) -> Column:
    """D-1: trust in an extraction method."""
    return F.when(method.contains("pdfplumber") | method.contains("pymupdf"), 4).when(method.contains("camelot"), 3).when(method.contains("text_fallback"), 2).when(method.contains("combined_text"), 1).otherwise(0)


def consolidate(candidates: DataFrame, fields: list[str]) -> DataFrame:
    """D-2: for each key the first non-null value of each field by rank of source, non-null fields, then source; and the sources used, in that order."""
    filled = sum(F.col(f).isNotNull().cast("int") for f in fields)
    place = F.struct((-source_rank(F.col("source_method"))).alias("r"), (-filled).alias("n"), F.col("source_method").alias("s"))
    rows = candidates.withColumn("place", place)
    picks = [F.min_by(f, F.when(F.col(f).isNotNull(), F.col("place"))).alias(f) for f in fields]
    sources = F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list("place")), lambda x: x["s"])), ";")
    return rows.groupBy(*KEY).agg(*picks, sources.alias("sources"))


def mismatch(a: Column, b: Column, least: float, share: float) -> Column:
    return F.abs(a - b) > F.greatest(F.lit(least), F.abs(b) * share)


def derive_balance(balance: DataFrame) -> DataFrame:
    """D-3: contract liabilities from advances; equity from A - L where missing or off; liability ratio."""
    gap = F.col("asset_total_assets") - F.col("liability_total_liabilities")
    off = F.abs(F.col("equity_total_equity") - gap) > F.greatest(F.lit(100.0), F.abs("asset_total_assets") * 0.02)
    return balance.withColumns({
        "liability_contract_liabilities": F.coalesce("liability_contract_liabilities", "liability_advance_from_customers"),
        "equity_total_equity": F.when(F.col("equity_total_equity").isNull() | off, gap).otherwise(F.col("equity_total_equity")),
        "asset_liability_ratio": F.try_divide(F.col("liability_total_liabilities") * 100, F.col("asset_total_assets")),
    })


def impute_cash(cash: DataFrame) -> DataFrame:
    """D-4: any one of net, operating, investing and financing flow from the other three; earlier fills feed later ones; then ratios."""
    net, o, i, f = "net_cash_flow", "operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount"
    cash = cash.withColumn(net, F.coalesce(net, F.col(o) + F.col(i) + F.col(f)))
    for x, (a, b) in ((o, (i, f)), (i, (o, f)), (f, (o, i))):
        cash = cash.withColumn(x, F.coalesce(x, F.col(net) - F.col(a) - F.col(b)))
    return cash.withColumns({f"{x.split('_')[0]}_cf_ratio_of_net_cf": F.try_divide(F.col(x) * 100, F.col(net)) for x in (o, i, f)})


def repair_cash(cash: DataFrame) -> DataFrame:
    """D-14: where all three components are known, a net flow that is missing or far too small for them gives way to their sum; then
    ratios that are missing, beyond 1,000, far from the flows, or of a replaced net flow are computed anew."""
    flows = {x: F.col(f"{x}_cf_net_amount") for x in ("operating", "investing", "financing")}
    total, net = sum(flows.values(), F.lit(0.0)), F.abs("net_cash_flow")
    size = F.greatest(*[F.abs(c) for c in flows.values()], F.abs(total))
    swap = total.isNotNull() & (net.isNull() | ((net <= 1e-3) & (size >= 100)) | ((net <= 1) & (size >= 10_000)))
    out = cash.withColumn("#swap", swap).withColumn("net_cash_flow", F.when(F.col("#swap"), total).otherwise(F.col("net_cash_flow")))
    known = F.coalesce(F.col("net_cash_flow") != 0, F.lit(False))

    def ratio(x: str) -> Column:
        name = f"{x}_cf_ratio_of_net_cf"
        old = F.col(name) if name in cash.columns else F.lit(None).cast("double")
        new = F.try_divide(flows[x], "net_cash_flow") * 100
        bad = F.col("#swap") | old.isNull() | (F.abs(old) > 1000) | (F.abs(old - new) > F.greatest(F.lit(10.0), F.abs(new) * 0.2))
        return F.when(known & flows[x].isNotNull() & bad, new).otherwise(old)

    return out.withColumns({f"{x}_cf_ratio_of_net_cf": ratio(x) for x in flows}).drop("#swap")


def field_rule(mode: str, direct: Column, reuse: Column | None = None, derived: Column | None = None) -> Column:
    """D-5: how a field is filled from its own value, another sheet's and a derived one. Zero counts as missing where a value is reused."""
    full = lambda c: F.nullif(c, F.lit(0.0)) if c is not None else F.lit(None)
    reuse_, derived_ = (c if c is not None else F.lit(None).cast("double") for c in (reuse, derived))
    return {
        "direct": direct,
        "reuse": reuse_,
        "direct_or_reuse": F.coalesce(full(direct), reuse_, direct),
        "prefer_reuse": F.coalesce(full(reuse_), direct),
        "derive": derived_,
        "direct_or_derive": F.coalesce(direct, derived_),
        "prefer_derive": F.coalesce(derived_, direct),
    }[mode]


def plausible_revenue(income: Column, kpi: Column, cost: Column, profit: Column) -> Column:
    """D-7: of two revenues the more plausible by the margins that it implies; ties go to the larger."""
    def badness(r: Column) -> Column:
        gross, net = F.try_divide((r - cost) * 100, r), F.try_divide(profit * 100, r)
        return F.when(gross.between(-100, 100), 0).otherwise(1) + F.when(net.between(-100, 100), 0).otherwise(1) + F.when(gross.isNull(), 1).otherwise(0)
    option = lambda r: F.when(r.isNotNull(), F.struct(badness(r).alias("b"), (-F.abs(r)).alias("s"), r.alias("v")))
    return F.least(option(income), option(kpi))["v"]


def sanitize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """D-8: implausible eps, per-share figures, percentages and amounts (of all columns if none are named) become null."""
    limit = lambda c, t: 20.0 if c == "eps" else 200.0 if "per_share" in c else {"ratio": 1000.0, "amount": 1e8}.get(kind(c, t))
    limits = {c: limit(c, t) for c, t in df.dtypes if t == "double" and c in (columns or df.columns)}
    return df.withColumns({c: F.when(F.abs(c) <= x, F.col(c)) for c, x in limits.items() if x})


def single_quarters(df: DataFrame, value: str) -> DataFrame:
    """D-9: stock_code, report_year, q1 to q4: cumulative figures to single quarters; null without the direct predecessor."""
    at = {s: F.max(F.when(suffix(F.col("report_period")) == s, F.col(value))) for s in CUMULATIVE}
    out = df.groupBy("stock_code", "report_year").agg(*[c.alias(s) for s, c in at.items()])
    return out.select("stock_code", "report_year", F.col("Q1").alias("q1"), (F.col("H1") - F.col("Q1")).alias("q2"), (F.col("Q3") - F.col("H1")).alias("q3"), (F.col("FY") - F.col("Q3")).alias("q4"))


def growth(now: Column, before: Column) -> Column:
    return F.try_divide((now - before) * 100, F.abs(before))


def long_quarters(df: DataFrame, value: str) -> DataFrame:
    """stock_code, report_year, report_period, ord, single: the single quarter at each cumulative period that the company has."""
    q = single_quarters(df, value)
    rows = q.select("stock_code", "report_year", F.posexplode(F.array("q1", "q2", "q3", "q4")).alias("ord", "single"))
    rows = rows.withColumn("report_period", F.concat(F.col("report_year").cast("string"), F.element_at(F.array(*[F.lit(s) for s in CUMULATIVE]), F.col("ord") + 1)))
    return rows.join(df.select("stock_code", "report_period").distinct(), ["stock_code", "report_period"], "left_semi")


def qoq(df: DataFrame, value: str) -> DataFrame:
    """D-10: growth over the last known quarter of the year; gaps are bridged, first quarters have none."""
    w = Window.partitionBy("stock_code", "report_year").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return long_quarters(df, value).withColumn("before", F.last("single", ignorenulls=True).over(w)).select("stock_code", "report_period", "report_year", "single", F.when(F.col("ord") > 0, growth(F.col("single"), F.col("before"))).alias("qoq"))


def first_quarter_qoq(df: DataFrame, value: str) -> DataFrame:
    """D-11: growth of a first quarter over the fourth of the year before."""
    q = single_quarters(df, value)
    last = q.select("stock_code", (F.col("report_year") + 1).alias("report_year"), F.col("q4").alias("before"))
    return q.join(last, ["stock_code", "report_year"]).where("q1 is not null and before is not null").select("stock_code", "report_year", growth(F.col("q1"), F.col("before")).alias("qoq"))


def qoq_reset(df: DataFrame, value: str) -> DataFrame:
    """As the rules R-14 and R-15 need it: a gap resets the quarter before; first quarters compare with the last of the year before."""
    q = single_quarters(df, value).select("stock_code", "report_year", F.posexplode(F.array("q1", "q2", "q3", "q4")).alias("ord", "single"))
    rows = q.withColumn("at", F.col("report_year") * 4 + F.col("ord"))
    w = Window.partitionBy("stock_code").orderBy("at")
    before = F.when(F.lag("at").over(w) == F.col("at") - 1, F.lag("single").over(w))
    rows = rows.withColumn("expected", growth(F.col("single"), before)).where("expected is not null")
    return rows.select("stock_code", "report_year", F.concat(F.col("report_year").cast("string"), F.element_at(F.array(*[F.lit(s) for s in CUMULATIVE]), F.col("ord") + 1)).alias("report_period"), "expected")


def yoy(df: DataFrame, value: str) -> DataFrame:
    """D-12: growth over the last earlier year with a value, for the same suffix."""
    w = Window.partitionBy("stock_code", suffix(F.col("report_period"))).orderBy("report_year").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("before", F.last(value, ignorenulls=True).over(w)).select(*KEY, growth(F.col(value), F.col("before")).alias("yoy"))


def resolved(kpi: DataFrame, income: DataFrame) -> DataFrame:
    """D-13: revenue and profit from the KPI sheet, else from the income sheet."""
    i = income.select(*KEY, F.col("total_operating_revenue").alias("#r"), F.col("net_profit").alias("#p"))
    return kpi.join(i, KEY, "left").withColumns({"total_operating_revenue": F.coalesce("total_operating_revenue", "#r"), "net_profit_10k_yuan": F.coalesce("net_profit_10k_yuan", "#p")}).drop("#r", "#p")


def enrich_names(manifest: DataFrame, reference: DataFrame) -> DataFrame:
    """D-15: abbreviation by code, else code by abbreviation, else constants."""
    by_code = reference.select(F.col("stock_code").alias("#c"), F.col("stock_abbr").alias("#a"))
    out = manifest.join(by_code, F.col("stock_code") == F.col("#c"), "left").withColumn("name", F.coalesce("stock_abbr", "#a", F.lit("unknown"))).drop("#c", "#a")
    return out.join(by_code, F.col("name") == F.col("#a"), "left").withColumn("code", F.coalesce("stock_code", "#c", F.lit("000000"))).drop("#c", "#a")


