"""Analytic query shapes on the wide view (Q family): DataFrame to DataFrame, parameters for periods, metrics and bounds.

A rank over a whole period is only taken of its first n rows (orderBy with limit, then a window over those n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .quantiles import percentiles
from .view import kind, period_order

WHO = ["stock_code", "stock_abbr"]


def in_period(view: DataFrame, period: str) -> DataFrame:
    return view.where(F.col("report_period") == period)


def at(period: str, metric: str) -> Column:
    """The metric's value in a period, as an aggregate of a company's rows."""
    return F.max(F.when(F.col("report_period") == period, F.col(metric)))


def lookup(view: DataFrame, company: str, period: str, metrics: list[str]) -> DataFrame:
    """Q-1"""
    return in_period(view, period).where(F.col("stock_code") == company).select(*WHO, "report_period", *metrics)


def above_median_below_mean(view: DataFrame, period: str, high: str, low: str) -> DataFrame:
    """Q-2: above the median of one metric, below the mean of another."""
    rows = stored(in_period(view, period).select(*WHO, high, low))
    [mid] = percentiles(rows, [(high, 0.5)])
    mean = rows.agg(F.avg(low).alias("mean"))
    return rows.join(F.broadcast(mean)).where((F.col(high) > F.lit(mid).cast("double")) & (F.col(low) < F.col("mean"))).select(*WHO, high, low)


def consecutive_above(view: DataFrame, periods: list[str], metrics: list[str], bounds: list[float]) -> DataFrame:
    """Q-3: rows of companies that are above all bounds in every one of the periods."""
    rows = view.where(F.col("report_period").isin(periods))
    good = rows.where(reduce(lambda a, b: a & b, [F.col(m) > x for m, x in zip(metrics, bounds, strict=True)]))
    keep = good.groupBy("stock_code").agg(F.countDistinct("report_period").alias("n")).where(F.col("n") == len(periods))
    return rows.join(keep, "stock_code", "left_semi").select(*WHO, "report_period", *metrics)


def always_positive(view: DataFrame, periods: list[str], metric: str) -> DataFrame:
    """Q-4"""
    rows = view.where(F.col("report_period").isin(periods)).groupBy(*WHO).agg(F.count("*").alias("n"), F.min(metric).alias("least"))
    return rows.where((F.col("n") == len(periods)) & (F.col("least") > 0)).select(*WHO, "least")


def cagr(view: DataFrame, start: str, end: str, years: int, metric: str) -> DataFrame:
    """Q-5: compound growth in percent; a start over 0."""
    out = view.groupBy(*WHO).agg(at(start, metric).alias("first"), at(end, metric).alias("last")).where("first > 0 and last > 0")
    return out.select(*WHO, ((F.pow(F.col("last") / F.col("first"), 1.0 / years) - 1) * 100).alias("cagr"))


def cagr_histogram(view: DataFrame, start: str, end: str, years: int, metric: str, width: int = 10) -> DataFrame:
    """Q-6: companies by bins of growth; nothing if fewer than two companies have it."""
    rows = cagr(view, start, end, years, metric)
    bins = rows.groupBy((F.floor(F.col("cagr") / width) * width).cast("long").alias("bin")).agg(F.count("*").alias("companies"))
    enough = rows.agg(F.count("*").alias("all")).where("all >= 2").select(F.lit(1).alias("ok"))
    return bins.join(F.broadcast(enough)).drop("ok")


def count_companies(view: DataFrame, period: str, condition: Column) -> DataFrame:
    """Q-7"""
    return in_period(view, period).where(condition).agg(F.countDistinct("stock_code").alias("companies"))


def screen(view: DataFrame, period: str, conditions: list[Column], columns: list[str]) -> DataFrame:
    """Q-8"""
    return in_period(view, period).where(reduce(lambda a, b: a & b, conditions)).select(*WHO, *columns)


def cumulative_qoq(view: DataFrame, year: int, metric: str) -> DataFrame:
    """Q-9: third quarter alone (Q3 - H1) against the second (H1 - Q1), in percent."""
    x = view.groupBy(*WHO).agg(*[at(f"{year}{s}", metric).alias(s) for s in ("Q1", "H1", "Q3")])
    return x.withColumn("q3", F.col("Q3") - F.col("H1")).withColumn("q2", F.col("H1") - F.col("Q1")).where("q2 is not null and q3 is not null").select(*WHO, "q2", F.col("q3").alias("third"), F.try_divide((F.col("q3") - F.col("q2")) * 100, F.abs("q2")).alias("growth"))


def two_period_growth(view: DataFrame, before: str, now: str, metric: str) -> DataFrame:
    """Q-10"""
    a = in_period(view, before).select("stock_code", F.col(metric).alias("before"))
    b = in_period(view, now).select(*WHO, F.col(metric).alias("now"))
    return b.join(a, "stock_code").where("before is not null and now is not null and before <> 0").select(*WHO, "before", "now", ((F.col("now") - F.col("before")) * 100 / F.abs("before")).alias("growth"))


def top(view: DataFrame, period: str, order: Column | str, n: int, columns: list[str], ascending: bool = False) -> DataFrame:
    """Q-16, Q-17: the n largest (or smallest), ties to the smaller code; nulls never."""
    key = F.col(order) if isinstance(order, str) else order
    rows = in_period(view, period).where(key.isNotNull())
    return rows.orderBy(key.asc() if ascending else key.desc(), "stock_code").limit(n).select(*WHO, *columns)


def ranked(view: DataFrame, period: str, metric: str, n: int, name: str = "rank", ascending: bool = False) -> DataFrame:
    """The first n with their place."""
    rows = top(view, period, metric, n, [metric], ascending)
    key = F.col(metric).asc() if ascending else F.col(metric).desc()
    return rows.withColumn(name, F.row_number().over(Window.orderBy(key, "stock_code")))


def top_of_both(view: DataFrame, period: str, a: str, b: str, n: int = 10) -> DataFrame:
    """Q-11: among the first n of both rankings."""
    return ranked(view, period, a, n, "rank_a").join(ranked(view, period, b, n, "rank_b").drop("stock_abbr"), "stock_code")


def average_change(view: DataFrame, before: str, now: str, metric: str) -> DataFrame:
    """Q-12"""
    x = view.agg(F.avg(F.when(F.col("report_period") == before, F.col(metric))).alias("mean_before"), F.avg(F.when(F.col("report_period") == now, F.col(metric))).alias("mean_now"))
    return x.withColumn("growth", F.try_divide((F.col("mean_now") - F.col("mean_before")) * 100, F.abs("mean_before")))


def below_first_mean(view: DataFrame, period: str, metric: str, n: int = 10) -> DataFrame:
    """Q-13: of the first n by code, those below their mean."""
    first = in_period(view, period).orderBy("stock_code").limit(n).select(*WHO, metric)
    return first.withColumn("mean", F.avg(metric).over(Window.partitionBy(F.lit(1)))).where(F.col(metric) < F.col("mean"))


def largest_growth(view: DataFrame, before: str, now: str, metric: str) -> DataFrame:
    """Q-14"""
    x = view.where(F.col("report_period").isin(before, now)).groupBy(*WHO).agg(at(before, metric).alias("before"), at(now, metric).alias("now"))
    return x.withColumn("change", F.col("now") - F.col("before")).where("change is not null").orderBy(F.desc("change"), "stock_code").limit(1)


def top_with_status(view: DataFrame, period: str, metric: str, n: int = 10) -> DataFrame:
    """Q-15: the first n, their mean, and whether they are over twice it."""
    first = top(view, period, metric, n, [metric])
    return first.withColumn("mean", F.avg(metric).over(Window.partitionBy(F.lit(1)))).withColumn("status", F.when(F.col(metric) > 2 * F.col("mean"), "abnormal").otherwise("normal"))


def top_then_lookup(view: DataFrame, period: str, other: str, metric: str, n: int = 10) -> DataFrame:
    """Q-18: the first n with their figure in another period and the ratio of both."""
    then = in_period(view, other).select("stock_code", F.col(metric).alias("other"))
    return top(view, period, metric, n, [metric]).join(then, "stock_code", "left").withColumn("ratio", F.try_divide(metric, "other"))


def above_industry_ratio(view: DataFrame, period: str, a: str, b: str) -> DataFrame:
    """Q-19: companies whose ratio a / b is over the period's mean ratio."""
    rows = in_period(view, period).withColumn("ratio", F.try_divide(a, b))
    mean = rows.agg(F.avg("ratio").alias("mean"))
    return rows.join(F.broadcast(mean)).where("ratio > mean").select(*WHO, "ratio", "mean")


def bucket_counts(view: DataFrame, period: str, metric: str, edges: list[float]) -> DataFrame:
    """Q-20: companies in the ranges between edges; a range has the number of edges that its values reach."""
    bucket = sum(((F.col(metric) >= e).cast("int") for e in edges), F.lit(0))
    return in_period(view, period).where(F.col(metric).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("companies"))


def sign_groups(view: DataFrame, period: str, metric: str) -> DataFrame:
    """Q-21"""
    sign = F.when(F.col(metric) > 0, "gain").when(F.col(metric) < 0, "loss").otherwise("zero")
    return in_period(view, period).where(F.col(metric).isNotNull()).groupBy(sign.alias("sign")).agg(F.count("*").alias("companies"), F.avg(metric).alias("mean"))


def around_average(view: DataFrame, period: str, metric: str, other: str) -> DataFrame:
    """Q-22: above and below the mean of a metric, the mean of another."""
    rows = in_period(view, period).where(F.col(metric).isNotNull())
    mean = rows.agg(F.avg(metric).alias("mean"))
    side = F.when(F.col(metric) > F.col("mean"), "above").otherwise("below")
    return rows.join(F.broadcast(mean)).groupBy(side.alias("side")).agg(F.count("*").alias("companies"), F.avg(other).alias("mean_other"))


def trend(view: DataFrame, metric: str) -> DataFrame:
    """Q-23"""
    return view.groupBy("report_period").agg(F.avg(metric).alias("mean"), F.count(metric).alias("companies"))


def both_ends(view: DataFrame, period: str, metric: str, n: int = 10) -> DataFrame:
    """Q-24"""
    ends = [top(view, period, metric, n, [metric], asc).withColumn("side", F.lit(s)) for s, asc in (("top", False), ("bottom", True))]
    return ends[0].unionByName(ends[1])


def top_by_period(view: DataFrame, periods: list[str], metric: str, n: int = 10) -> DataFrame:
    """Q-25"""
    return reduce(DataFrame.unionByName, [ranked(view, p, metric, n).withColumn("report_period", F.lit(p)) for p in periods])


def places(rows: DataFrame, group: str, metric: str, tie: str, buckets: int = 64) -> DataFrame:
    """rows with place, the exact rank by falling metric, then tie, within its group; metric and tie are not null. rows is read several times.

    Ranks are counted within ranges of (metric, tie), and the rows of the ranges before are added, so no task sorts a whole group, also where most rows share a
    value. Edges come from a sample of 16 rows a bucket; they only balance the ranges."""
    key = F.struct((-F.col(metric)).cast("double").alias("m"), F.col(tie).cast("string").alias("t"))
    sample = rows.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(16 * buckets).collect()
    edges = sorted((r["k"]["m"], r["k"]["t"]) for r in sample)[15::16]
    every = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(t).alias("t")) for m, t in edges]) if edges else F.array().cast("array<struct<m:double,t:string>>")
    x = rows.withColumn("#key", key).withColumn("#range", F.size(F.filter(every, lambda e: e <= F.col("#key"))))
    before = F.coalesce(F.sum("count").over(Window.partitionBy(group).orderBy("#range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = x.groupBy(group, "#range").count().select(group, "#range", before.alias("#before"))
    own = F.row_number().over(Window.partitionBy(group, "#range").orderBy("#key"))
    return x.withColumn("#own", own).join(counts, [group, "#range"]).withColumn("place", (F.col("#own") + F.col("#before")).cast("int")).drop("#key", "#range", "#own", "#before")


def rank_changes(view: DataFrame, before: str, now: str, metric: str, n: int = 10) -> DataFrame:
    """Q-26: the largest changes of place between two periods."""
    rows = stored(view.where(F.col("report_period").isin(before, now) & F.col(metric).isNotNull()).select(*WHO, "report_period", metric))
    x = places(rows, "report_period", metric, "stock_code").groupBy(*WHO).agg(at(before, "place").alias("before"), at(now, "place").alias("now"))
    return x.withColumn("change", F.col("before") - F.col("now")).where("change is not null").orderBy(F.desc(F.abs("change")), "stock_code").limit(n)


def cohort_mean(view: DataFrame, period: str, condition: Column, metric: str) -> DataFrame:
    """Q-27: a cohort with its own mean."""
    rows = in_period(view, period).where(condition)
    return rows.join(F.broadcast(rows.agg(F.avg(metric).alias("mean")))).select(*WHO, metric, "mean")


def lag_growth(view: DataFrame, suffix: str, metric: str) -> DataFrame:
    """Q-28: growth over the row before of the same suffix."""
    before = F.lag(metric).over(Window.partitionBy("stock_code").orderBy("report_year"))
    rows = view.where(F.col("report_period").endswith(suffix)).withColumn("before", before)
    return rows.select("stock_code", "report_period", metric, F.try_divide((F.col(metric) - F.col("before")) * 100, F.abs("before")).alias("growth"))


def series(view: DataFrame, company: str, metric: str) -> DataFrame:
    """Q-29: a company's figures in the order of periods, with their place."""
    place = F.row_number().over(Window.partitionBy("stock_code").orderBy("report_year", period_order(F.col("report_period"))))
    return view.where(F.col("stock_code") == company).select("stock_code", "report_period", metric, place.alias("place"))


def cohort_ratio(view: DataFrame, period: str, a: str, b: str, n: int = 10) -> DataFrame:
    """Q-30: ratio of sums over the first n."""
    return top(view, period, a, n, [a, b]).agg(F.try_divide(F.sum(F.col(a).cast("decimal(28,6)")).cast("double"), F.sum(F.col(b).cast("decimal(28,6)")).cast("double")).alias("ratio"))


def row_ratio(view: DataFrame, period: str, a: str, b: str) -> DataFrame:
    """Q-31"""
    return in_period(view, period).select(*WHO, F.try_divide(F.col(a), F.nullif(F.col(b), F.lit(0.0))).alias("ratio"))


def top_below_mean(view: DataFrame, period: str, stock: str, flow: str, n: int = 5) -> DataFrame:
    """Q-32: the first n by a stock figure, and whether their flow is under the period's mean."""
    mean = in_period(view, period).agg(F.avg(flow).alias("mean"))
    return top(view, period, stock, n, [stock, flow]).join(F.broadcast(mean)).withColumn("side", F.when(F.col(flow) < F.col("mean"), "below").otherwise("not below"))


def ever_negative(view: DataFrame, metric: str) -> DataFrame:
    """Q-33"""
    return view.where(F.col(metric) < 0).select(*WHO, "report_period").distinct()


def named_like(view: DataFrame, pattern: str, period: str, metric: str) -> DataFrame:
    """Q-34"""
    return in_period(view, period).where(F.col("stock_abbr").like(pattern)).select(*WHO, metric)


def averages(view: DataFrame, period: str, metrics: list[str]) -> DataFrame:
    """Q-35"""
    return in_period(view, period).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])


def coverage(view: DataFrame, periods: list[str]) -> DataFrame:
    """Q-36: companies of each period, and those that have all."""
    rows = view.where(F.col("report_period").isin(periods)).select("stock_code", "report_period").distinct()
    full = rows.groupBy("stock_code").count().where(F.col("count") == len(periods)).agg(F.count("*").alias("companies")).select(F.lit("all").alias("report_period"), "companies")
    return rows.groupBy("report_period").agg(F.count("*").alias("companies")).unionByName(full)


def available_periods(view: DataFrame, n: int = 8) -> DataFrame:
    """Q-36: each company's latest periods, newest first."""
    order = F.struct((-F.col("report_year")).alias("y"), (-period_order(F.col("report_period"))).alias("o"), F.col("report_period").alias("p"))
    return view.groupBy("stock_code").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_set(order)), 1, n), lambda x: x["p"]), ",").alias("periods"))


def relevant(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Q-37: rows with any of the metrics."""
    return rows.where(F.coalesce(*metrics).isNotNull())


def validation(rows: DataFrame, ratios: list[str], numbers: list[str]) -> DataFrame:
    """Q-38: what speaks against a result, in one row."""
    bad = ~F.col("report_period").rlike(r"^[0-9]{4}(Q1|Q2|H1|Q3|Q4|FY)$")
    high = percentiles(rows.select(*[F.abs(c).alias(c) for c in ratios]), [(c, 0.9) for c in ratios])
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("report_period").alias("n_periods"),
        F.count_if(bad).alias("odd_periods"),
        F.coalesce(F.bool_and(F.coalesce(F.greatest(*[F.coalesce(F.abs(c), F.lit(0.0)) for c in numbers]) if len(numbers) > 1 else F.coalesce(F.abs(numbers[0]), F.lit(0.0)), F.lit(0.0)) == 0), F.lit(True)).alias("all_zero"),
        *[F.lit(q is not None and not q <= 1000).alias(f"{c}_too_large") for c, q in zip(ratios, high, strict=True)],
    )


def without_flat_growth(rows: DataFrame) -> DataFrame:
    """Q-39: drops growth columns that are about 0 throughout (one aggregation decides)."""
    names = [c for c, t in rows.dtypes if kind(c, t) == "ratio" and ("growth" in c or "yoy" in c or "qoq" in c)]
    if not names:
        return rows
    most = rows.agg(*[F.max(F.abs(c)).alias(c) for c in names]).first()
    return rows.drop(*[c for c in names if (most[c] or 0.0) <= 1e-9])
