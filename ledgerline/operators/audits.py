"""What a review of extracted sheets gets: candidate pages (C-13), issues by severity (E-1, E-9), rows to check by hand (E-10), remarks that all rows share (E-19)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Contents pages, unless they name the report; how many labels of a sheet make a page one of its candidates; digits that do so alone.
CONTENTS, REPORT = "目录", "财务报告"
LEAST_LABELS, DIGITS = {"kpi": 2}, 80
#: Figures of each sheet that are checked by hand; how many rows.
FOCUS = {
    "kpi": ["total_operating_revenue", "net_profit_10k_yuan", "eps", "roe", "net_profit_excl_non_recurring"],
    "balance": ["asset_total_assets", "liability_total_liabilities", "equity_unappropriated_profit", "equity_total_equity"],
    "cash": ["operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount", "net_cash_flow"],
    "income": ["total_operating_revenue", "total_operating_expenses", "operating_profit", "net_profit"],
}
CHECKED = 8
#: Columns that name rows, words of names of remarks, and how a shared remark is cited.
NAMING = ("stock_code", "stock_abbr", "report_period", "report_year", "current_period", "base_period", "base_profit_status")
REMARKS, CITED = ("评价", "说明", "判断", "结论"), "研报证据支撑："


def candidate_pages(pages: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """C-13: a row for each page and sheet that may stand on it, with the number of the sheet's labels found and the page's digits.

    labels: those of each sheet; spaces and forms of brackets don't count, and labels that differ in those alone count each. Contents pages are left
    out; pages with 80 digits are candidates of every sheet. Null texts are no pages. Other columns stay."""
    clean = lambda words: [w.translate(str.maketrans("（）：", "():")).replace(" ", "") for w in words]
    rows = pages.withColumns({"#clean": T.clean_label(F.col("text")), "digits": F.regexp_count("text", F.lit(r"\p{Nd}"))})
    rows = rows.where(~(F.contains("#clean", F.lit(CONTENTS)) & ~F.contains("#clean", F.lit(REPORT))))
    found = lambda words: F.size(F.filter(F.array(*map(F.lit, clean(words))), lambda w: F.contains("#clean", w))) if words else F.lit(0)
    each = F.array(*[F.struct(F.lit(s).alias("sheet"), found(words).alias("hits"), F.lit(LEAST_LABELS.get(s, 1)).alias("least")) for s, words in labels.items()])
    rows = rows.withColumn("#x", F.explode(F.filter(each, lambda x: (x["hits"] >= x["least"]) | (F.col("digits") >= DIGITS))))
    return rows.withColumns({"sheet": F.col("#x.sheet"), "hits": F.col("#x.hits")}).drop("#clean", "#x")


def issue_counts(issues: DataFrame) -> DataFrame:
    """E-1: issues (sheet, severity) of each sheet and severity, named `sheet|severity`. A missing one is an empty text."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return issues.groupBy(F.concat(name("sheet"), F.lit("|"), name("severity")).alias("issue")).agg(F.count("*").alias("n"))


def anomaly_summary(anomalies: DataFrame, issues: DataFrame) -> DataFrame:
    """E-9: numbers of anomalies (sheet, field, anomaly) of each kind, and of issues (sheet, rule, severity), whose kind is validation_<severity>."""
    found = anomalies.groupBy("sheet", "field", "anomaly").agg(F.count("*").alias("n"))
    kind = F.concat(F.lit("validation_"), F.coalesce("severity", F.lit("")))
    return found.unionByName(issues.groupBy("sheet", F.col("rule").alias("field"), kind.alias("anomaly")).agg(F.count("*").alias("n")))


def rows_to_check(sheets: dict[str, DataFrame], n: int = CHECKED) -> DataFrame:
    """E-10: the first n rows of each sheet by period and code (missing ones first), with the sheet's figures to check as JSON (null where the row or the
    sheet has none). Each sheet is a limited sort, of which n rows a task move."""
    def one(name: str, df: DataFrame) -> DataFrame:
        order = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("report_period", "stock_code")]
        figures = [(F.col(c) if c in df.columns else F.lit(None).cast("double")).alias(c) for c in FOCUS.get(name, [])]
        values = F.to_json(F.struct(*figures), {"ignoreNullFields": "false"}) if figures else F.lit("{}")
        first = df.orderBy(*order, F.coalesce(F.col("stock_abbr"), F.lit("")), values).limit(n)
        return first.select(F.lit(name).alias("sheet"), "stock_code", "stock_abbr", "report_period", "report_year", values.alias("sampled_field_values"), F.lit("").alias("audit_status"), F.lit("").alias("audit_notes"))

    return reduce(DataFrame.unionByName, [one(name, df) for name, df in sheets.items()])


def shared_remarks(df: DataFrame) -> DataFrame:
    """E-19: remarks that all rows share: of each column of text whose name says a judgement, its only value but for blanks, as it is cited.

    One aggregation of least and greatest values decides; no values are gathered. Columns that name rows are left out."""
    names = [c for c, t in df.dtypes if t == "string" and c not in NAMING and any(w in c for w in REMARKS)]
    if not names:
        return df.select(F.lit("").alias("column"), F.lit("").alias("note")).limit(0)
    said = {c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in names}
    ends = df.agg(*[F.struct(F.min(x).alias("a"), F.max(x).alias("b")).alias(c) for c, x in said.items()])
    rows = ends.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("x")) for c in names])).alias("r"))
    return rows.where("r.x.a = r.x.b").select("r.column", F.concat(F.lit(CITED), F.col("r.x.a")).alias("note"))
