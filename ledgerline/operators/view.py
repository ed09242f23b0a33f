"""The wide company-by-period view and its parts (V family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.statements import KEY

#: Order of period suffixes, and what a derived quarter is the difference of.
PERIOD_ORDER = {"Q1": 1, "Q2": 2, "H1": 3, "Q3": 4, "Q4": 5, "FY": 6}
DERIVED = {"Q2": ("H1", "Q1"), "Q4": ("FY", "Q3")}
FLOWS = ["total_operating_revenue", "net_profit", "operating_expense_cost_of_sales", "operating_expense_selling_expenses", "operating_expense_rnd_expenses", "operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount", "net_cash_flow"]
#: The figures of a period that a quarter of its own is derived for, as given for the first variant of the view and for the second.
ALL_FLOWS = ["total_operating_revenue", "net_profit", "total_profit", "operating_profit", "operating_expense_cost_of_sales", "operating_expense_selling_expenses", "operating_expense_administrative_expenses", "operating_expense_financial_expenses", "operating_expense_rnd_expenses", "operating_expense_taxes_and_surcharges", "total_operating_expenses", "other_income", "asset_impairment_loss", "credit_impairment_loss", "operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount", "operating_cf_cash_from_sales", "investing_cf_cash_for_investments", "investing_cf_cash_from_investment_recovery", "financing_cf_cash_from_borrowing", "financing_cf_cash_for_debt_repayment", "net_profit_excl_non_recurring"]
SPINE_FLOWS = ["total_operating_revenue", "net_profit", "total_profit", "operating_expense_rnd_expenses", "operating_expense_selling_expenses", "operating_expense_cost_of_sales", "operating_expense_administrative_expenses", "operating_expense_financial_expenses", "operating_expense_taxes_and_surcharges", "total_operating_expenses", "operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount", "net_profit_excl_non_recurring"]
#: Parts of names of columns that hold shares or amounts (V-4).
SHARE_WORDS = ("ratio", "margin", "growth", "roe", "率", "占比", "比例")
AMOUNT_WORDS = ("revenue", "profit", "amount", "expense", "equity", "asset", "liability", "cash", "收入", "利润", "费用", "金额", "总额", "权益", "资产", "负债", "净额")
#: Name tokens that make a column a ratio; other doubles are amounts.
RATIO_TOKENS = ("ratio", "margin", "growth", "roe", "yoy", "qoq")
LIMITS = {"ratio": 1000.0, "amount": 1e8}


def suffix(period: Column) -> Column:
    return F.substring(period, 5, 2)


def period_order(period: Column) -> Column:
    """Place of the period's suffix within its year; 99 for others."""
    return reduce(lambda acc, kv: F.when(suffix(period) == kv[0], kv[1]).otherwise(acc), PERIOD_ORDER.items(), F.lit(99))


def wide(income: DataFrame, kpi: DataFrame, balance: DataFrame, cash: DataFrame, strict_names: bool = False, flows: list[str] | None = None) -> DataFrame:
    """V-1: full outer join of the sheets on the business key, with resolved revenue and profit and two ratios.

    A name missing in the income sheet is taken from any other sheet unless strict_names. flows: figures of derived quarters (V-3)."""
    own = set(income.columns)
    parts = []
    for name, df in (("kpi", kpi), ("balance", balance), ("cash", cash)):
        df = df.withColumnRenamed("stock_abbr", f"#{name}")
        parts.append(df.select(*KEY, *[F.col(f"`{c}`").alias(f"{c}_{name}" if c in own else c) for c in df.columns if c not in KEY]))
    out = reduce(lambda a, b: a.join(b, KEY, "full_outer"), parts, income)
    if not strict_names:
        out = out.withColumn("stock_abbr", F.coalesce("stock_abbr", "#kpi", "#balance", "#cash"))
    out = out.drop("#kpi", "#balance", "#cash").withColumn("total_operating_revenue", F.coalesce("total_operating_revenue", "total_operating_revenue_kpi")).withColumn("net_profit", F.coalesce("net_profit", "net_profit_10k_yuan"))
    return with_ratios(with_quarters(out, flows))


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "rnd_expense_ratio": F.try_divide(F.col("operating_expense_rnd_expenses") * 100, F.col("total_operating_revenue")),
        "inventory_turnover_ratio": F.try_divide("operating_expense_cost_of_sales", "asset_inventory"),
    })


def with_quarters(df: DataFrame, flows: list[str] | None = None) -> DataFrame:
    """V-3: adds yyyyQ2 = H1 - Q1 and yyyyQ4 = FY - Q3 rows for flow columns; other figures are null there.

    A quarter that exists is kept as it is, and one without any value is not added. One aggregation per company and
    year finds both bases, so there is no self join."""
    flows = [c for c in (flows or FLOWS) if c in df.columns]
    at = lambda s, c: F.max(F.when(suffix(F.col("report_period")) == s, F.col(c)))
    has = lambda s: F.max((suffix(F.col("report_period")) == s).cast("int"))
    year = df.groupBy("stock_code", "report_year").agg(
        F.max("stock_abbr").alias("stock_abbr"),
        *[has(q).alias(f"#{q}") for q in DERIVED],
        *[at(s, c).alias(f"{c}#{s}") for c in flows for pair in DERIVED.values() for s in pair],
    )
    quarters = F.array(*[
        F.struct(F.lit(q).alias("q"), F.col(f"#{q}").alias("there"), *[(F.col(f"`{c}#{a}`") - F.col(f"`{c}#{b}`")).alias(c) for c in flows]) for q, (a, b) in DERIVED.items()
    ])
    rows = year.select("stock_code", "report_year", "stock_abbr", F.explode(quarters).alias("x")).where("x.there = 0")
    rows = rows.select("stock_code", "stock_abbr", F.concat(F.col("report_year").cast("string"), F.col("x.q")).alias("report_period"), "report_year", *[F.col(f"x.{c}").alias(c) for c in flows])
    return df.unionByName(rows.where(F.coalesce(*flows).isNotNull()), allowMissingColumns=True)


def spine(income: DataFrame, kpi: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """V-2: the distinct keys of all sheets, left-joined (null-safe) with each; short names; derived quarters."""
    keys = ["stock_code", "stock_abbr", "report_period", "report_year"]
    out = reduce(DataFrame.unionByName, [s.select(*keys) for s in (income, kpi, balance, cash)]).distinct()
    picks = (
        (income, {"revenue": "total_operating_revenue", "net_profit": "net_profit", "selling_expenses": "operating_expense_selling_expenses"}),
        (kpi, {"eps": "eps", "roe": "roe"}),
        (balance, {"total_assets": "asset_total_assets", "inventory": "asset_inventory"}),
        (cash, {"operating_cf": "operating_cf_net_amount"}),
    )
    for df, names in picks:
        right = df.select(*[F.col(k).alias(f"#{k}") for k in keys], *[F.col(c).alias(n) for n, c in names.items()])
        on = reduce(lambda a, b: a & b, [out[k].eqNullSafe(right[f"#{k}"]) for k in keys])
        out = out.join(right, on, "left").drop(*[f"#{k}" for k in keys])
    out = with_quarters(out, ["revenue", "net_profit", "selling_expenses", "operating_cf"])
    return out.withColumn("selling_to_inventory_ratio", F.try_divide("selling_expenses", "inventory"))


def kind(name: str, dtype: str) -> str | None:
    """ratio, amount or None, by a column's name and type."""
    if dtype not in ("double", "float"):
        return None
    if any(t in name for t in RATIO_TOKENS):
        return "ratio"
    return None if name in ("eps",) or "per_share" in name else "amount"


def clamped(df: DataFrame) -> DataFrame:
    """V-4: ratios beyond 1,000 and amounts beyond 1e8 become null."""
    kinds = {c: kind(c, t) for c, t in df.dtypes}
    return df.withColumns({c: F.when(F.abs(c) <= LIMITS[k], F.col(c)) for c, k in kinds.items() if k})


def clamped_by_name(df: DataFrame) -> DataFrame:
    """V-4: numbers become null beyond 1,000 where the column's name says a share, and beyond 1e8 where it says an amount; a name that says
    both is a share, one that says neither stays. Small letters and capitals are alike; columns of text stay."""
    def limit(name: str, dtype: str) -> float | None:
        if dtype not in ("double", "float", "int", "bigint") and not dtype.startswith("decimal"):
            return None
        says = lambda words: any(w in name.lower() for w in words)
        return LIMITS["ratio"] if says(SHARE_WORDS) else LIMITS["amount"] if says(AMOUNT_WORDS) else None

    limits = {c: limit(c, t) for c, t in df.dtypes}
    return df.withColumns({c: F.when(F.abs(c) <= most, F.col(c)) for c, most in limits.items() if most})


def one_per_key(df: DataFrame, order: list[str]) -> DataFrame:
    """V-5: a row a key. Amounts: largest by size of the non-zero ones; ratios: median; others: first by order."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))
    aggs = []
    for c, t in df.dtypes:
        k = kind(c, t)
        if c in KEY:
            continue
        if k == "ratio":
            aggs.append(F.median(c).alias(c))
        elif k == "amount":
            aggs.append(F.coalesce(F.max_by(c, F.when(F.col(c) != 0, F.struct(F.abs(c), F.col(c)))), first(c)).alias(c))
        else:
            aggs.append(first(c).alias(c))
    return df.groupBy(*KEY).agg(*aggs)


def extended(view: DataFrame, balance: DataFrame) -> DataFrame:
    """V-6: the view with contract liabilities."""
    return view.join(balance.select(*KEY, F.col("liability_contract_liabilities").alias("contract_liabilities")), KEY, "left")
