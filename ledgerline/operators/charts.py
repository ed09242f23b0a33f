"""Rows for drawings: categories with one value, order and the best (M-2), and scales (M-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles

#: Parts of names of columns that hold shares, and of those that scales leave alone.
RATIOS = ("ratio", "margin", "growth", "roe", "per_share", "percent")
LARGE, PER_UNIT = 1e5, 10_000


def _number(df: DataFrame, column: str):
    return F.col(column) if dict(df.dtypes)[column] == "double" else F.col(column).try_cast("double")


def one_a_category(df: DataFrame, category: str, value: str) -> DataFrame:
    """M-2, E-16: if a category repeats, each once with its least number where three quarters of all numbers are 0 or less, else with its largest; rows
    without category go then, and so do other columns. If none repeats, or nothing is a number, df as it is. Values in text count where they are numbers."""
    if df.groupBy(category).count().where(F.col(category).isNotNull() & (F.col("count") > 1)).isEmpty():
        return df
    rows = df.select(category, _number(df, value).alias(value))
    [upper] = percentiles(rows.where(F.col(value).isNotNull()), [(value, 0.75)])
    if upper is None:
        return df
    return rows.where(F.col(category).isNotNull()).groupBy(category).agg((F.min(value) if upper <= 0 else F.max(value)).alias(value))


def charted(df: DataFrame, category: str, value: str, *, sort_by: str | None = None, ascending: bool = False, series: str | None = None, n: int | None = None, collapse: bool = True) -> DataFrame:
    """M-2: rows of a drawing with their place: one a category (`one_a_category`), in the order of sort_by as numbers if any is one, else as text, missing ones
    last and ties by all other columns; the first n, or the first n of each series if there is such a column.

    Places of n rows only: a limit comes before the numbering, and within series Spark keeps n rows a task before it moves them. Without n there is no place."""
    rows = one_a_category(df, category, value) if collapse else df
    if not sort_by or sort_by not in rows.columns:
        sort_by = value
    number = _number(rows, sort_by)
    key = F.col(sort_by) if rows.select(number.alias("x")).where("x is not null").isEmpty() else number
    order = [key.asc_nulls_last() if ascending else key.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rows.columns if c != sort_by]]
    if n is None:
        return rows.orderBy(*order)
    if series and series in rows.columns:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(series).orderBy(*order))).where(F.col("place") <= n)
    return rows.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """M-3: columns as they are drawn, missing ones as 0, each with a column `<name>_unit`: % for shares, 万元 (and a ten-thousandth) if any size is
    1e5 or more, else none. One aggregation finds the largest sizes of all columns."""
    amounts = [c for c in columns if not any(t in c.lower() for t in RATIOS)]
    units = {f"{c}_unit": F.lit("%") for c in columns if c not in amounts}
    filled = df.withColumns({c: F.coalesce(_number(df, c), F.lit(0.0)) for c in columns})
    if not amounts:
        return filled.withColumns(units)
    most = filled.agg(*[F.coalesce(F.max(F.abs(c)) >= LARGE, F.lit(False)).alias(f"#{c}") for c in amounts])
    out = filled.join(F.broadcast(most)).withColumns(units | {f"{c}_unit": F.when(F.col(f"#{c}"), "万元").otherwise("") for c in amounts})
    return out.withColumns({c: F.when(F.col(f"#{c}"), F.col(c) / PER_UNIT).otherwise(F.col(c)) for c in amounts}).drop(*[f"#{c}" for c in amounts])
