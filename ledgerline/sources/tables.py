"""Readers and writers (A family): manifests, sheets, exports, logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source_name string, stock_code string, stock_abbr string, year string, report_year string, period_norm string, report_period string, is_english_version string, selected string"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder (spark.checkpoint.dir), computed once."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_path(df))


def stored_path(df: DataFrame) -> str:
    """Writes df to the shared folder; where it is. A local folder only where none is set and the master is local, too."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        folder = tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """When a file or folder was last changed, and its length; None where there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return None
    status = files.getFileStatus(where)
    return status.getModificationTime(), status.getLen()


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A-1: selected reports that are no English versions, with codes padded and years and periods from either column."""
    rows = spark.read.schema(MANIFEST).option("header", True).csv(path)
    rows = rows.select(*[F.when(~F.lower(F.trim(c)).isin("", "nan"), F.trim(c)).alias(c) for c in rows.columns])
    yes = lambda c: F.coalesce(F.lower(c), F.lit("false")).isin("true", "1", "yes")
    rows = rows.where(yes(F.col("selected")) & ~yes(F.col("is_english_version")))
    return rows.select("source_name", F.lpad("stock_code", 6, "0").alias("stock_code"), "stock_abbr", F.coalesce("report_year", "year").try_cast("int").alias("report_year"), F.coalesce("report_period", "period_norm").alias("report_period"))


def parse_coded_names(names: DataFrame) -> DataFrame:
    """A-2: code, date, number of names like code_date_number.pdf; parsed says whether the name has that form."""
    p = r"^([0-9]{6})_([0-9]{8})_([A-Za-z0-9]+)\.pdf$"
    return names.select("name", F.col("name").rlike(p).alias("parsed"), *[F.nullif(F.regexp_extract("name", p, i), F.lit("")).alias(c) for i, c in enumerate(("stock_code", "report_date", "number"), 1)])


def read_company_reference(spark: SparkSession, path: str) -> DataFrame:
    """A-6"""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.lpad(F.split("stock_code", "[.]")[0], 6, "0").alias("stock_code"), F.trim("stock_abbr").alias("stock_abbr"))


def conforming(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """A-8: the columns of a schema in its order; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in schema.items()])


def jdbc_options(url: str, table: str, bounds: tuple[str, int, int, int] | None = None, fetch: int = 10_000, **more: str) -> dict[str, str]:
    """Options of a read from a database. bounds (whole-number column, least, greatest, partitions) has that many tasks read a range each; without it one task reads all."""
    out = {"url": url, "dbtable": table, "fetchsize": str(fetch), "pushDownPredicate": "true", **more}
    if bounds:
        column, least, greatest, parts = bounds
        if least > greatest or parts < 1:
            raise ValueError("bounds: least is over greatest, or there are no partitions")
        out |= {"partitionColumn": column, "lowerBound": str(least), "upperBound": str(greatest), "numPartitions": str(parts)}
    return out


def read_sheet(spark: SparkSession, *, path: str | None = None, table: str | None = None, jdbc: dict[str, str] | None = None, schema: dict[str, str] | None = None, kind: str = "parquet") -> DataFrame:
    """A-7: a sheet from a path (of Parquet, ORC, JSON or CSV files), a catalog table or a database (`jdbc_options`), exactly one of them.

    schema: the sheet's columns and types; others are dropped, missing ones are null, codes are padded to six digits. Without it the sheet is as it is.
    Filters and the choice of columns reach the source."""
    if sum(x is not None for x in (path, table, jdbc)) != 1:
        raise ValueError("a sheet is read from one of path, table and jdbc")
    if jdbc is not None:
        rows = spark.read.format("jdbc").options(**jdbc).load()
    elif table is not None:
        rows = spark.read.table(table)
    else:
        rows = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {})).load(path)
    if schema is None:
        return rows
    rows = conforming(rows, schema)
    code = F.trim(F.col("stock_code").cast("string")) if "stock_code" in schema else None
    return rows if code is None else rows.withColumn("stock_code", F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code))


def write_sheet(df: DataFrame, path: str, schema: dict[str, str], mode: str = "append") -> None:
    """A-8, A-12"""
    conforming(df, schema).write.mode(mode).parquet(path)


def write_logs(df: DataFrame, path: str) -> None:
    """A-10"""
    df.write.mode("append").partitionBy("table_name").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A-9"""
    df.write.mode("overwrite").option("header", True).csv(path)


def curation_summary(parsed: DataFrame) -> DataFrame:
    """A-17: names parsed and not, and up to 20 of the latter."""
    bad = F.array_join(F.slice(F.sort_array(F.collect_set(F.when(~F.col("parsed"), F.col("name")))), 1, 20), ",")
    counts = parsed.agg(F.count_if("parsed").alias("parsed"), F.count_if(~F.col("parsed")).alias("unparsed"))
    return counts.join(parsed.where("not parsed").orderBy("name").limit(20).agg(bad.alias("examples")))
