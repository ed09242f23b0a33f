"""Incremental, resumable builds (K-14, A-16) with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hashed_embedding(text: Column, width: int = 16) -> Column:
    """A stand-in embedding: counts of hashed words. Any column function of text can take its place."""
    buckets = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.pmod(F.xxhash64(w), F.lit(width)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("float"))


def build(spark: SparkSession, source: str, sink: str, checkpoint: str, version: str, embed: Callable[[Column], Column] = hashed_embedding) -> None:
    """Embeds all rows that arrived in `source` (Parquet with chunk_id, text) since the last call and appends them to `sink`.

    The version (model and corpus) is part of the checkpoint's path, so that a new one starts over."""
    schema = spark.read.parquet(source).schema
    rows = spark.readStream.schema(schema).parquet(source).select("chunk_id", embed(F.col("text")).alias("embedding"), F.lit(version).alias("version"))
    rows.writeStream.format("parquet").option("path", f"{sink}/{version}").option("checkpointLocation", f"{checkpoint}/{version}").trigger(availableNow=True).start().awaitTermination()


def built(spark: SparkSession, sink: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{sink}/{version}")


PROGRESS = "model string, chunk_count long, n_rows long, dim int"


def build_resumable(spark: SparkSession, source: str, target: str, model: str, embed: Callable[[Column], Column] = hashed_embedding, files_a_batch: int = 16, most_batches: int | None = None) -> None:
    """K-14: embeds the chunks of `source` (Parquet with chunk_id, text) in batches of files, each noted in a progress table; goes on where the last call, also one
    that was killed, ended. Another model or number of chunks begins anew, in a folder of its own under `target`.

    A batch writes a folder that its number names, and writes it again if it is repeated, so that each chunk is there once. Repeated chunk_ids stay as they
    come; a null text has a null embedding if `embed` gives that. most_batches ends a call early; later calls do the rest."""
    rows = spark.read.parquet(source)
    count = rows.count()
    home = _home(target, model, count)
    begun: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        if most_batches is not None and len(begun) >= most_batches:
            raise RuntimeError("enough batches")  # not committed, so the next call begins with this batch
        begun.append(number)
        batch.write.mode("overwrite").parquet(f"{home}/embeddings/batch={number}")
        _note(batch.sparkSession, home, number, model, count)

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = stream.select("chunk_id", embed(F.col("text")).alias("embedding")).writeStream.foreachBatch(write).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if most_batches is None or len(begun) < most_batches:
            raise


def _home(target: str, model: str, count: int) -> str:
    return f"{target}/model={model}/chunks={count}"


def _note(spark: SparkSession, home: str, number: int, model: str, count: int) -> None:
    """The progress row of a batch, from what it wrote."""
    done = spark.read.parquet(f"{home}/embeddings/batch={number}")
    row = done.agg(F.lit(model).alias("model"), F.lit(count).cast("long").alias("chunk_count"), F.count("*").alias("n_rows"), F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding"))).alias("dim"))
    row.write.mode("overwrite").parquet(f"{home}/progress/batch={number}")


def progress(spark: SparkSession, target: str, model: str, count: int) -> DataFrame:
    """One row: model, chunk_count, embedded, batches, dim and index_status, ready once all chunks are embedded, partial before."""
    rows = spark.read.schema(PROGRESS).parquet(f"{_home(target, model, count)}/progress")
    done = F.coalesce(F.sum("n_rows"), F.lit(0))
    return rows.agg(F.lit(model).alias("model"), F.lit(count).cast("long").alias("chunk_count"), done.alias("embedded"), F.count("*").alias("batches"), F.max("dim").alias("dim"), F.when(done >= count, "ready").otherwise("partial").alias("index_status"))


def embedded(spark: SparkSession, target: str, model: str, count: int) -> DataFrame:
    """chunk_id, embedding of the batches noted so far."""
    home = _home(target, model, count)
    noted = spark.read.parquet(f"{home}/progress").select("batch")
    return spark.read.parquet(f"{home}/embeddings").join(F.broadcast(noted), "batch", "left_semi").drop("batch")
