"""From raw documents to packed training sequences: toxicity, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import minhash, mixing, packing, pii, toxicity
from ledgerline.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the words that the mix takes, in per cent, and how often it may take a document.
BUDGET_PERCENT, EPOCHS = 90, 1


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5. The models learn from the labelled ones among docs."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.score(docs.select(*COLUMNS), labels).where("toxic_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, that of the smallest doc_id; texts without words all stay.

    Rows without doc_id are in the classes like others and stay only where their class has no doc_id."""
    return minhash.firsts(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [kind] in place of personal data."""
    return pii.redact(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes; one that it takes in several epochs is repeated."""
    out = mixing.mix(docs.select(*COLUMNS), budget_percent=BUDGET_PERCENT, epochs=EPOCHS)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]
#: The learned stages have no SQL; tests/llm holds the run against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
