"""Quality selection by importance resampling.

Tokens (runs of word characters, runs of other visible characters) and their pairs are hashed into BUCKETS features.
Two generative models of a text, one of the target (documents labelled as good) and one of all raw documents, are
smoothed frequencies of these features; a document's log importance weight is the sum over its features of the models'
log ratio. Adding Gumbel noise, fixed by seed and doc_id, and keeping the k largest samples k documents without
replacement in proportion to their weights.

Counts of both models cover all rows; what reaches the driver is BUCKETS numbers for each. k is the share of good
ones among labelled rows of all documents (or `keep`). The k-th largest key is found by histograms of BINS counts, each of the
bin that the last one left open; only the rows of the last bin are ordered.

Defined cases: null and empty texts have weight 0; null labels don't count; without target or labels all rows are kept;
repeated rows have equal keys and are kept or left by their order; rows with null doc_id share their noise by text. Other columns
play no part in keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, mix64, spans_of, stored, uniform, word_hashes

BUCKETS, SEED, BINS = 1 << 16, 11, 4096
#: Rows of one bin that are ordered at most, unless their keys are equal.
LAST_BIN = 10_000
U64 = np.uint64
CLASSES = np.array([0 if chr(b).isspace() and b < 128 or b < 33 else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts and the text of each."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    first, h = word_hashes(b"\n".join(parts), CLASSES)
    offsets = np.searchsorted(first, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))))
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = np.flatnonzero(of[1:] == of[:-1])
    with np.errstate(over="ignore"):
        two = mix64(h[:-1] * U64(3) + h[1:])[pairs]
    return (np.concatenate((h, two)) & U64(BUCKETS - 1)).astype(np.int64), np.concatenate((of, of[pairs]))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((2, BUCKETS), np.int64)
    for pdf in batches:
        texts, good = pdf["text"].fillna("").tolist(), pdf["good"].to_numpy(np.int64)
        for i, j in spans_of([len(t) for t in texts]):
            f, of = features(texts[i:j])
            total[0] += np.bincount(f, minlength=BUCKETS)
            total[1] += np.bincount(f[good[i:j][of] == 1], minlength=BUCKETS)
    at = np.flatnonzero(total[0])
    yield pd.DataFrame({"bucket": at, "raw": total[0][at], "target": total[1][at]})


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """The log ratio of each feature, and the share of good rows among the labelled; None without target rows."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("good"))
    share = marks.agg(F.avg("good")).first()[0]
    if not share:
        return None
    rows = docs.select("doc_id", "text").join(bounded_broadcast(marks), "doc_id", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))
    counts = rows.mapInPandas(_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[counts["bucket"]] += counts["raw"]
    target[counts["bucket"]] += counts["target"]
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), float(share)


def weighted(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key of each row."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def log_weight(text: pd.Series) -> pd.Series:
        texts, out = text.fillna("").tolist(), np.zeros(len(text))
        for i, j in spans_of([len(t) for t in texts]):
            f, of = features(texts[i:j])
            out[i:j] = np.bincount(of, held.value[f], j - i)
        return pd.Series(out)

    u = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return docs.select("doc_id", log_weight("text").alias("log_weight"), (-F.log(-F.log(u))).alias("gumbel")).select("doc_id", "log_weight", (F.col("log_weight") + F.col("gumbel")).alias("key"))


def largest(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of the largest key, ties to the smaller doc_id. rows is read several times."""
    ends = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).first()
    if k >= ends["n"]:
        return rows
    lo, hi, left, inside = ends["lo"], ends["hi"], k, ends["n"]  # keys above hi are in; `left` more are in [lo, hi]
    sure = F.lit(False)
    bound = F.col("key").between(lo, hi)
    while inside > LAST_BIN and hi > lo:
        width = (hi - lo) / BINS
        counts = rows.where(bound).groupBy(F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # at most BINS rows
        for r in sorted(counts, key=lambda r: -r["bin"]):
            if r["n"] >= left:
                break
            left -= r["n"]
        if r["n"] == inside and (r["lo"], r["hi"]) == (lo, hi):
            break
        lo, hi, inside = r["lo"], r["hi"], r["n"]
        sure, bound = F.col("key") > hi, F.col("key").between(lo, hi)
    return rows.where(sure).unionByName(rows.where(bound).orderBy(F.desc("key"), F.col("doc_id").asc_nulls_last()).limit(left))


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, key of the sampled rows. keep: their share of all rows."""
    learned = fit(docs, labels)
    ratio, share = learned if learned else (np.zeros(BUCKETS), 1.0)
    rows = stored(weighted(docs, ratio, seed))
    return largest(rows, int(round(rows.count() * (share if keep is None else keep))))
