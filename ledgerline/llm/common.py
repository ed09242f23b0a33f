"""Helpers that the training-data operators share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that one numpy pass inside a task takes at a time (a longer text is a pass of its own).
CHARS_A_PASS = 1_000_000
#: Rows up to which a side of two fixed-width columns is broadcast (about 32 MB); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Bytes of a word that are hashed at once.
PIECE = 4_096
#: A key with more than this part of all rows is hot.
HOT_SHARE = 10_000
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where that is unset and the master is local, too."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        if not sc.getCheckpointDir() and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors and driver need a folder that they share")
        found = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="ledgerline-checkpoint-")
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame) -> DataFrame:
    """Computes df once, as a Parquet table in the shared folder, which cuts its lineage and survives lost executors.

    Unlike checkpoint() it leaves no constraints of the old plan behind, which grow with every turn of a loop."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is. df is computed for the count."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def split_join(rows: DataFrame, keyed: DataFrame, key: list[str], least: int = 100) -> DataFrame:
    """rows joined with keyed (one row a key, with n, the number of rows of that key). rows is read twice.

    Keys that hold over a HOT_SHARE-th of all rows (HOT_SHARE keys at most, whatever the tables' sizes) are broadcast, so that no
    task gathers the rows of one; the others shuffle."""
    total = keyed.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > max(least, total / HOT_SHARE)
    few, many = F.broadcast(keyed.where(hot)), keyed.where(~hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(keyed.where(hot).select(*key)), key, "left_anti").join(many, key))


def spans_of(lengths: list[int], size: int = CHARS_A_PASS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose lengths sum to at most `size`, or of one longer item."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: a bijection of 64-bit integers that looks random."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def word_hashes(data: bytes, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and 64-bit hashes of the words in data: runs of bytes of one class in `classes` (256 numbers) that isn't 0.

    A word's hash is a sum of its bytes times random factors, finalized by mix64; it depends on the word alone."""
    b = np.frombuffer(data, dtype=np.uint8)
    kind = classes[b]
    if not kind.any():
        return np.empty(0, np.int64), np.empty(0, U64)
    change = np.concatenate(([True], kind[1:] != kind[:-1], [True]))
    first = np.flatnonzero(change[:-1] & (kind > 0))
    size = np.flatnonzero(change[1:] & (kind > 0)) - first + 1
    where = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    at = where - np.repeat(first, size)
    return first, folded(POWERS[at % PIECE] * (b[where].astype(U64) + U64(1)), size)


def folded(terms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of items from their terms, `size` of them each. An item of more than PIECE terms is the hash of the hashes of its
    pieces, one after another, so that no two places of it count alike."""
    pieces = -(-size // PIECE)
    lengths = np.full(pieces.sum(), PIECE)
    ends = np.cumsum(pieces) - 1
    lengths[ends] = size - (pieces - 1) * PIECE
    h = mix64(np.add.reduceat(terms, np.concatenate(([0], np.cumsum(lengths)[:-1]))) + lengths.astype(U64) * U64(0x9E3779B97F4A7C15))
    out = h[ends - pieces + 1]
    turn = 1
    while len(longer := np.flatnonzero(pieces > turn)):
        out[longer] = mix64(out[longer] * U64(3) + h[(ends - pieces + 1)[longer] + turn] + U64(1))
        turn += 1
    return out


def _powers(n: int) -> np.ndarray:
    """Successive odd random multipliers."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


POWERS = _powers(PIECE)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive entries of h; shorter than h by n - 1."""
    if len(h) < n:
        return np.empty(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for i in range(n):
        out = mix64(out + h[i : len(h) - n + 1 + i] + U64(0x9E3779B97F4A7C15 + i))
    return out


def to_json(x: object) -> str:
    return json.dumps(x, separators=(",", ":"))
