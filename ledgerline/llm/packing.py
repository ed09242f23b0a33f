"""Best-fit packing of documents into token sequences by length-histogram planning.

Documents are tokenized once into pieces of at most `capacity` tokens. Only the histogram of piece lengths (at most
`capacity` numbers) reaches the driver, where best fit in order of falling length runs over counts: whole classes of
sequences with the same room are filled at a time. The plan says, for ranges of ranks within a length, which sequences
and offsets they take; its size depends on `capacity` alone. Every piece is then ranked within its length, by buckets
of bounded size so that no length is gathered in a task, and takes the slot of its rank.

Token ids are those of the `tokenizers` library for byte_bpe_50k.json without added special tokens, then END. They are
computed with tiktoken and the same vocabulary, which is several times faster; a text that holds a special token's
string goes through `tokenizers` itself. tests/llm compares the two.

Defined cases: null and empty texts are a single END; repeated rows are packed each; an empty table gives no rows;
null doc_ids are packed like others. Other columns play no part.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CAPACITY, END, SPECIAL = 1024, 2, "<|endoftext|>"
#: Mean number of pieces in a bucket of the ranking.
BUCKET = 5_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_files() -> tuple[str, str]:
    """The tokenizer's files: for tokenizers, and its ranks for tiktoken."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def _encoders(files: tuple[str, str]):
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(files[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return Tokenizer.from_file(files[0]), tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, files: tuple[str, str] | None = None) -> list[int]:
    exact, fast = _encoders(files or vocabulary_files())
    text = text or ""
    if SPECIAL in text:
        return [*exact.encode(text, add_special_tokens=False).ids, END]
    return [*fast.encode_ordinary(text), END]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and lengths of the pieces of n tokens; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of docs (doc_id, text)."""
    files = files or vocabulary_files()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part, rows = pdf.iloc[lo : lo + 256], []
                for doc_id, text in zip(part["doc_id"].array, part["text"], strict=True):
                    ids = np.array(encode(text, files), dtype="<u4")
                    for k, (s, n) in enumerate(cuts(len(ids), capacity)):
                        own = ids[s : s + n]
                        rows.append((doc_id, k, s, n, zlib.crc32(own.tobytes())) + ((own.astype(np.int64),) if with_ids else ()))
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut_up, PIECES + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces of this length a sequence, offset of the first of them)."""
    rooms: list[int] = []  # rooms left in open sequences, ascending
    classes: dict[int, list[tuple[int, int]]] = {}  # room: ranges of sequences (first, number)
    slots: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def leave(room: int, first: int, number: int) -> None:
        if number and room:
            if room not in classes:
                insort(rooms, room)
                classes[room] = []
            classes[room].append((first, number))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = classes[room].pop()
                if not classes[room]:
                    del classes[room], rooms[at]
            else:
                room, first = capacity, sequences
                number = -(-left // (capacity // length))
                sequences += number
            each = min(room // length, left)
            full = min(number, left // each)
            slots.append((length, rank, first, each, capacity - room))
            rank, left = rank + full * each, left - full * each
            leave(room - each * length, first, full)
            leave(room, first + full, number - full)
    return np.array(slots, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, files: tuple[str, str] | None = None) -> DataFrame:
    """The pieces with the sequence that each is in and its offset there."""
    cut_up = stored(pieces(docs, capacity, with_ids, files))
    histogram = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}  # at most `capacity` rows
    buckets = max(1, sum(histogram.values()) // BUCKET)
    slots = cut_up.sparkSession.sparkContext.broadcast(plan(histogram, capacity))
    rows = cut_up.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = rows.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("own", own).join(before.select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before")), ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = slots.value
        order = np.lexsort((table[:, 1], -table[:, 0]))
        table = table[order]
        key = (capacity - table[:, 0]) * (1 << 50) + table[:, 1]  # ascending in falling length, then rank
        at = np.searchsorted(key, (capacity - length.to_numpy()) * (1 << 50) + rank.to_numpy(), "right") - 1
        _, lo, first, each, offset = table[at].T
        j = rank.to_numpy() - lo
        return pd.DataFrame({"sequence_id": first + j // each, "offset": offset + j % each * length.to_numpy()})

    return ranked.withColumn("at", slot("length", F.col("before") + F.col("own"))).select(*cut_up.columns, "at.sequence_id", "at.offset")
