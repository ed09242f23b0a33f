"""Hierarchical packing of documents into sequences of several lengths, all of them full.

Documents are tokenized once. Whole windows of the longest tier are cut from the front of long ones; what is left, shorter than a
window, is routed to the smallest tier that holds it. Tiers are powers of two, and a sequence of a tier is as long as the tier, so it needs
no padding. As in best-fit packing, only the histogram of lengths reaches the driver (as many numbers as the longest tier has tokens), where
whole classes of equal rests meet whole classes of equal windows:

1. each tier, the longest first, packs its own rests by best fit;
2. gaps of its windows are filled with whole rests of shorter tiers, the largest that fits first;
3. when all rests are placed, the windows of the fewest tokens are taken apart, and their parts fill the gaps of the others, cut where none fits;
4. the last window, shorter than a tier, is cut into sequences of its binary digits, so that nothing at all is padded.

Sequences are dealt to step groups of `STEP` tokens: each has sequences of one tier, taken in strides so that rests
of all lengths meet in it; what is left over in the tiers fills groups together, so all but the last hold the same number of tokens.

The plan is a table of ranges of ranks; its size depends on the tiers and at most on the logarithm of the counts (2,048 lengths: 15,000
rows for counts of a thousand, 88,000 for a billion). Ranks need no shuffle of texts or ids: each task numbers its
rests of a length, and the counts by task and length give where its numbers begin. Ids of rests are stored with them, so
that no text is tokenized twice.

Defined cases: null and empty texts are a single END; repeated rows are packed each; an empty table gives no rows; null
doc_ids are packed like others. A text of any length is encoded whole. Other columns play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored
from .packing import encode, vocabulary_files

TIERS, END, STEP = (256, 512, 1024, 2048), 1, 32_768
#: Rows (task, length, first rank) up to which they are broadcast (about 6 MB); beyond it the join shuffles.
OFFSETS = 200_000
RESTS = "task int, own long, doc_id long, doc_tokens long, start long, length int, ids_crc32 long, ids binary"
PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def rests(docs: DataFrame, longest: int, end: int, files: tuple[str, str]) -> DataFrame:
    """Windows of `longest` tokens and rests of docs (doc_id, text), numbered by length within each task; rests with their ids."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), Counter()
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part, rows = pdf.iloc[lo : lo + 256], []
                for doc_id, text in zip(part["doc_id"].array, part["text"], strict=True):
                    ids = np.array([*encode(text, files)[:-1], end], dtype="<u4")
                    for s in range(0, len(ids), longest):
                        own = ids[s : s + longest].tobytes()
                        n = len(own) // 4
                        rows.append((task, seen[n], doc_id, len(ids), s, n, zlib.crc32(own), own if n < longest else None))
                        seen[n] += 1
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in RESTS.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut_up, RESTS)


class Part(NamedTuple):
    """Tokens `at` to `at` + `size` of the rests of `length` tokens with ranks from `rank` on; `each` such stretches, one after another, of each."""

    length: int
    rank: int
    at: int
    size: int
    each: int = 1


class Windows(NamedTuple):
    """`number` windows of `tier` tokens; each part names that of the first of them, the others have the ranks that follow."""

    gap: int
    tier: int
    number: int
    parts: tuple[Part, ...]

    def split(self, n: int) -> tuple[Windows, Windows]:
        later = tuple(p._replace(rank=p.rank + n) for p in self.parts)
        return self._replace(number=n), self._replace(number=self.number - n, parts=later)


class Plan:
    """Packs a histogram. slots: rows (length, first rank, number of ranks, at, size, each, tier, first sequence of it, offset)."""

    def __init__(self, histogram: dict[int, int], tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers, self.sequences = sorted(tiers), Counter()
        self._slots: list[tuple[int, ...]] = []
        self._sizes: list[int] = []  # of free parts, ascending
        self._free: dict[int, list[tuple[Part, int]]] = {}
        self._open: list[Windows] = []  # with gaps, ascending
        for length, number in histogram.items():
            self._leave(Part(length, 0, 0, length), number)
        for smaller, tier in reversed([*zip([0, *self.tiers[:-1]], self.tiers, strict=True)]):
            self._pack(smaller, tier)
        self._cut()
        self.slots = np.array(self._slots, np.int64).reshape(-1, 9)

    def _leave(self, part: Part, number: int) -> None:
        if number and part.size:
            if part.size not in self._free:
                insort(self._sizes, part.size)
                self._free[part.size] = []
            self._free[part.size].append((part, number))

    def _take(self, size: int, most: int) -> tuple[Part, int]:
        part, number = self._free[size].pop()
        if number > most:
            self._free[size].append((part._replace(rank=part.rank + most), number - most))
            number = most
        if not self._free[size]:
            del self._free[size], self._sizes[bisect_left(self._sizes, size)]
        return part, number

    def _keep(self, windows: Windows) -> None:
        if windows.number and windows.gap:
            insort(self._open, windows)
        elif windows.number:
            self._close(windows)

    def _close(self, windows: Windows) -> None:
        offset = 0
        for p in windows.parts:
            self._slots.append((p.length, p.rank, windows.number // p.each, p.at, p.size, p.each, windows.tier, self.sequences[windows.tier], offset))
            offset += p.size
        self.sequences[windows.tier] += windows.number

    def _add(self, windows: Windows, size: int) -> None:
        """Places whole free parts of `size` tokens in windows, as far as there are any; windows that are left are kept."""
        part, number = self._take(size, windows.number)
        filled, left = windows.split(number)
        self._keep(filled._replace(gap=filled.gap - size, parts=(*filled.parts, part)))
        self._keep(left)

    def _fill(self, windows: Windows) -> None:
        """Closes windows with stretches of the smallest free parts that are longer than the gap, as many of each as it has."""
        size = self._sizes[bisect_right(self._sizes, windows.gap)]
        each = min(size // windows.gap, windows.number)
        part, number = self._take(size, windows.number // each)
        self._leave(part._replace(at=part.at + each * windows.gap, size=size - each * windows.gap), number)
        filled, left = windows.split(number * each)
        self._close(filled._replace(gap=0, parts=(*filled.parts, part._replace(size=windows.gap, each=each))))
        self._keep(left)

    def _pack(self, smaller: int, tier: int) -> None:
        before, self._open = self._open, []
        while self._sizes and self._sizes[-1] > smaller:
            size = self._sizes[-1]
            at = bisect_left(self._open, (size,))
            windows = self._open.pop(at) if at < len(self._open) else None
            if windows:
                self._add(windows, size)
            else:
                part, number = self._take(size, 1 << 62)
                self._keep(Windows(tier - size, tier, number, (part,)))
        done = []
        while self._open:
            windows = self._open.pop()
            at = bisect_right(self._sizes, windows.gap)
            if at:
                self._add(windows, self._sizes[at - 1])
            else:
                done.append(windows)
        self._open = sorted(before + done)

    def _cut(self) -> None:
        while self._open or self._sizes:
            if not self._open:  # parts that are left over open windows again
                part, number = self._take(self._sizes[-1], 1 << 62)
                tier = self.tiers[bisect_left(self.tiers, part.size)]
                self._keep(Windows(tier - part.size, tier, number, (part,)))
            elif self._sizes:
                windows = self._open.pop(0)
                at = bisect_right(self._sizes, windows.gap)
                if at:
                    self._add(windows, self._sizes[at - 1])
                else:
                    self._fill(windows)
            elif len(self._open) == 1 and self._open[0].number == 1:
                self._tail(self._open.pop())
            else:
                self._take_apart()

    def _take_apart(self) -> None:
        windows = self._open.pop(min(range(len(self._open)), key=lambda i: self._open[i].tier - self._open[i].gap))
        wanted = sum(w.gap * w.number for w in self._open)
        most = windows.number if wanted else max(1, windows.number * windows.gap // windows.tier)
        donors, left = windows.split(min(most, max(1, -(-wanted // (windows.tier - windows.gap)))) if wanted else most)
        self._keep(left)
        for part in donors.parts:
            self._leave(part, donors.number)

    def _tail(self, window: Windows) -> None:
        parts = list(reversed(window.parts))
        used = window.tier - window.gap
        for bit in reversed(range(used.bit_length())):
            size, own = used & 1 << bit, []
            while size:
                part = parts.pop()
                n = min(size, part.size)
                own.append(part._replace(size=n))
                if n < part.size:
                    parts.append(part._replace(at=part.at + n, size=part.size - n))
                size -= n
            if own:
                self._close(Windows(0, 1 << bit, 1, tuple(own)))

    def numbering(self, step: int = STEP) -> np.ndarray:
        """Rows (tier, first sequence, whole groups, first of them, first token of what is left over, first group of leftovers)."""
        out, sequences, groups, tokens = [], 0, 0, 0
        for tier in sorted(self.sequences, reverse=True):
            number = self.sequences[tier]
            whole = number * tier // step
            out.append([tier, sequences, whole, groups, tokens])
            sequences, groups, tokens = sequences + number, groups + whole, tokens + (number - whole * (step // tier)) * tier
        return np.array([[*row, groups] for row in out], np.int64).reshape(-1, 6)


def placed(batch: pd.DataFrame, slots: np.ndarray, numbering: np.ndarray, step: int = STEP) -> pd.DataFrame:
    """The pieces of a batch of rests and their places. slots: sorted by length and first rank."""
    batch = batch.sort_values(["length", "rank"], ignore_index=True)
    key = batch["length"].to_numpy(np.int64) * (1 << 50) + batch["rank"].to_numpy(np.int64)
    first = np.searchsorted(key, slots[:, 0] * (1 << 50) + slots[:, 1])
    last = np.searchsorted(key, slots[:, 0] * (1 << 50) + slots[:, 1] + slots[:, 2])
    number = (last - first) * slots[:, 5]
    which = np.repeat(np.arange(len(slots)), number)
    _, rank, _, at, size, each, tier, sequence, offset = slots[which].T
    turn = np.arange(len(which)) - np.repeat(np.cumsum(number) - number, number)
    row, turn = first[which] + turn // each, turn % each
    at = at + turn * size
    sequence = sequence + (batch["rank"].to_numpy(np.int64)[row] - rank) * each + turn
    own = numbering[np.searchsorted(-numbering[:, 0], -tier)]
    over = sequence - own[:, 2] * (step // tier)
    group = np.where(over < 0, own[:, 3] + sequence % np.maximum(own[:, 2], 1), own[:, 5] + (own[:, 4] + over * tier) // step)
    ids, crc = batch["ids"].to_numpy(), batch["ids_crc32"].to_numpy()
    crcs = [crc[r] if ids[r] is None else zlib.crc32(memoryview(ids[r])[4 * a : 4 * (a + n)]) for r, a, n in zip(row, at, size, strict=True)]
    out = {"doc_id": batch["doc_id"].array[row], "start": batch["start"].to_numpy()[row] + at, "length": size, "ids_crc32": crcs, "doc_tokens": batch["doc_tokens"].to_numpy()[row]}
    return pd.DataFrame(out | {"sequence_id": own[:, 1] + sequence, "offset": offset, "tier": tier, "step_group": group}).astype({"doc_id": "Int64", "ids_crc32": "int64"})


def pack(docs: DataFrame, tiers: tuple[int, ...] = TIERS, end: int = END, step: int = STEP, files: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group of every piece of docs (doc_id, text).

    tiers: powers of two that divide step."""
    if any(t & (t - 1) or step % t for t in tiers):
        raise ValueError("tiers are powers of two that divide step")
    rows = stored(rests(docs, max(tiers), end, files or vocabulary_files()))
    counts = stored(rows.groupBy("task", "length").agg(F.count("*").alias("number")))
    histogram = {r["length"]: r["number"] for r in counts.groupBy("length").agg(F.sum("number").alias("number")).collect()}  # at most max(tiers) rows
    plan = Plan(histogram, tiers)
    table = rows.sparkSession.sparkContext.broadcast((plan.slots[np.lexsort((plan.slots[:, 1], plan.slots[:, 0]))], plan.numbering(step)))
    before = F.coalesce(F.sum("number").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(bounded_broadcast(counts.select("task", "length", before.alias("before")), OFFSETS), ["task", "length"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield placed(batch, *table.value, step)

    return ranked.select("doc_id", "doc_tokens", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("own")).alias("rank")).mapInPandas(place, PLACED)
