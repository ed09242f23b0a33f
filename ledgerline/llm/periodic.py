"""Runs of periodic words by block convolution: exact integer NTTs of squared differences at dyadic scales.

A run is a stretch of consecutive words of one document with smallest period q and a length of at least
max(`LEAST`, `TIMES` * q) that no neighbouring word extends keeping period q. A run of period q in [B, 2B), B a power of two,
holds a whole block of B words that starts at a multiple of B, together with its repetition q words later, as 2B - 1 + q
is at most 3q; at the lowest scale, B = `BASE`, the least length gives the same for all q under 2B. So at every scale each block is
compared with the following window at all distances in [B, 2B) at once: the sum of squared differences of word numbers at each
distance is two sums of squares less twice a correlation, which number-theoretic transforms of 4B points give, modulo a prime. Where
words are equal the sum is 0, so no distance is missed; a sum that is 0 modulo the prime alone fails when the words are compared.
Distances of 0 seed extensions to both sides; seeds of one distance in neighbouring blocks are extended as one.

Three tests spare work without losing runs. A block can only lie in a run of a period under 2B if each of its words occurs
again within 2B - 1 words. A block and its repetition at distance q that both lie in one run found at a lower scale are of no other run: the two runs would
share q + B words, at least the sum of their periods, and so have one smallest period. And where a block lies in a run whose period is
at most B / 3, a longer period q repeats the end of that run q words later or earlier, so other distances (as many as
a uniform stretch has words) need no extension.
Of candidates with the same first and last word the one of the shortest period is the run; the others are multiples of it.

Documents are independent, so there is no shuffle: a task joins documents up to `CHARS_A_PASS` characters to one array, with a number of
its own at each end, and a longer text is a pass of its own. Transforms take `POINTS` points at a time, or one block.

Defined cases: null, empty and short texts have no runs; repeated rows and null doc_ids are handled each by itself; an empty table gives no
rows. Words are compared as bytes. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHARS_A_PASS, U64, spans_of

LEAST, TIMES, BASE = 24, 3, 8
#: 15 * 2^27 + 1, and a number whose powers are all others: transforms of up to 2^27 points exist, and sums stay under 2^32.
PRIME, GENERATOR = 2013265921, 31
POINTS, GROUP = 1 << 16, 64
P = U64(PRIME)
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(1, U64), base
    while len(out) < n:
        out = np.concatenate((out, out * U64(step) % P))
        step = step * step % PRIME
    return out[:n]


@lru_cache(64)
def _factors(half: int, inverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a root of unity of order 2 * half, and their quotients by the prime in 32-bit fractions."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    w = _powers(pow(root, PRIME - 2, PRIME) if inverse else root, half)
    return w, (w << U64(32)) // P


def _times(x: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """x (under 2^32) times the factors, modulo the prime, without a division."""
    r = x * factors[0] - ((x * factors[1]) >> U64(32)) * P
    return np.minimum(r, r - P)


def _columns(a: np.ndarray) -> np.ndarray:
    """Groups of `GROUP` neighbouring numbers as columns, so that steps within a group run over long rows."""
    return np.ascontiguousarray(a.reshape(-1, min(GROUP, a.shape[1])).T)


def transform(a: np.ndarray) -> np.ndarray:
    """Number-theoretic transforms of the rows of a, whose length is a power of two, as columns in bit-reversed order. a is overwritten."""
    half = a.shape[1] // 2
    while half >= GROUP:
        _split(a.reshape(len(a), -1, 2, half), _factors(half, False))
        half //= 2
    out = _columns(a)
    while half:
        _split(out.reshape(-1, 2, half, out.shape[1]).swapaxes(0, 1)[None].swapaxes(1, 2), tuple(f[:, None] for f in _factors(half, False)))
        half //= 2
    return out


def _split(pairs: np.ndarray, factors: tuple[np.ndarray, ...]) -> None:
    u, v = pairs[:, :, 0], pairs[:, :, 1]
    total, less = u + v, u + (P - v)
    pairs[:, :, 0] = np.minimum(total, total - P)
    pairs[:, :, 1] = _times(less, factors)


def _join(pairs: np.ndarray, factors: tuple[np.ndarray, ...]) -> None:
    u, v = pairs[:, :, 0], _times(pairs[:, :, 1], factors)
    total, less = u + v, u + (P - v)
    pairs[:, :, 0] = np.minimum(total, total - P)
    pairs[:, :, 1] = np.minimum(less, less - P)


def inverse(out: np.ndarray, rows: int) -> np.ndarray:
    """The `rows` rows whose transforms are the columns of out, which is overwritten."""
    n, half = out.size // max(rows, 1), 1
    while half < len(out):
        _join(out.reshape(-1, 2, half, out.shape[1]).swapaxes(0, 1)[None].swapaxes(1, 2), tuple(f[:, None] for f in _factors(half, True)))
        half *= 2
    a = np.ascontiguousarray(out.T).reshape(rows, n)
    while half < n:
        _join(a.reshape(rows, -1, 2, half), _factors(half, True))
        half *= 2
    return a * U64(pow(n, PRIME - 2, PRIME)) % P


def zero_distances(x: np.ndarray, starts: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and distances (least to 2 * size - 1) at which a block of x has a sum of squared differences of 0 modulo the prime.

    x: word numbers from 0; no block holds the number len(x), which stands for what is behind the end."""
    n, wide = len(x), 4 * size
    padded = np.concatenate((x, np.full(3 * size, n))).astype(U64) % P
    squares = np.concatenate((np.zeros(1, U64), np.cumsum(padded * padded % P)))
    shifts = np.arange(least, 2 * size)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    step = max(1, POINTS // wide)
    for lo in range(0, len(starts), step):
        s = starts[lo : lo + step]
        block, window = np.zeros((len(s), wide), U64), np.zeros((len(s), wide), U64)
        own = padded[s[:, None] + np.arange(size)]
        block[:, 0], block[:, :-size:-1] = own[:, 0], own[:, 1:]
        window[:, : 3 * size - 1] = padded[s[:, None] + np.arange(3 * size - 1)]
        cross = inverse(transform(block) * transform(window) % P, len(s))[:, least : 2 * size]
        at = s[:, None] + shifts
        both = (squares[s + size] - squares[s])[:, None] + squares[at + size] - squares[at]
        row, column = np.nonzero(both % P == U64(2) * cross % P)
        found.append((s[row], shifts[column]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _reach(x: np.ndarray, i: int, d: int) -> int:
    """The first j from i on with x[j] other than x[j + d], or where x ends."""
    step = 64
    while (m := min(step, len(x) - d - i)) > 0:
        differ = x[i : i + m] != x[i + d : i + d + m]
        k = int(differ.argmax())
        if differ[k]:
            return i + k
        i, step = i + m, step * 2
    return i


def _back(x: np.ndarray, i: int, d: int) -> int:
    """The smallest j with x[k] equal to x[k + d] for all k from j to before i."""
    step = 64
    while (m := min(step, i)) > 0:
        differ = (x[i - m : i] != x[i - m + d : i + d])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return i - k
        i, step = i - m, step * 2
    return i


def _ends(n: int, runs: np.ndarray) -> np.ndarray:
    """For each of n words the greatest end of the runs (start, end, period) that start up to it."""
    far = np.zeros(n, np.int64)
    np.maximum.at(far, runs[:, 0], runs[:, 1])
    return np.maximum.accumulate(far)


def find_runs(x: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of x, by start, then period.

    x: word numbers under len(x); the word at the end of each document is a number of its own. longest: words of the longest document."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    ahead = np.full(n, n + 1)
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    runs: dict[tuple[int, int], int] = {}  # (start, end): shortest period
    size = BASE
    while max(LEAST, TIMES * size) <= longest:
        least = 1 if size == BASE else size
        full = n // size * size
        starts = np.flatnonzero((ahead[:full] < 2 * size).reshape(-1, size).all(1)) * size
        known = np.array([(a, b, q) for (a, b), q in runs.items()], np.int64).reshape(-1, 3)
        far = _ends(n, known)
        starts = starts[far[starts] < starts + 3 * size]
        s, d = zero_distances(x, starts, size, least)
        fine = known[(size >= LEAST) & (known[:, 2] * 3 <= size) & (known[:, 1] - known[:, 0] >= size)]
        end = _ends(n, fine)[s]  # of a run of a much shorter period that holds the block
        stops = np.zeros(n + 1, bool)
        stops[fine[:, 1]] = True
        aligned = stops[np.minimum(end + d, n)] | stops[np.maximum(end - d, 0)]
        kept = (far[s] < s + d + size) & ((end < s + size) | aligned)
        s, d = s[kept], d[kept]
        by = np.lexsort((s, d))
        s, d = s[by], d[by]
        first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + size)))[: len(s)])
        for lo, hi in zip(first, np.concatenate((first[1:], [len(s)])), strict=True) if len(s) else ():
            period, at, end = int(d[lo]), int(s[lo]), int(s[hi - 1]) + size
            while at < end:  # once, but for sums that are 0 modulo the prime alone
                stop = _reach(x, at, period)
                start = _back(x, at, period)
                if stop > start and stop - start + period >= max(LEAST, TIMES * period):
                    key = (start, stop + period)
                    runs[key] = min(period, runs.get(key, period))
                at = max(stop, at) // size * size + size
        size *= 2
    return np.array(sorted((a, b - a, q) for (a, b), q in runs.items()), np.int64).reshape(-1, 3)[:, :3]


def runs_of_texts(texts: list[str | None]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs (start, length, period) of each text."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes are split at \\x20 and \\x09 to \\x0D
    sizes = np.array([len(w) + 1 for w in words], np.int64)
    ends = np.cumsum(sizes)
    x = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    if not len(x):
        return
    inside = np.ones(len(x), bool)
    inside[ends - 1] = False
    flat = np.empty(len(x) - len(ends), object)
    flat[:] = [w for own in words for w in own]
    codes, kinds = pd.factorize(flat)
    x[inside] = codes
    x[~inside] = len(kinds) + np.arange(len(ends))
    found = find_runs(x, int(sizes.max()) - 1)
    bounds = np.searchsorted(found[:, 0], np.concatenate(([0], ends)))
    for i, own in enumerate(words):
        part = found[bounds[i] : bounds[i + 1]].copy()
        part[:, 0] -= ends[i] - sizes[i]
        yield own, part[np.lexsort((part[:, 2], part[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run contains after its first period, joined by one space."""
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
        kept = np.cumsum(steps)[:-1] == 0
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed (the text without repetitions) of docs (doc_id, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in spans_of([len(t or "") for t in texts], CHARS_A_PASS):
                found = list(runs_of_texts(texts[lo:hi]))
                flat = np.concatenate([r for _, r in found])
                offsets = np.concatenate(([0], np.cumsum([len(r) for _, r in found])))
                rows = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows).cast(kind)
                own = [pa.array([len(w) for w, _ in found], pa.int64()), lists, pa.array([collapsed(w, r) for w, r in found], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *own], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, RUNS)


def strongest(runs: Column) -> Column:
    """The run of the greatest exact length / period, the first of equal ones; null where there is none."""
    more = lambda best, r: r["length"] * best["period"] > best["length"] * r["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))


def listed(runs: Column) -> Column:
    """start,length,period and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def _repeated(text: pd.Series, start: pd.Series, parts: pd.Series) -> pd.Series:
    out = []
    for t, g, k in zip(text, start, parts, strict=True):
        words = (t or "").encode("utf-8", "surrogatepass").split()
        if not words:
            out.append(t)
            continue
        n = len(words)
        a = int(g) % n
        p = 1 + (n - a) // int(k)
        out.append(b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))]).decode("utf-8", "surrogatepass"))
    return pd.Series(out, dtype=object)


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where a tenth of the texts, by crc32 of doc_id, repeats a part up to its end. Rows without doc_id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = F.col("doc_id").isNotNull() & (h % 10 == 0)
    changed = F.pandas_udf(_repeated, "string")(F.when(chosen, F.col("text")), F.when(chosen, g), F.when(chosen, 3 + g % 8))
    return docs.select("doc_id", F.when(chosen, changed).otherwise(F.col("text")).alias("text"))
