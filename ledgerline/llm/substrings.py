"""Removal of repeated passages by compressed FM-indexes, one for each shard.

A window is `WINDOW` consecutive words. Consecutive windows of a document with the same minimizer (the smallest hash of
their five-word sequences) form a segment; equal windows have equal minimizers, so a window and its repetitions always
meet in one shard and no document has to be streamed through every shard. Segments whose minimizer occurs once, also within them, are done.
Equal segments are folded into their first occurrence before anything else: later ones repeat it in every window.

What is left, distinct segments that share a minimizer, goes to shards of bounded size. A shard's FM-index has the
suffix order to the depth of a window, the Burrows-Wheeler transform in a wavelet matrix (packed bit planes with rank
counts), and the bounds of suffixes that agree in one word less than a window. The segments are streamed through it from
right to left: backward search extends the match by a word; a match of a full window is reported and shortened at its
right end by widening the interval to those bounds, so each word costs one step. The interval's first
occurrence tells whether the window starts earlier elsewhere. A minimizer with more than `HOT` distinct segments (a frequent
phrase in many contexts) has its segments cut into single windows, which fold into their first occurrence as segments do, in an
aggregation that combines before it shuffles: no task gathers the copies of one window.

Words are compared by 64-bit hashes, segments by 64-bit hashes of their words.

Defined cases: null, empty and short texts have no windows; repeated rows are one document (nothing in one repeats the
other); if rows with one doc_id differ in text, what is found in one goes from all; rows with a null doc_id lose nothing
and nothing is lost because of them. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, rolling, spans_of, split_join, stored, word_hashes

WINDOW, GRAM = 20, 5
#: Windows of a segment at most; segments of a minimizer above which they are cut into single windows; words of a shard.
LONGEST, HOT, SHARD_WORDS = 64, 2_000, 400_000
U64 = np.uint64
IN_WORDS = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)], np.uint8)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the numbers of words before each text (and in all)."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    first, h = word_hashes(b"\n".join(parts), IN_WORDS)
    return h, np.searchsorted(first, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))))


def segments(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each segment: minimizer, hash of its words, text number, first word in the text, number of windows, and
    whether the minimizer occurs in it more than once (only then can a window repeat within it)."""
    none = np.empty(0, np.int64)
    if len(h) < WINDOW:
        return none.view(U64), none.view(U64), none, none, none, none.astype(bool)
    m = grams = rolling(h, GRAM)
    width = 1
    while width < WINDOW - GRAM + 1:
        step = min(width, WINDOW - GRAM + 1 - width)
        m = np.minimum(m[:-step], m[step:])
        width += step
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(of[: len(m)] == of[WINDOW - 1 :])
    if not len(at):
        return none.view(U64), none.view(U64), none, none, none, none.astype(bool)
    m = m[at]
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)))
    run = np.flatnonzero(new)
    new[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % LONGEST == 0] = True
    run = np.flatnonzero(new)
    n = np.diff(np.append(run, len(at)))
    start = at[run]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate(([U64(1)], np.full(len(h), BASE))), dtype=U64)
        inverse = np.cumprod(np.concatenate(([U64(1)], np.full(len(h), BASE_INVERSE))), dtype=U64)
        sums = np.concatenate(([U64(0)], np.cumsum(h * powers[:-1], dtype=U64)))
        content = mix64((sums[start + n + WINDOW - 1] - sums[start]) * inverse[start] + n.astype(U64))
    size = n + WINDOW - GRAM
    ends = np.cumsum(size)
    same = grams[np.arange(ends[-1]) + np.repeat(start - ends + size, size)] == np.repeat(m[run], size)
    return m[run], content, of[start], start - offsets[of[start]], n, np.add.reduceat(same.astype(np.int32), ends - size) > 1


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts, ids = pdf["text"].tolist(), pdf["doc_id"].to_numpy(np.int64)
        for i, j in spans_of([len(t) for t in texts]):
            m, content, of, start, n, twice = segments(*words_of(texts[i:j]))
            yield pd.DataFrame({"m": m.view(np.int64), "s": content.view(np.int64), "doc_id": ids[i:j][of], "start": start, "n": n, "twice": twice})


class WaveletMatrix:
    """Bit planes of a sequence of symbols, highest bit first, with numbers of ones before each 64 bits."""

    def __init__(self, symbols: np.ndarray, count: int) -> None:
        self.levels = max(1, int(count - 1).bit_length())
        self.planes: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = symbols.astype(np.int64)
        for bit in range(self.levels - 1, -1, -1):
            ones = (now >> bit & 1).astype(bool)
            padded = np.zeros((len(now) // 64 + 1) * 64, bool)
            padded[: len(now)] = ones
            packed = np.packbits(padded, bitorder="little").view(U64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1])).astype(np.int32)
            self.planes.append((packed, before, int(len(now) - ones.sum())))
            now = np.concatenate((now[~ones], now[ones]))
        self.first = self._down(np.arange(count), np.zeros(count, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (packed, before, zeros) in enumerate(self.planes):
            word, bit = at >> 6, (at & 63).astype(U64)
            ones = before[word] + np.bitwise_count(packed[word] & ((U64(1) << bit) - U64(1)))
            at = np.where(symbol >> (self.levels - 1 - level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of the symbols before the positions."""
        return self._down(symbol, at) - self.first[symbol]


class FMIndex:
    """Backward search of patterns of up to `depth` (20) words in sequences of word hashes; symbol 0 ends each sequence."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, depth: int = WINDOW) -> None:
        self.alphabet, ids = np.unique(words, return_inverse=True)
        self.starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
        text = np.zeros(len(words) + len(lengths), np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = ids + 1
        self.text, self.size, self.depth = text, len(text), depth

        def ahead(rank: np.ndarray, k: int) -> np.ndarray:
            return np.concatenate((rank[k:], np.zeros(min(k, len(rank)), np.int64)))

        rank, width, ranks = text, 1, {1: text}
        while width * 2 <= depth:
            rank = np.unique(rank * (int(rank.max()) + 1) + ahead(rank, width), return_inverse=True)[1].astype(np.int64)
            width *= 2
            ranks[width] = rank
        # first `depth` (or one fewer) words: those of `width`, then an overlapping piece that ends where they end
        piece = next(w for w in sorted(ranks) if width + w >= depth)
        whole = rank * (int(ranks[piece].max()) + 1) + ahead(ranks[piece], depth - piece)
        order = np.argsort(whole, kind="stable")
        fewer = rank * (int(ranks[piece].max()) + 1) + ahead(ranks[piece], depth - 1 - piece)
        self.order = order
        self.group = np.concatenate(([True], np.diff(whole[order]) != 0)).cumsum() - 1  # suffixes equal to `depth`
        self.group_starts = np.flatnonzero(np.concatenate(([True], np.diff(self.group) != 0)))
        new = np.concatenate(([True], np.diff(fewer[order]) != 0))
        edges = np.flatnonzero(new)
        which = new.cumsum() - 1
        self.wide_lo, self.wide_hi = edges[which], np.append(edges[1:], self.size)[which]
        self.bwt = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))[:-1]))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; -1 for words that don't occur."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, at + 1, -1)

    def windows(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of the streamed sequences that occur in the index: sequence, first word, group of their suffixes."""
        symbol = self.symbols(words)
        base = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        live = np.flatnonzero(lengths >= self.depth)
        end = lengths[live].astype(np.int64)
        at, deep, lo, hi = end - 1, np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.full(len(live), self.size)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            c = symbol[base[live] + at]
            known = np.maximum(c, 0)
            both = self.bwt.rank(np.concatenate((known, known)), np.concatenate((lo, hi)))
            lo2, hi2 = self.before[known] + both[: len(live)], self.before[known] + both[len(live) :]
            found = (hi2 > lo2) & (c > 0)
            lo, hi, deep = np.where(found, lo2, 0), np.where(found, hi2, self.size), np.where(found, deep + 1, 0)
            end = np.where(found, end, np.where(c > 0, end - 1, at))
            at = np.where(found, at - 1, end - 1)
            full = np.flatnonzero(deep == self.depth)
            if len(full):
                out.append((live[full], at[full] + 1, self.group[lo[full]]))
                hi[full] = self.wide_hi[lo[full]]
                lo[full] = self.wide_lo[lo[full]]
                deep[full] -= 1
                end[full] -= 1
            go = (at >= 0) & (end >= self.depth)
            if not go.all():
                live, end, at, deep, lo, hi = live[go], end[go], at[go], deep[go], lo[go], hi[go]
        if not out:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated(words: np.ndarray, docs: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (document, first word in it) of the sequences that also start earlier in them."""
    index = FMIndex(words, lengths)
    rank = np.unique(docs, return_inverse=True)[1].astype(np.int64)
    place = np.full(index.size, np.iinfo(np.int64).max)
    inner = np.arange(len(words)) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    place[np.repeat(index.starts, lengths) + inner] = np.repeat((rank << 32) + starts, lengths) + inner
    first = np.minimum.reduceat(place[index.order], index.group_starts)
    which, at, group = index.windows(words, lengths)
    later = first[group] < (rank[which] << 32) + starts[which] + at
    return docs[which[later]], (starts[which] + at)[later]


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    lengths = pdf["words"].map(len).to_numpy(np.int64) // 8
    words = np.frombuffer(b"".join(pdf["words"]), U64)
    docs, starts = repeated(words, pdf["doc_id"].to_numpy(np.int64), pdf["start"].to_numpy(np.int64), lengths)
    if not len(docs):
        return pd.DataFrame({"doc_id": docs, "lo": docs, "hi": docs})
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(docs) != 0) | (np.diff(starts) > 1))))
    last = np.append(new[1:], len(docs)) - 1
    return pd.DataFrame({"doc_id": docs[new], "lo": starts[new], "hi": starts[last] + WINDOW})


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, dict, np.ndarray]]:
    """Document, wanted segment and its words, batch by batch."""
    for pdf in batches:
        texts, ids, wanted = pdf["text"].tolist(), pdf["doc_id"].tolist(), pdf["wanted"].tolist()
        for i, j in spans_of([len(t) for t in texts]):
            h, offsets = words_of(texts[i:j])
            yield [(ids[t], w, h[offsets[t - i] : offsets[t - i + 1]][w["start"] : w["start"] + w["n"] + WINDOW - 1]) for t in range(i, j) for w in wanted[t]]


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments by their minimizers, with their words; of hot minimizers their single windows, by the windows' hashes, without words."""
    for found in _pieces(batches):
        yield pd.DataFrame([(w["m"], doc, w["start"], part.tobytes()) for doc, w, part in found if not w["hot"]], columns=["route", "doc_id", "start", "words"])
        cut = [(doc, w["start"], rolling(part, WINDOW).view(np.int64)) for doc, w, part in found if w["hot"]]
        if cut:
            n = [len(x) for _, _, x in cut]
            at = np.concatenate([np.arange(start, start + k) for (_, start, _), k in zip(cut, n, strict=True)])
            yield pd.DataFrame({"route": np.concatenate([x for _, _, x in cut]), "doc_id": np.repeat([doc for doc, _, _ in cut], n).astype(np.int64), "start": at, "words": None})


def _cleaned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for text, spans in zip(pdf["text"], pdf["spans"], strict=True):
            words = (text or "").encode("utf-8", "replace").split()  # bytes split at the same six characters
            keep = np.ones(len(words), bool)
            for s in spans if spans is not None else ():
                keep[s["lo"] : s["hi"]] = False
            kept = b" ".join(words if keep.all() else compress(words, keep.tolist()))
            rows.append((len(words), int((~keep).sum()), kept.decode("utf-8")))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        yield out


def _later(rows: DataFrame, firsts: DataFrame, key: list[str]) -> DataFrame:
    """The rows (doc_id, start) that come after the first of their key. firsts: key, first, n."""
    return split_join(rows, firsts.where("n > 1"), key).where(F.struct("doc_id", "start") > F.col("first"))


def passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Ranges of words (doc_id, lo, hi) that windows cover which also start earlier. Ranges may overlap."""
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = docs.mapInPandas(_segments, "m long, s long, doc_id long, start int, n int, twice boolean").withColumnRenamed("n", "size")
    shared = every.groupBy("m").agg(F.count("*").alias("k"), F.max("twice").alias("twice")).where("k > 1 or twice").select("m")
    held = stored(every.join(shared.hint("shuffle_hash"), "m", "left_semi"))
    firsts = stored(held.groupBy("m", "s", "size").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max("twice").alias("twice"), F.count("*").alias("n")))
    later = _later(held.select("m", "s", "size", "doc_id", "start"), firsts.select("m", "s", "size", "first", "n"), ["m", "s", "size"])
    copies = later.select("doc_id", F.col("start").alias("lo"), (F.col("start") + F.col("size") + WINDOW - 1).alias("hi"))
    kinds = firsts.groupBy("m").agg(F.count("*").alias("kinds"), F.max("twice").alias("twice")).where("kinds > 1 or twice").select("m", "kinds")
    mixed = stored(firsts.join(kinds, "m").select("m", F.col("size").alias("n"), "first.doc_id", "first.start", (F.col("kinds") > hot).alias("hot")))
    sums = mixed.agg(F.sum(F.when(~F.col("hot"), F.col("n") + WINDOW - 1)), F.count_if("hot")).first()
    shards = max(1, -(-(sums[0] or 0) // SHARD_WORDS))

    # segments and single windows come from one pass: the texts are shuffled once for both
    wanted = mixed.groupBy("doc_id").agg(F.collect_list(F.struct("m", "start", "n", "hot")).alias("wanted"))
    pieces = docs.join(wanted, "doc_id").mapInPandas(_contents, "route long, doc_id long, start int, words binary")
    if sums[1]:
        pieces = stored(pieces)
    found = pieces.where("words is not null").withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards))).groupBy("shard").applyInPandas(_search, "doc_id long, lo int, hi int")
    if sums[1]:
        windows = pieces.where("words is null").select("route", "doc_id", "start")
        first = stored(windows.groupBy("route").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).where("n > 1"))
        found = found.unionByName(_later(windows, first, ["route"]).select("doc_id", F.col("start").alias("lo"), (F.col("start") + WINDOW).alias("hi")))
    return copies.unionByName(found)


def clean(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by single spaces) of each row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spans = passages(docs, hot).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(spans, "doc_id", "left").mapInPandas(_cleaned, "doc_id long, n_words long, n_removed long, kept string")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
