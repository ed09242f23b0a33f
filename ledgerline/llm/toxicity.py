"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary labelled text, predict the letters of each
word and its end from up to four letters before. Counts of 5-grams and the weights of backing off from them are each class's own;
all lower orders are continuation counts over both classes, so that rare expressions fall back to what the classes share. A
text is scored by the models' log-likelihood ratio: over the whole text and over its most telling word, both normalised by
length as well as summed for that word; a logistic curve, fitted on labelled rows left out of the counts (on labelled rows as they are, where those left out are all of one class), turns these into a score.

Counting is one Spark aggregation over every labelled text that may be learned from. The rows of the logistic curve are measured
by models without their counts; all other scores come from models with all counts. Each distinct 5-gram of the documents gets its
ratio once, by joins with the whole count tables of all orders, contexts' back-off weights included. The most frequent 5-grams
(FREQUENT at most) are sent to the tasks; words with others meet their ratios in a join.

Defined cases: letters are what Unicode counts as letters or digits, in lower case, numbered modulo 4,095; null and empty texts have
no words and get the share of toxic ones among the labelled; null labels don't count; a doc_id labelled twice is toxic if any of its
labels is; rows with a null doc_id are scored, never learned from; repeated rows are scored each. With no usable labels at all
every score is 0. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, spans_of, stored

ORDER, BITS = 5, 12
#: 5-grams, the most frequent ones, whose ratios are sent to the tasks. Others are joined.
FREQUENT = 1_000_000
#: Labelled rows, about this many at most (chosen by hash), on which the logistic curve is fitted.
CALIBRATION_ROWS = 20_000
CLASSES, SHARED = ["c0", "c1", "c2", "c3"], ["n0", "n1"]
U64 = np.uint64


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code points to 12-bit letter numbers; 0 for what is no part of a word."""
    return np.array([_number(cp) for cp in range(65_536)])


def _number(cp: int) -> int:
    if not (ch := chr(cp)).isalnum():
        return 0
    low = ch.lower()
    return 1 + (ord(low) if len(low) == 1 else cp) % ((1 << BITS) - 1)


def numbers(cps: np.ndarray) -> np.ndarray:
    """Letter numbers of code points."""
    out = _letters()[np.minimum(cps, 65_535)]
    for cp in np.unique(cps[cps > 65_535]).tolist():
        out[cps == cp] = _number(cp)
    return out


def events(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the models predict in the texts: 5-grams (letter numbers, the predicted one lowest), which of them begin a
    word, and the text each belongs to. The end of a word is predicted as letter 0."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    c = numbers(np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32))
    gram, begins, keep = grams(c)
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    return gram, begins, of[keep]


def grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 5-grams of letter numbers, which of them begin a word, and which places have one."""
    prev = np.concatenate(([0], c[:-1]))
    gram, shifted = c.copy(), c
    for k in range(1, ORDER):  # letters before the word's start stay 0
        shifted = np.where(shifted > 0, np.concatenate(([0], shifted[:-1])), 0) if k > 1 else np.where(c + prev > 0, prev, 0)
        gram |= shifted << (BITS * k)
    keep = (c > 0) | (prev > 0)
    return gram[keep], ((c > 0) & (prev == 0))[keep], keep


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pd.DataFrame:
        keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held])
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.bincount(at, counts).astype(np.int64)
        return pd.DataFrame({"gram": keys >> 2, "mark": keys & 3, "n": counts})

    for pdf in batches:
        texts, marks = pdf["text"].fillna("").tolist(), pdf["mark"].to_numpy(np.int64)
        for i, j in spans_of([len(t) for t in texts]):
            gram, _, of = events(texts[i:j])
            got = np.unique((gram << 2) | marks[i:j][of], return_counts=True)
            held.append(got)
            size += len(got[0])
            if size > 1_500_000:
                out = merged()
                yield out
                held, size = [], 0
    if held:
        yield merged()


def train(labelled: DataFrame) -> tuple[dict[int, DataFrame], tuple[int, int]] | None:
    """Counts of all n-grams by order, and how many events the classes have. labelled: text, toxic, held (0 or 1).

    Highest order: c0 and c1 of ordinary and toxic texts without held rows, c2 and c3 of all. Lower orders, shared by the
    classes: how many different letters come before the n-gram, n0 without held rows, n1 in all. None if a class has no words."""
    marked = labelled.select("text", (F.col("toxic").cast("long") + 2 * F.col("held").cast("long")).alias("mark"))
    counts = marked.mapInPandas(_count_grams, "gram long, mark long, n long")
    of = lambda *marks: F.sum(F.when(F.col("mark").isin(*marks), F.col("n")).otherwise(0))
    levels = {ORDER: stored(counts.groupBy("gram").agg(of(0).alias("c0"), of(1).alias("c1"), of(0, 2).alias("c2"), of(1, 3).alias("c3")))}
    seen = {"n0": F.col("c0") + F.col("c1") > 0, "n1": F.col("c2") + F.col("c3") > 0}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = stored(levels[k + 1].groupBy(_suffix(k).alias("gram")).agg(*[F.sum(on.cast("long")).alias(n) for n, on in seen.items()]))
        seen = {n: F.col(n) > 0 for n in SHARED}
    total = levels[ORDER].agg(*[F.sum(c) for c in CLASSES]).first()
    return (levels, (int(bool(total[0] and total[1])), int(bool(total[2] and total[3])))) if total[2] and total[3] else None


def _suffix(k: int) -> Column:
    return F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)


def gram_ratios(asked: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """asked (distinct 5-grams: gram, n) with r0, r1: the log-likelihood ratio by the models without held rows, and by those of all."""
    lower: DataFrame | None = None
    for k in range(1, ORDER + 1):
        level, names = levels[k], CLASSES if k == ORDER else SHARED
        once = level.agg(*[F.sum((F.col(c) == n).cast("long")).alias(f"{c}{n}") for c in names for n in (1, 2)]).first()
        discount = {c: once[f"{c}1"] / (once[f"{c}1"] + 2 * once[f"{c}2"]) if once[f"{c}1"] and once[f"{c}2"] else 0.5 for c in names}
        context = F.shiftright("gram", BITS)
        sums = level.groupBy(context.alias("context")).agg(*[F.sum(c).alias(f"s{c}") for c in names], *[F.sum((F.col(c) > 0).cast("long")).alias(f"u{c}") for c in names])
        rows = asked.select(_suffix(k).alias("gram")).distinct().join(level, "gram", "left").withColumn("context", context).join(sums, "context", "left")
        rows = rows.fillna(0, [*names, *[f"{x}{c}" for x in "su" for c in names]])
        if lower is None:  # below single letters: all letter numbers alike
            rows = rows.withColumns({f"q{m}": F.lit(1.0 / (1 << BITS)) for m in (0, 1)})
        else:
            rows = rows.withColumn("suffix", _suffix(k - 1)).join(lower, "suffix")

        def p(c: str, q: str, discount: dict[str, float] = discount) -> Column:
            own = F.greatest(F.col(c) - F.lit(discount[c]), F.lit(0.0))
            return F.when(F.col(f"s{c}") > 0, (own + F.lit(discount[c]) * F.col(f"u{c}") * F.col(q)) / F.col(f"s{c}")).otherwise(F.col(q))

        if k == ORDER:
            ratios = rows.select("gram", *[F.log(p(CLASSES[2 * m + 1], f"q{m}") / p(CLASSES[2 * m], f"q{m}")).alias(f"r{m}") for m in (0, 1)])
            return stored(asked.join(ratios, "gram"))
        lower = stored(rows.select(F.col("gram").alias("suffix"), *[p(n, f"q{m}").alias(f"q{m}") for m, n in enumerate(SHARED)]))
    raise AssertionError


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, n: the 5-grams of the texts; one may come several times."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def merged() -> pa.RecordBatch:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["gram", "n"])

    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        for i, j in spans_of([len(t) for t in texts]):
            held.append(np.unique(events(texts[i:j])[0], return_counts=True))
            size += len(held[-1][0])
            if size > 3_000_000:
                yield merged()
                held, size = [], 0
    if held:
        yield merged()


def _keys() -> list[Column]:
    """128 bits that stand for a text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("ka"), F.xxhash64(F.lit(1), text).alias("kb")]


PARTS = ["events", "a0", "a1", "b0", "b1", "c0", "c1"]
OTHERS = "array<struct<word:int, events:int, r0:double, r1:double, grams:array<long>>>"


def _measured(texts: list[str], known: np.ndarray, ratio: np.ndarray) -> tuple[list[np.ndarray], list[list[tuple]]]:
    """Of each text the PARTS by its words whose 5-grams are all known, and the other words."""
    gram, begins, of = events(texts)
    keys, at = np.unique(gram, return_inverse=True)
    place = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    hit = known[place] == keys if len(known) else np.zeros(len(keys), bool)
    r = np.zeros((len(keys), 2))
    r[hit] = ratio[place[hit]]
    first = np.flatnonzero(begins)
    size = np.diff(np.append(first, len(gram)))
    sums = np.add.reduceat(r[at], first) if len(first) else np.empty((0, 2))
    ok = np.logical_and.reduceat(hit[at], first) if len(first) else np.empty(0, bool)
    text, n = of[first], len(texts)
    own, r_own, size_own = text[ok], sums[ok], size[ok]
    out = [np.bincount(own, size_own, n).astype(float), *[np.bincount(own, r_own[:, m], n).astype(float) for m in (0, 1)]]
    start = np.flatnonzero(np.diff(own, prepend=-1))
    for by in (np.ones(len(own)), size_own):
        for m in (0, 1):
            most = np.full(n, -np.inf)
            if len(own):
                most[own[start]] = np.maximum.reduceat(r_own[:, m] / by, start)
            out.append(most)
    others: list[list[tuple]] = [[] for _ in texts]
    for w in np.flatnonzero(~ok):
        its = gram[first[w] : first[w] + size[w]]
        others[text[w]].append((int(w), int(size[w]), *sums[w].tolist(), its[~hit[at[first[w] : first[w] + size[w]]]].tolist()))
    return out, others


def features(docs: DataFrame, ratios: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """ka, kb (of a distinct text), events, and by each model (0: without held rows, 1: all) the ratio per event, that of the most telling
    word, and the largest ratio per event of a word: a0, b0, c0, a1, b1, c1."""
    spark = docs.sparkSession
    size = F.floor(F.log2("n")).cast("int")
    least, held = 64, 0
    for r in sorted(ratios.groupBy(size.alias("size")).count().collect(), reverse=True):  # 64 rows at most
        held += r["count"]
        if held > frequent:
            break
        least = r["size"]
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    top = ratios.where(size >= least).select("gram", "r0", "r1").toPandas().sort_values("gram")  # `frequent` rows at most
    table = spark.sparkContext.broadcast((top["gram"].to_numpy(np.int64), top[["r0", "r1"]].to_numpy(np.float64)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ratio = table.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in spans_of([len(t) for t in texts]):
                parts, others = _measured(texts[i:j], known, ratio)
                cells = [pa.array(np.arange(row, row + j - i)), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)]
                cells += [pa.array(p, mask=~np.isfinite(p)) for p in parts]
                kind = pa.list_(pa.struct([("word", pa.int32()), ("events", pa.int32()), ("r0", pa.float64()), ("r1", pa.float64()), ("grams", pa.list_(pa.int64()))]))
                listed = [[dict(zip(("word", "events", "r0", "r1", "grams"), x, strict=True)) for x in ws] for ws in others]
                row += j - i
                yield pa.RecordBatch.from_arrays([*cells, pa.array(listed, kind)], ["row", "ka", "kb", *PARTS, "others"])

    rows = stored(docs.select(*_keys(), "text").mapInArrow(measure, f"row long, ka long, kb long, {', '.join(f'{c} double' for c in PARTS)}, others {OTHERS}"))
    # words with 5-grams that were not sent to the tasks
    words = rows.select("row", "ka", "kb", F.explode("others").alias("w")).select("row", "ka", "kb", "w.word", "w.events", "w.r0", "w.r1", "w.grams")
    rest = words.select("row", "ka", "kb", "word", F.explode("grams").alias("gram")).join(ratios.where(size < least).select("gram", "r0", "r1"), "gram").select("row", "ka", "kb", "word", F.lit(0).alias("events"), "r0", "r1")
    words = words.drop("grams").unionByName(rest).groupBy("row", "ka", "kb", "word").agg(*[F.sum(c).alias(c) for c in ("events", "r0", "r1")])
    columns = {"events": F.col("events").cast("double")} | {f"{x}{m}": F.col(f"r{m}") / (F.col("events") if x == "c" else 1) for x in "abc" for m in (0, 1)}
    whole = rows.select("ka", "kb", *PARTS).unionByName(words.select("ka", "kb", *[v.alias(c) for c, v in columns.items()])).groupBy("ka", "kb").agg(*[(F.sum if c[0] in "ea" else F.max)(c).alias(c) for c in PARTS])
    return whole.select("ka", "kb", "events", *[F.coalesce(F.col(f"a{m}") / F.nullif("events", F.lit(0.0)), F.lit(0.0)).alias(f"a{m}") if x == "a" else F.coalesce(f"{x}{m}", F.lit(0.0)).alias(f"{x}{m}") for m in (0, 1) for x in "abc"])


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression (constant first), by Newton's steps. The ridge counts weights of unit spread."""
    if len(y) == 0 or y.min() == y.max():
        return np.array([0.0, 1.0, 0.0, 0.0])
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    a = np.column_stack([np.ones(len(x)), x / spread])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, 0.1, 0.1, 0.1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / np.concatenate(([1.0], spread))


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def score(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS, frequent: int = FREQUENT) -> DataFrame:
    """docs with toxic_score (0 to 1) added; any column of that name is replaced.

    Learns from all labelled rows whose fold is not 0. Rows of fold 1, about `calibration_rows` at most (by hash), are those whose
    measures by models without their counts give the logistic curve."""
    docs = docs.drop("toxic_score")
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where(fold(F.col("doc_id")) != 0)
    share = min(1.0, calibration_rows / max(1, marks.where(fold(F.col("doc_id")) == 1).count()))
    held = (fold(F.col("doc_id")) == 1) & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    marks = marks.withColumn("held", held.cast("int"))
    rows = docs.select("doc_id", "text").where(fold(F.col("doc_id")) != 0).join(bounded_broadcast(marks), "doc_id")
    model = train(rows)
    if model is None:
        return docs.withColumn("toxic_score", F.lit(0.0))
    levels, usable = model
    asked = stored(docs.select("text").mapInArrow(_asked, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    measured = stored(features(docs, gram_ratios(asked, levels), frequent))

    def measures(sample: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
        got = sample.select("toxic", *_keys()).join(measured, ["ka", "kb"]).select("toxic", *[f"{x}{m}" for x in "abc"]).toPandas()
        return got[[f"{x}{m}" for x in "abc"]].to_numpy(float), got["toxic"].to_numpy(float)

    x, y = measures(rows.where("held = 1"), 0) if usable[0] else (np.empty((0, 3)), np.empty(0))
    if len(set(y)) < 2:  # too few labels to leave rows of both classes out
        part = min(1.0, calibration_rows / max(1, rows.count()))
        x, y = measures(rows.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < int(part * 1_000_000)), 1)
    w = fit_curve(x, y)
    z = F.lit(float(w[0])) + sum(F.lit(float(v)) * F.col(c) for v, c in zip(w[1:], ("a1", "b1", "c1"), strict=True))
    prior = min(max(rows.agg(F.avg("toxic")).first()[0] or 0.0, 1e-6), 1 - 1e-6)
    z = F.when(F.col("events") > 0, z).otherwise(F.lit(float(np.log(prior / (1 - prior)))))  # no words: what labelled texts are on average
    scores = measured.select("ka", "kb", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("toxic_score"))
    ka, kb = _keys()
    out = docs.withColumns({"#ka": ka, "#kb": kb}).join(bounded_broadcast(scores.withColumnsRenamed({"ka": "#ka", "kb": "#kb"})), ["#ka", "#kb"])
    return out.select(*[out[c] for c in docs.columns], "toxic_score")


__all__ = ["features", "fold", "gram_ratios", "score", "train"]
