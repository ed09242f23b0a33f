"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Words are runs of ASCII letters and digits and of any other character beyond ASCII, in lower case; shingles are five
consecutive words, weighted by how often they occur (a shorter text is one shingle). Two texts are linked if the
probability Jaccard similarity of their weighted shingles is 0.8 or more, which for shingles of equal weight is the
plain Jaccard similarity. Classes are the connected components of the links.

ProbMinHash gives each register the shingle whose Poisson process (of a rate equal to its weight) is the first to reach
it; points that come later than the last register's first arrival are never drawn. Registers agree with the probability
Jaccard similarity as their chance. 24 bands of 5 registers make a pair of similarity 0.8 a candidate with a chance of
0.9999.

Texts with equal word sequences are one node, known by 64 bits of its words. Within each bucket a pivot is first verified
against all other members, which joins most of what belongs together at the cost of a pair for each member. Members
of a bucket that are still in different components are then compared in blocks of bounded size, and each block returns
only links that join components. A bucket with over HOT such members (texts around a frequent passage, say) is split first: if
the similarity of two texts is 0.8 or more, what they don't share is at most a fifth of each one's shingles, so in any common order of
shingles the first one they share lies within the first fifth of either. Members meet by these shingles, rarest first, instead of the
bucket: no candidate pair stays untested. Within a block the same rule picks the pairs that are compared.

Defined cases: null, empty and wordless texts are classes of their own; repeated rows are returned each, in one class; rows that
share a doc_id but differ in text are classed each by its own text; a text with a null doc_id is a node like others and links what is
like it, and a class of which no doc_id is known has a null class_id. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, mix64, rolling, spans_of, split_join, stored, uniform, word_hashes

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
#: Members of a pivot that one verification group holds.
MEMBERS_A_GROUP = 256
#: Leftovers and members of a bucket that one block holds.
LEFT_BLOCK, RIGHT_BLOCK = 512, 2_048
#: Leftovers of a bucket above which its members meet by shingles.
HOT = 2_048
#: Links between components that one task joins; more of them are contracted in turns.
TAIL = 100_000
U64 = np.uint64
IN_WORDS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)], np.uint8)
ID_BITS = 44


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the numbers of words before each text (and in all)."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    first, h = word_hashes(b"\n".join(parts), IN_WORDS)
    return h, np.searchsorted(first, starts)


def shingles(h: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (ids of 44 bits, ascending within a text), their counts, and the numbers before each text."""
    texts = len(offsets) - 1
    size = np.diff(offsets)
    of = np.repeat(np.arange(texts), size)
    whole = rolling(h, n)
    ok = np.flatnonzero(of[: len(whole)] == of[n - 1 : n - 1 + len(whole)]) if len(whole) else np.empty(0, np.int64)
    ids, texts_of = whole[ok], of[ok]
    for t in np.flatnonzero((size > 0) & (size < n)):
        short = h[offsets[t] : offsets[t + 1]]
        ids, texts_of = np.append(ids, rolling(short, len(short))), np.append(texts_of, t)
    keys, counts = np.unique((texts_of.astype(U64) << U64(ID_BITS)) | (ids >> U64(64 - ID_BITS)), return_counts=True)
    return keys & U64((1 << ID_BITS) - 1), counts, np.searchsorted(keys, np.arange(texts + 1).astype(U64) << U64(ID_BITS))


def prob_min_hash(ids: np.ndarray, weights: np.ndarray, offsets: np.ndarray, registers: int) -> np.ndarray:
    """A row of `registers` ids (mixed) for each text that has shingles; zeros for the others."""
    texts = len(offsets) - 1
    times = np.full(texts * registers, np.inf)
    out = np.zeros(texts * registers, U64)
    of = np.repeat(np.arange(texts), np.diff(offsets))
    seed, rate, now = mix64(ids + U64(0x51ED270B)), 1.0 / weights, np.zeros(len(ids))
    drawn = 0
    with np.errstate(over="ignore"):
        while len(of):
            ahead = int(max(1, min(64, 100_000 // len(of))))  # few processes left: several arrivals of each at once
            draw = mix64(seed[:, None] + (np.arange(drawn + 1, drawn + ahead + 1).astype(U64) * U64(0x9E3779B97F4A7C15))[None, :])
            t = now[:, None] + np.cumsum(-np.log(uniform(draw)) * rate[:, None], axis=1)
            at = of[:, None] * registers + ((draw & U64(2047)) * U64(registers) >> U64(11)).astype(np.int64)
            drawn += ahead
            now = t[:, -1]
            sooner = np.flatnonzero((t < times[at]).ravel())
            flat_t, flat_at = t.ravel()[sooner], at.ravel()[sooner]
            np.minimum.at(times, flat_at, flat_t)
            won = times[flat_at] == flat_t
            out[flat_at[won]] = seed[sooner[won] // ahead]
            alive = now < times.reshape(texts, registers).max(axis=1)[of]
            of, seed, rate, now = of[alive], seed[alive], rate[alive], now[alive]
    return out.reshape(texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(signature), bands), U64)
    with np.errstate(over="ignore"):
        key += np.arange(1, bands + 1).astype(U64) * U64(0xD6E8FEB86659FD93)
        for r in range(rows):
            key = mix64(key + signature[:, r::rows][:, :bands] + U64(r))
    return key.view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = pdf["text"].fillna("").tolist()
        for i, j in spans_of([len(t) for t in texts]):
            h, offsets = words_of(texts[i:j])
            n = np.diff(offsets)
            place = (np.arange(len(h)) - np.repeat(offsets[:-1], n)).astype(U64)
            keys = np.zeros((2, j - i), U64)
            having = np.flatnonzero(n)
            if len(having):
                with np.errstate(over="ignore"):
                    for k, seed in enumerate((U64(0x2545F4914F6CDD1D), U64(0x9E6C63D0876A9A47))):
                        keys[k, having] = np.add.reduceat(mix64(h + (place + U64(1)) * seed), offsets[:-1][having])
            bands = band_keys(prob_min_hash(*shingles(h, offsets), BANDS * ROWS), BANDS, ROWS)
            own = {c: pdf[c].iloc[i:j].to_numpy() for c in ("doc_id", "named", "row")}
            yield pd.DataFrame({**own, "k1": keys[0].view(np.int64), "k2": keys[1].view(np.int64), "n": n, "bands": list(bands)})


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements d of 1 / sum over all e of max(x_e / x_d, y_e / y_d)."""
    (ids_a, x), (ids_b, y) = a, b
    common, in_a, in_b = np.intersect1d(ids_a, ids_b, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    xc, yc = x[in_a].astype(float), y[in_b].astype(float)
    only_x, only_y = x.sum() - xc.sum(), y.sum() - yc.sum()
    ratio, at = np.unique(yc / xc, return_inverse=True)
    gx, gy = np.bincount(at, xc), np.bincount(at, yc)
    below, above = only_x + np.cumsum(gx), only_y + gy.sum() - np.cumsum(gy)
    return float((gx / (below + above / ratio)).sum())


class Shingled:
    """The weighted shingles of a list of texts."""

    def __init__(self, texts: list[str]) -> None:
        ids, counts, sizes = [], [], []
        for i, j in spans_of([len(t) for t in texts]):
            a, b, offsets = shingles(*words_of(texts[i:j]))
            ids.append(a)
            counts.append(b)
            sizes.append(np.diff(offsets))
        self.ids, self.counts = np.concatenate(ids), np.concatenate(counts)
        self.at = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        self.plain = np.ones(len(texts), bool)
        self.plain[np.repeat(np.arange(len(texts)), np.diff(self.at))[self.counts > 1]] = False

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[self.at[i] : self.at[i + 1]], self.counts[self.at[i] : self.at[i + 1]]

    def first_fifths(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles that make up the first fifth of each text's weight, those that fewest of the texts `which` have first, but for
        those that one text alone has: text and shingle (as a rank) by shingle, and the same texts' entries by text (as places in the former)."""
        size = self.at[which + 1] - self.at[which]
        ends = np.cumsum(size)
        entry = np.arange(ends[-1]) + np.repeat(self.at[which] - ends + size, size)
        of = np.repeat(which, size)
        _, kind, n = np.unique(self.ids[entry], return_inverse=True, return_counts=True)
        rank = np.empty(len(n), np.int64)
        rank[np.argsort(n, kind="stable")] = np.arange(len(n))
        order = np.lexsort((rank[kind], np.repeat(np.arange(len(which)), size)))
        counts = self.counts[entry][order]
        sums = np.concatenate(([0], np.cumsum(counts)))
        starts = np.repeat(sums[ends - size], size)
        first = sums[:-1] - starts <= np.repeat(sums[ends] - sums[ends - size], size) * (1 - THRESHOLD + 1e-9) + 1e-6
        first &= n[kind[order]] > 1
        of, rank = of[order][first], rank[kind[order]][first]
        by = np.argsort(rank, kind="stable")
        return of[by], rank[by], np.argsort(of[by], kind="stable")

    def similar(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are linked to i."""
        own, _ = self.of(i)
        size = self.at[others + 1] - self.at[others]
        if not len(own) or not len(others):
            return np.zeros(len(others), bool)
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.at[others] - ends + size, size)]
        found = np.concatenate(([0], np.cumsum(own[np.minimum(np.searchsorted(own, ids), len(own) - 1)] == ids)))
        common = found[ends] - found[ends - size]
        plain = self.plain[others] & self.plain[i]
        out = plain & (common / (len(own) + size - common) >= THRESHOLD - 1e-9)
        for k in np.flatnonzero(~plain & (common > 0)):
            out[k] = probability_jaccard(self.of(i), self.of(others[k])) >= THRESHOLD - 1e-9
        return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        numbers: dict[str, int] = {}
        left = np.array([numbers.setdefault(t, len(numbers)) for t in pdf["text_a"]])
        right = np.array([numbers.setdefault(t, len(numbers)) for t in pdf["text_b"]])
        texts, keep = Shingled(list(numbers)), np.zeros(len(pdf), bool)
        for i in np.unique(left):
            rows = np.flatnonzero(left == i)
            keep[rows] = texts.similar(i, right[rows])
        yield pdf.loc[keep, ["a", "b"]]


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The batches of a sorted partition, dealt anew so that none ends within a group of equal keys."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = np.logical_and.reduce([pdf[k].to_numpy() == pdf[k].iloc[-1] for k in key])
        cut_at = len(pdf) - int(last.sum())
        if cut_at:
            yield pd.concat([*held, pdf.iloc[:cut_at]], ignore_index=True)
            held = [pdf.iloc[cut_at:]]
        elif held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in key):
            yield pd.concat(held, ignore_index=True)
            held = [pdf]
        else:
            held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key = ["bucket", "lblock", "rblock"]
    for pdf in whole_groups(batches, key):
        numbers: dict[str, int] = {}
        text_of = np.array([numbers.setdefault(t, len(numbers)) for t in pdf["text"]])
        texts = Shingled(list(numbers))
        ids, comps = pdf["id"].to_numpy(), pdf["comp"].to_numpy().copy()
        bands, order = np.stack(pdf["bands"].to_numpy()), pdf["band"].to_numpy()
        left, rest = pdf["left"].to_numpy(), pdf["rest"].to_numpy()
        edges = np.flatnonzero(np.logical_or.reduce([pdf[k].to_numpy()[1:] != pdf[k].to_numpy()[:-1] for k in key])) + 1
        out = []
        for lo, hi in zip([0, *edges], [*edges, len(pdf)], strict=True):
            right = np.flatnonzero(~left[lo:hi]) + lo
            of, rank, by_text = texts.first_fifths(np.unique(text_of[lo:hi]))
            met = np.zeros(len(numbers), bool)
            for x in np.flatnonzero(left[lo:hi]) + lo:
                # of two leftovers the smaller id is the left one; pairs that met in an earlier band were tested there
                to = right[(comps[right] != comps[x]) & (~rest[right] | (ids[right] > ids[x]))]
                own = rank[by_text[slice(*np.searchsorted(of, [text_of[x], text_of[x] + 1], sorter=by_text))]]
                meets = [of[a:b] for a, b in zip(np.searchsorted(rank, own), np.searchsorted(rank, own, "right"), strict=True)]
                for m in meets:
                    met[m] = True
                to = to[met[text_of[to]]]
                for m in meets:
                    met[m] = False
                to = to[~(bands[to, : order[x]] == bands[x, : order[x]]).any(axis=1)]
                to = to[texts.similar(text_of[x], text_of[to])]
                if len(to):
                    _, first = np.unique(comps[to], return_index=True)  # one link to each other component
                    out += [(ids[x], ids[y]) for y in to[first]]
                    group = comps[lo:hi]
                    group[np.isin(group, comps[to])] = comps[x]
        yield pd.DataFrame(out, columns=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough. texts: id, text.

    A pivot's members are dealt into groups of bounded size, and its text goes to each group once."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_A_GROUP).cast("int").alias("groups"))
    wide = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int")).drop("groups")
    wide = wide.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    pivots = sizes.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    return wide.join(pivots, ["a", "part"]).select("a", "b", "text_a", "text_b").mapInPandas(_verify, "a long, b long")


def _weighted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """bucket, band, id, shingle, share: the shingles of each text and their parts of its weight."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        for i, j in spans_of([len(t) for t in texts]):
            ids, counts, at = shingles(*words_of(texts[i:j]))
            n = np.diff(at)
            total = np.add.reduceat(counts, at[:-1]) if len(counts) else counts
            own = {c: np.repeat(pdf[c].to_numpy()[i:j], n) for c in ("bucket", "band", "id")}
            yield pd.DataFrame({**own, "shingle": ids.view(np.int64), "share": counts / np.repeat(total, n)})


def by_prefix(members: DataFrame, texts: DataFrame) -> DataFrame:
    """members (bucket, band, id) by bucket and shingle instead of bucket alone: the shingles that make up the first fifth of a
    text's weight, in the order of how many members have them. Shingles of one member alone lead nowhere and are left out."""
    rows = stored(members.join(texts.select("id", "text"), "id").mapInPandas(_weighted, "bucket long, band int, id long, shingle long, share double"))
    counts = rows.groupBy("bucket", "shingle").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("share").over(Window.partitionBy("bucket", "id").orderBy("n", "shingle").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    first = split_join(rows, stored(counts), ["bucket", "shingle"]).withColumn("before", before).where(F.col("before") <= 1 - THRESHOLD + 1e-9)
    return first.where("n > 1").select(F.xxhash64("bucket", "shingle").alias("bucket"), "band", "id")


def across_components(members: DataFrame, comps: DataFrame, texts: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between members of a bucket in different components, enough of them to join what they link.

    members: bucket, band, id, without the pivots, which have been tested against their whole buckets. In a bucket all
    members outside its largest component are leftovers; blocks of them meet blocks of all members."""

    def sized(at: DataFrame) -> DataFrame:
        sizes = at.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top"))
        return sizes.where("comps > 1").withColumn("left_over", F.col("n") - F.col("top.n"))

    members = members.select("bucket", "band", "id")
    at = stored(members.join(comps, "id"))
    sizes = stored(sized(at))
    crowded = sizes.where(F.col("left_over") > hot).select("bucket")
    if not crowded.isEmpty():
        few = bounded_broadcast(crowded)
        refined = by_prefix(at.join(few, "bucket").select("bucket", "band", "id"), texts)
        at = stored(at.join(few, "bucket", "left_anti").unionByName(refined.join(comps, "id")))
        sizes = sized(at)
    blocks = sizes.select("bucket", F.col("top.comp").alias("main"), F.ceil(F.col("left_over") / LEFT_BLOCK).cast("int").alias("lblocks"), F.ceil(F.col("n") / RIGHT_BLOCK).cast("int").alias("rblocks"))
    at = at.join(blocks, "bucket").withColumn("rest", F.col("comp") != F.col("main"))
    lblock, rblock = F.pmod(F.xxhash64("id"), F.col("lblocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("rblocks")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = ["bucket", "band", "id", "comp", "rest"]
    left = at.where("rest").select(*own, F.lit(True).alias("left"), lblock.alias("lblock"), all_of("rblocks").alias("rblock"))
    right = at.select(*own, F.lit(False).alias("left"), rblock.alias("rblock"), all_of("lblocks").alias("lblock"))
    rows = left.unionByName(right).join(texts, "id")
    return rows.repartition("bucket", "lblock", "rblock").sortWithinPartitions("bucket", "lblock", "rblock").mapInPandas(_block_links, "a long, b long")


def between(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Links (u, v) between components of the links (a, b) between ids."""
    at = comps.select(F.col("id").alias("a"), F.col("comp").alias("u")), comps.select(F.col("id").alias("b"), F.col("comp").alias("v"))
    return links.join(at[0], "a").join(at[1], "b").where("u <> v").select("u", "v").distinct()


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """u and the component that it comes to, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    yield pd.DataFrame({"u": list(parent), "to": [root(x) for x in list(parent)]}, dtype=np.int64)


def contract(comps: DataFrame, edges: DataFrame, tail: int = TAIL) -> DataFrame:
    """comps (id, comp) after joining the components of each link (u, v), by contracting edges to the smallest neighbours until at
    most `tail` of them are left, whatever the table's size. edges is read several times."""
    turn = 0
    while left := edges.limit(tail + 1).count():
        turn += 1
        if left <= tail:
            to = stored(edges.coalesce(1).mapInPandas(_joined, "u long, to long"))
            return stored(comps.join(to.withColumnRenamed("u", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # in turn the smallest id, which folds a pivot's star at once, and the smallest random rank, which no chain of ids can slow
        rank = lambda c, turn=turn: F.struct((F.col(c) if turn % 2 else F.xxhash64(c, F.lit(turn))).alias("h"), F.col(c).alias("x"))
        to = stored(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least(rank("u"), F.col("m"))["x"].alias("to")))
        comps = stored(comps.join(to.withColumnRenamed("u", "comp"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")))
        edges = stored(edges.join(to, "u").select(F.col("to").alias("p"), "v").join(to.select(F.col("u").alias("v"), "to"), "v").select(F.col("p").alias("u"), F.col("to").alias("v")).where("u <> v").distinct())
    return comps


def _hashed(docs: DataFrame) -> DataFrame:
    """docs with #row, a hash of all columns but maps, which have none."""
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.withColumn("#row", F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t]))


def grouped(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, row (a hash of the whole row), group (equal for rows of one class; null for texts without words), class_id of each
    row of docs (doc_id, text and others)."""
    docs = _hashed(docs)
    asked = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), F.col("#row").alias("row"), "text")
    signed = stored(asked.mapInPandas(_signed, "doc_id long, named boolean, row long, k1 long, k2 long, n long, bands array<long>"))
    one = F.min(F.struct((~F.col("named")).alias("anonymous"), "doc_id", "row", "bands")).alias("x")
    nodes = stored(signed.where("n > 0").groupBy("k1", "k2").agg(one).select("k1", "k2", F.xxhash64("k1", "k2").alias("id"), F.when(~F.col("x.anonymous"), F.col("x.doc_id")).alias("first"), "x.row", "x.bands"))
    entries = nodes.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = stored(entries.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("hi"), F.count("*").alias("n")).where("pivot < hi").select("bucket", "pivot", "n"))
    members = stored(split_join(entries, shared, ["bucket"]).drop("n"))
    wanted = stored(nodes.join(members.select("id").distinct(), "id").select("id", "row", "bands"))
    comps = wanted.select("id", F.col("id").alias("comp"))
    texts = stored(docs.select(F.col("#row").alias("row"), "text").join(bounded_broadcast(wanted.select("id", "row")), "row").dropDuplicates(["id"]).join(wanted.select("id", "bands"), "id").select("id", "text", "bands"))
    stars = stored(members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    comps = contract(comps, stored(verified(stars, texts.select("id", "text")).toDF("u", "v")))
    comps = contract(comps, stored(between(comps, across_components(members.where("id <> pivot"), comps, texts, hot))))
    joined = stored(nodes.select("k1", "k2", "id", "first").join(comps, "id", "left").select("k1", "k2", "first", F.coalesce("comp", "id").alias("group")))
    names = joined.groupBy("group").agg(F.min("first").alias("class_id"))
    named = stored(joined.join(names, "group").join(signed.where("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("n")), ["k1", "k2"]).select("k1", "k2", "n", "group", "class_id"))
    mine = F.when(F.col("named"), F.col("doc_id"))
    worded = split_join(signed.where("n > 0").select(mine.alias("doc_id"), "row", "k1", "k2"), named, ["k1", "k2"])
    wordless = signed.where("n = 0").select(mine.alias("doc_id"), "row", F.lit(None).cast("long").alias("group"), mine.alias("class_id"))
    return worded.select("doc_id", "row", "group", "class_id").unionByName(wordless)


def classes(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) of each row of docs (doc_id, text)."""
    return grouped(docs.select("doc_id", "text"), hot).select("doc_id", "class_id")


def firsts(docs: DataFrame) -> DataFrame:
    """One row of each class: that of the smallest doc_id (known ones first), then the smallest hash of the whole row; of rows
    that are equal in every column, one. Rows without words all stay."""
    at = stored(grouped(docs))
    best = at.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("x"))
    rows = best.select(F.col("x.row").alias("#row"))
    again = stored(at.where("group is not null").groupBy(F.col("row").alias("#row")).agg(F.count("*").alias("#n")).where("`#n` > 1").join(rows, "#row", "left_semi").select("#row"))
    wordless = at.where("group is null").select(F.col("row").alias("#row")).distinct()
    docs = _hashed(docs)
    kept = docs.join(bounded_broadcast(rows.unionByName(wordless)), "#row", "left_semi")
    once = kept.join(bounded_broadcast(again), "#row", "left_anti")
    return once.unionByName(kept.join(bounded_broadcast(again), "#row", "left_semi").dropDuplicates(["#row"])).drop("#row")
