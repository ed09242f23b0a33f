"""Personal data spans: base patterns plus candidates that boosted trees accept. DataFrame functions only.

Base spans are fixed patterns with validity checks. Beside them, high-recall generators propose spans (anything around
an @ or its spellings, any run of digits with separators, any long run of letters and digits), which may overlap one another. Each
candidate gets up to twelve yes/no features of its format and of what stands around it, so that all candidates of a corpus fold
into at most 4,096 cells of counts for each generator; boosted trees are fitted on the driver from these cells.

Labels are weak and come from another view than the features: a candidate is positive if it overlaps a valid base span or a word
before it says what it is ("token", "phone", "mail"), negative if such a word says otherwise ("order", "isbn"), and open if there
is neither; the trees take open ones for negative. Features never read these words, nor the signs that go with them, so what the trees learn about formats holds where no
word stands. A fifth of the documents (crc32 of doc_id as text, or of the text where there is none, divisible by 5) is held out:
the score from which on a generator's candidates are accepted is the lowest at which, of the held-out candidates, `PRECISION` or more
of the positive and negative ones are positive, and `SHARE` or more of all. Accepted candidates that overlap
no base span are added, the higher score first where two overlap; their kinds are the base ones and `secret`.

Scoring a document reads only its own row; the sole shuffle is the aggregation into cells, summed before it. Each pattern runs once
for the matches and once for the pieces between, from which positions come, in code points.

Possessive quantifiers and the look-behinds keep matching linear on long runs and the matches the same: the
character after each such run is never part of its class, so giving characters back can't help.

Defined cases: null and empty texts have no spans; repeated rows and null doc_ids are handled each by itself; an empty
table, or one without held-out positives, adds nothing. Other columns are kept as they are, but for the columns that are added.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in Java's syntax.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What an added span can be.
ADDED = (*KINDS, "secret")
#: Generators of candidates.
GENERATORS = {
    "at": r"(?:\G|(?<![^\s@<>,;]))[^\s@<>,;]{1,64}+(?:@|\x20?[\[({]\x20?at\x20?[\])}]\x20?)[^\s@<>,;]{1,255}(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?[A-Za-z0-9-]{1,63})*",
    "digits": r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){7,}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,512}+={0,2}",
}
#: What a word just before a candidate says about it.
SAYS = {
    "at": r"(?i)\b(?:e-?mail|mailto|contact|kontakt|correo|courriel|write to|reach)s?\W*$",
    "digits": r"(?i)\b(?:phone|tel|telefon|call|fax|mobile|cell|card|visa|mastercard|konto|account|iban|tarjeta|carte)(?: (?:no|nr|number))?\W*$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|credential)s?[\x22']?\s*[:=]?\s*[\x22']?$",
}
DENIES = {
    "at": r"(?i)\b(?:follow|handle|user)\W*$",
    "digits": r"(?i)\b(?:order|invoice|isbn|issn|version|page|serial|date|price|article|item|sku|part)(?: (?:no|nr|number))?\W*$",
    "secret": r"(?i)(?:version|commit|sha-?(?:1|256)?|md5|checksum|digest|etag|file|path|url)[\x22']?\s*[:=]?\s*[\x22']?$",
}
TREES, RATE, PRECISION, SHARE = 24, 0.3, 0.98, 0.5
CELLS = 1 << 12
#: Characters before a candidate that are looked at, up to the candidate before it; matches placed at a time.
AROUND, CHUNK = 32, 256
FOUND = "array<struct<kind:int,start:int,end:int>>"
SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, also if `use` reads it within functions over arrays."""
    return F.get(F.transform(F.array(value), use), 0)


def mask(spans: Column, inner: int = 0) -> Column:
    """Bytes, 1 where a span (sorted, none overlapping another) covers a position, its first `inner` ones left out; 0 between; ends with the last span.

    Bytes are read at any place without walking through what is before."""
    def own(spans: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), lambda s: s["end"]))
        return F.zip_with(spans, before, lambda s, b: F.concat(F.repeat(F.lit("0"), s["start"] - b + inner), F.repeat(F.lit("1"), s["end"] - s["start"] - inner)))

    return F.when(F.size(spans) > 0, F.array_join(once(spans, own), "").cast("binary")).otherwise(F.lit(b""))


def covered(mask: Column, start: Column, end: Column) -> Column:
    return F.contains(F.substring(mask, start + 1, end - start), F.lit(b"1"))


def clusters(spans: Column, families: list[Column]) -> Column:
    """Arrays of the spans (sorted by start) that overlap, directly or through others. families: the same spans in arrays without overlaps."""
    def cut(masks: Column) -> Column:
        inside = lambda s: F.exists(masks, lambda m: covered(m, s["start"], s["start"] + 1))
        starts = lambda spans: F.filter(F.sequence(F.lit(1), F.size(spans)), lambda i: ~inside(F.element_at(spans, i)))
        groups = lambda spans, at: F.zip_with(at, F.concat(F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), F.array(F.size(spans) + 1)), lambda i, j: F.slice(spans, i, j - i))
        return once(spans, lambda spans: once(starts(spans), lambda at: groups(spans, at)))

    return F.when(F.size(spans) > 0, once(F.array(*[mask(x, 1) for x in families]), cut)).otherwise(F.slice(F.array(spans), 1, 0))


def with_matches(docs: DataFrame, text: Column, patterns: dict[str, str]) -> DataFrame:
    """docs with an array for each pattern: (start, end, value, before, after) of its leftmost non-overlapping matches, in code points."""
    found = {f"#hits_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()}
    docs = docs.withColumns(found)
    docs = docs.withColumns({f"#gaps_{k}": F.when(F.size(f"#hits_{k}") > 0, F.split(text, p, -1)) for k, p in patterns.items()})
    docs = docs.withColumns({k: _placed(F.col(f"`#hits_{k}`"), F.col(f"`#gaps_{k}`")) for k in patterns})
    return docs.drop(*[f"#{x}_{k}" for x in ("hits", "gaps") for k in patterns])


def _placed(hits: Column, gaps: Column) -> Column:
    """Positions by running sums, CHUNK matches at a time, so that the work stays in proportion to the matches."""
    n = F.size(hits)
    rows = F.arrays_zip(F.slice(gaps, 1, n).alias("gap"), hits.alias("hit"), F.slice(gaps, 2, n).alias("next"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"), F.right(x["gap"], F.lit(AROUND)).alias("before"), F.left(x["next"], F.lit(2)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
    chunks = once(rows, lambda rows: F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda i: F.aggregate(F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)), start, step)))
    none = F.array().cast(f"array<struct<base:int,out:{SPAN}>>")
    along = lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("base"), c["out"].alias("out")))).alias("out"))
    based = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), none.alias("out")), along, lambda acc: acc["out"])
    moved = lambda c: F.transform(c["out"], lambda s: F.struct((s["start"] + c["base"]).alias("start"), (s["end"] + c["base"]).alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after")))
    return F.when(n > 0, F.flatten(F.transform(based, moved))).otherwise(F.array().cast(SPAN))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the value's digits pass Luhn's check."""
    d = F.filter(F.split(F.reverse(digits_of(value)), ""), lambda c: c != "")
    doubled = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def small_parts(value: Column) -> Column:
    """Whether all parts between dots are at most 255."""
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.substring(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), -3, 3) <= "255"))


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits_of(value))
    if kind == "ip":
        return small_parts(value)
    if kind == "card":
        return n.between(13, 19) & luhn(value)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def features(g: str, s: Column) -> list[Column]:
    """Up to twelve conditions on a candidate's format and on the signs around it."""
    value, n, size = s["value"], F.length(digits_of(s["value"])), F.length(s["value"])
    if g == "at":
        return [
            value.contains("@"),
            value.rlike(r"@[^@]*[A-Za-z0-9]\.[A-Za-z]{2,}"),
            value.rlike(r"[\[({]\x20?at\x20?[\])}]"),
            value.rlike(r"[\[({]\x20?dot\x20?[\])}]"),
            value.rlike(r"\.[A-Za-z]{2,10}\W*$"),
            value.rlike(r"^[A-Za-z0-9]"),
            value.rlike(r"[^\x00-\x7f]"),
            value.rlike(r"[0-9]"),
            size > 40,
            value.rlike(r"@.*@"),
            s["before"].rlike(r"<$"),
            value.rlike(r"[!?*|\\]"),
        ]
    if g == "digits":
        return [
            n >= 9,
            n >= 13,
            n <= 15,
            n <= 19,
            value.rlike(r"^\(?\+"),
            value.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"),
            value.rlike(r"[()/ -]"),
            luhn(value),
            value.rlike(r"^[^./]*$"),
            value.rlike(r"^\(?0"),
            value.rlike(r"^\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,4}){2,}$"),
            size > 24,
        ]
    return [
        value.rlike(r"^[0-9a-fA-F]+$"),
        value.rlike(r"[A-Za-z]"),
        size >= 20,
        size >= 32,
        value.rlike(r"[a-z]") & value.rlike(r"[A-Z]"),
        s["before"].rlike(r"[\x22'`]$") & s["after"].rlike(r"^[\x22'`]"),
        size > 64,
        value.rlike(r"[_/+-]"),
        n * 5 >= size,
        value.rlike(r"=$"),
        size.isin(32, 40, 64),
        value.rlike(r"^[0-9_/+-]*$"),
    ]


def held_out(doc_id: Column, text: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), text).cast("binary")) % 5 == 0


def proposed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others) with the arrays spans_<kind>, candidates_<generator> (start, end, cell, overlaps, label) and held added."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = with_matches(docs.withColumn("held", held_out(F.col("doc_id"), text)), text, {f"spans_{k}": PATTERNS[k] for k in KINDS} | {f"candidates_{g}": p for g, p in GENERATORS.items()})
    right = {k: (lambda kind: lambda s: valid(kind, s["value"]))(k) for k in KINDS}
    docs = docs.withColumns({f"spans_{k}": F.filter(f"spans_{k}", right[k]) for k in KINDS})
    masks = F.array(*[mask(F.col(f"spans_{k}")) for k in KINDS])

    def described(g: str) -> Column:
        def one(s: Column, masks: Column) -> Column:
            cell = sum((f.cast("int") * (1 << i) for i, f in enumerate(features(g, s))), F.lit(0))
            overlaps = F.exists(masks, lambda m: covered(m, s["start"], s["end"]))
            denied = s["before"].rlike(DENIES[g])
            label = F.when(overlaps | (s["before"].rlike(SAYS[g]) & ~denied), 1).when(denied, -1).otherwise(0)
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), cell.alias("cell"), overlaps.alias("overlaps"), label.alias("label"))

        return once(masks, lambda masks: F.transform(F.col(f"candidates_{g}"), lambda s: one(s, masks)))

    return docs.withColumns({f"candidates_{g}": described(g) for g in GENERATORS})


def boosted(cells: dict[int, tuple[int, int]], trees: int = TREES, rate: float = RATE) -> list[tuple[int, int, int, list[float]]]:
    """Trees of depth two (first test, tests where it holds or not, four leaf values) by Newton boosting of the logistic loss.

    cells: the numbers of negatives and positives of each combination of features."""
    score = dict.fromkeys(cells, 0.0)
    out = []
    for _ in range(trees):
        grads = {}
        for c, (neg, pos) in cells.items():
            p = 1 / (1 + math.exp(-score[c]))
            grads[c] = (pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p))

        def gain(group: list[int], bit: int, grads: dict = grads) -> tuple[float, list[float]]:
            total, values = 0.0, []
            for side in (0, 1):
                g = sum(grads[c][0] for c in group if c >> bit & 1 == side)
                h = sum(grads[c][1] for c in group if c >> bit & 1 == side) + 1.0
                total += g * g / h
                values.append(rate * max(-4.0, min(4.0, g / h)))
            return total, values

        best = max(range(12), key=lambda b: gain(list(cells), b)[0])
        tests, leaves = [], []
        for side in (0, 1):
            group = [c for c in cells if c >> best & 1 == side]
            second = max(range(12), key=lambda b: gain(group, b)[0])
            tests.append(second)
            leaves += gain(group, second)[1]
        out.append((best, tests[0], tests[1], leaves))
        for c in cells:
            side = c >> best & 1
            score[c] += leaves[2 * side + (c >> tests[side] & 1)]
    return out


def tree_score(cell: int, trees: list[tuple[int, int, int, list[float]]]) -> float:
    return sum(t[3][2 * (cell >> t[0] & 1) + (cell >> t[1 + (cell >> t[0] & 1)] & 1)] for t in trees)


def learn(candidates: DataFrame) -> dict[str, dict[int, float]]:
    """For each generator the accepted cells and their scores. candidates: what proposed() adds."""
    rows = None
    for g in GENERATORS:
        part = candidates.select(F.lit(g).alias("g"), "held", F.explode(f"candidates_{g}").alias("c")).select("g", "held", "c.cell", "c.label")
        rows = part if rows is None else rows.unionByName(part)
    sums = [F.count_if(F.col("label") == v).alias(n) for v, n in ((-1, "neg"), (0, "open"), (1, "pos"))]
    counts = rows.groupBy("g", "held", "cell").agg(*sums).collect()  # at most 2 x 3 x 4,096 rows
    return {g: accepted([(r["held"], r["cell"], r["neg"], r["open"], r["pos"]) for r in counts if r["g"] == g]) for g in GENERATORS}


def accepted(counts: list[tuple[bool, int, int, int, int]]) -> dict[int, float]:
    """Cells whose candidates are accepted, and their scores. counts: held out, cell, negatives, open ones, positives."""
    cells = {c: (neg + open_, pos) for held, c, neg, open_, pos in counts if not held}
    apart = {c: (neg, open_, pos) for held, c, neg, open_, pos in counts if held}
    if not cells or not apart:
        return {}
    trees = boosted(cells)
    scores = {c: tree_score(c, trees) for c in {*cells, *apart}}
    least, neg, open_, pos = math.inf, 0, 0, 0
    for s in sorted({scores[c] for c in apart}, reverse=True):
        for c in apart:
            if scores[c] == s:
                neg, open_, pos = neg + apart[c][0], open_ + apart[c][1], pos + apart[c][2]
        if pos and pos >= PRECISION * (pos + neg) and pos >= SHARE * (pos + neg + open_):
            least = s
    return {c: x for c, x in scores.items() if x >= least and x > 0}


def kind_of(g: str, cell: Column) -> Column:
    """The kind that a candidate is added as."""
    if g == "at":
        return F.lit("email")
    if g == "secret":
        return F.lit("secret")
    bit = lambda i: cell.bitwiseAND(1 << i) > 0
    return F.when(bit(5), "ip").when(bit(1) & bit(7), "card").otherwise("phone")


def added(docs: DataFrame, model: dict[str, dict[int, float]]) -> Column:
    """Array of (kind number, start, end) of the accepted candidates, none overlapping another or a base span.

    Candidates meet only those that they overlap with, directly or through others."""
    def part(g: str, accepted: dict[int, float]) -> Column:
        scores = F.from_json(F.lit(json.dumps([accepted.get(c) for c in range(CELLS)])), "array<double>")
        number = lambda c: F.array_position(F.array(*[F.lit(k) for k in ADDED]), kind_of(g, c)).cast("int") - 1
        of = lambda s, scores: F.struct(s["start"].alias("start"), s["end"].alias("end"), (-F.get(scores, s["cell"])).alias("worse"), number(s["cell"]).alias("kind"))
        kept = F.filter(F.col(f"candidates_{g}"), lambda s: ~s["overlaps"] & s["cell"].isin([*accepted]))
        return once(scores, lambda scores: F.transform(kept, lambda s: of(s, scores)))

    parts = [part(g, accepted) for g, accepted in model.items() if accepted]
    if not parts:
        return F.array().cast(FOUND)
    free = lambda acc, s: ~F.exists(acc, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    one = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    better = lambda group: F.array_sort(F.transform(group, lambda s: F.struct(s["worse"].alias("worse"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    greedy = lambda group: F.aggregate(better(group), F.array().cast(FOUND), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(one(s)))).otherwise(acc))
    chosen = lambda group: F.when(F.size(group) == 1, F.transform(group, one)).otherwise(greedy(group))

    def choose(parts: Column) -> Column:
        return F.flatten(F.transform(clusters(F.array_sort(F.flatten(parts)), [F.get(parts, i) for i in range(n)]), chosen))

    n = len(parts)
    return once(F.array(*parts), choose)


def base(docs: DataFrame) -> Column:
    """Array of (kind number, start, end) of the base spans, by kind, then start."""
    numbered = lambda i: lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.concat(*[F.transform(F.col(f"spans_{k}"), numbered(i)) for i, k in enumerate(KINDS)])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in ADDED])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind number, start, end; spans has all), and the numbers of base spans by kind."""
    found = stored(proposed(docs.select(F.col("doc_id"), "text")).drop("text"))
    model = learn(found)
    counts = [F.size(f"spans_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, base(found).alias("base"), F.array_sort(F.concat(base(found), added(found, model))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, others) with [kind] in place of all spans in text, and n_chars, if there, set to the new length."""
    own = [c for c in docs.columns if c != "text"]
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.col("doc_id"), "text")
    found = stored(proposed(work))
    model = learn(found)
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    numbered = lambda i: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(i).alias("kind"))
    families = F.array(*[F.transform(f"spans_{k}", numbered(i)) for i, k in enumerate(KINDS)], F.array_sort(F.transform(added(found, model), place)))
    first = lambda group: F.array_min(F.transform(group, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    merged = lambda group: once(first(group), lambda x: F.struct(x["start"].alias("start"), F.array_max(F.transform(group, lambda s: s["end"])).alias("end"), x["kind"].alias("kind")))
    covers = once(families, lambda x: F.transform(clusters(F.array_sort(F.flatten(x)), [F.get(x, i) for i in range(len(KINDS) + 1)]), merged))
    found = found.withColumn("#covers", covers)
    names = F.array(*[F.lit(f"[{k}]") for k in ADDED])

    def replaced(points: Column) -> Column:
        """points: the text with four bytes a character."""
        cut = lambda a, b: F.decode(F.substring(points, a * 4 + 1, (b - a) * 4), "UTF-32")
        before = F.concat(F.array(F.lit(0)), F.transform("#covers", lambda s: s["end"]))
        gaps = F.zip_with("#covers", F.slice(before, 1, F.size("#covers")), lambda s, b: F.concat(cut(b, s["start"]), F.element_at(names, s["kind"] + 1)))
        last = F.element_at("#covers", -1)["end"]
        return F.concat(F.array_join(gaps, ""), cut(last, F.length("text")))

    text = once(F.encode("text", "UTF-32"), replaced)
    out = found.withColumn("text", F.when(F.size("#covers") > 0, text).otherwise(F.col("text")))
    cols = {c: F.col("own").getField(c) for c in own} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[cols[c].alias(c) for c in docs.columns])
