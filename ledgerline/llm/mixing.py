"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree: domain, language, source. The token budget goes down the tree by weight. A node can give at most
its own tokens times `epochs`; what a node can't give goes to its siblings by their weights, and only if all of them
are full does the shortage reach their parent's siblings, since a parent is never given more than its children hold. At each node
the shares are exact water levels of integers, found by windows over siblings ordered by room for weight.

Each leaf takes the token-prefix of its seeded order: epoch after epoch, documents by md5(seed, epoch, doc_id). Whole
epochs are copies of all documents; of the last, partial epoch the prefix ends before the first document that would
exceed the budget. Documents are dealt into buckets by the leading digits of that md5, tokens are summed by bucket, and only the
bucket in which the budget ends is ordered row by row: no leaf is sorted in a task, however large.

A document's tokens are its words (runs of other than space and the characters from tab to carriage return); a document
without words counts as one token.

Defined cases: null texts have one token; null lang or source are leaves named "" of their own; repeated rows are documents of
their own, in an order that is fixed up to equal rows; a document without doc_id is placed by its text; an empty table gives no
rows. Other columns are kept, whatever their names, but for domain, tokens and copies, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = ("domain", "lang", "source")
#: Mean number of documents in a bucket of a leaf's order, for the largest leaf.
BUCKET = 4_000
#: Fixed values of the production mix. Weights of domains, languages and sources are positive integers.
DOMAINS, SEED, BUDGET_PERCENT, EPOCHS = 4, 17, 60, 3
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 1}


def tokens_of(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def domain_of(source: Column) -> Column:
    """The production mix's domain: the number in the source's name modulo DOMAINS."""
    return F.concat(F.lit("d"), (F.coalesce(F.try_to_number(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("999999999")), F.lit(0)).cast("int") % DOMAINS).cast("string"))


def production_weights() -> dict[str, Column]:
    """Weights of the nodes of each level, from the node's name."""
    number = F.coalesce(F.try_to_number(F.regexp_extract(F.col("domain"), "([0-9]{1,9})$", 1), F.lit("999999999")), F.lit(0)).cast("long")
    lang = F.lit(1)
    for name, weight in LANG_WEIGHTS.items():
        lang = F.when(F.col("lang") == name, weight).otherwise(lang)
    return {"domain": number + 1, "lang": lang.cast("long"), "source": F.lit(1).cast("long")}


def shares(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """nodes (with weight, room and budget, the parent's) with share: integers, at most room, that sum to the budget or less
    by under one for each sibling."""
    group = [F.col(c) for c in parents] or [F.lit(1)]
    order = Window.partitionBy(*group).orderBy(F.col("room") / F.col("weight"), *[F.col(c) for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({"left": F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0)), "weights": F.sum("weight").over(Window.partitionBy(*group)) - F.coalesce(F.sum("weight").over(before), F.lit(0))})
    # the first sibling whose room exceeds its part of what is left sets the level of all from it on
    open_ = F.col("room").cast("decimal(38,0)") * F.col("weights") > F.col("left").cast("decimal(38,0)") * F.col("weight")
    level = F.first(F.when(open_, F.struct("left", "weights")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return nodes.withColumn("level", level).withColumn("share", F.when(F.col("level").isNull(), F.col("room")).otherwise(F.expr("cast(cast(level.left as decimal(38,0)) * weight div level.weights as bigint)"))).drop("left", "weights", "level", "budget")


def budgets(leaves: DataFrame, total: int, weights: dict[str, Column], epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) with the token budget of each."""
    nodes = leaves.withColumn("room", F.col("tokens") * epochs)
    given: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        names, parents = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        rows = nodes.groupBy(*names).agg(F.sum("room").alias("room")).withColumn("weight", weights[level])
        rows = rows.withColumn("budget", F.lit(total)) if given is None else rows.join(given, parents)
        given = shares(rows, parents).select(*names, F.col("share").alias("budget"))
    return leaves.join(given, list(LEVELS))


def mix(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED, weights: dict[str, Column] | None = None, domain: Column | None = None) -> DataFrame:
    """Columns of docs, and domain, tokens, copies (how often the document is taken; documents not taken are left out)."""
    columns = [c for c in docs.columns if c not in ("domain", "tokens", "copies")]
    slim = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("#name"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), tokens_of(F.col("text")).alias("tokens"))
    slim = slim.withColumn("domain", domain if domain is not None else domain_of(F.col("source")))
    leaves = stored(slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    total = leaves.agg(F.sum("tokens").alias("t"), F.max("docs").alias("d")).first()
    amount, bits = (total["t"] or 0) * budget_percent // 100, max(0, ((total["d"] or 0) // BUCKET).bit_length())
    given = budgets(leaves, amount, weights or production_weights(), epochs)
    given = given.select(F.col("domain").alias("#domain"), F.col("lang").alias("#glang"), F.col("source").alias("#gsource"), F.expr("budget div tokens").alias("#whole"), F.expr("budget % tokens").alias("#rest"))
    named = lambda: F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("#name")
    work = docs.select(*[F.col(f"`{c}`") for c in columns], named()).withColumns({"#lang": F.coalesce("lang", F.lit("")), "#source": F.coalesce("source", F.lit("")), "tokens": tokens_of(F.col("text"))})
    work = work.withColumn("domain", domain if domain is not None else domain_of(F.col("#source")))

    def keyed(df: DataFrame) -> DataFrame:
        """df with leaf budgets, the key of the last epoch's order, and the bucket of its leading bits."""
        on = (F.col("domain") == F.col("#domain")) & (F.col("#lang") == F.col("#glang")) & (F.col("#source") == F.col("#gsource"))
        out = df.join(F.broadcast(given) if small else given, on).drop("#domain", "#glang", "#gsource")
        key = F.md5(F.concat_ws(":", F.lit(seed), F.col("#whole"), F.col("#name")).cast("binary"))
        return out.withColumn("#key", key).withColumn("#bucket", F.shiftright(F.conv(F.substring("#key", 1, 6), 16, 10).cast("int"), 24 - min(bits, 24)))

    small = leaves.limit(10_001).count() <= 10_000
    leaf = ["domain", "#lang", "#source"]
    slim = slim.withColumnsRenamed({"lang": "#lang", "source": "#source"})
    sums = keyed(slim).groupBy(*leaf, "#bucket").agg(F.sum("tokens").alias("t"), F.max("#rest").alias("rest"))
    sums = sums.withColumn("upto", F.sum("t").over(Window.partitionBy(*leaf).orderBy("#bucket")))
    edge = sums.where("upto > rest").groupBy(*leaf).agg(F.min(F.struct("#bucket", (F.col("upto") - F.col("t")).alias("before"))).alias("edge"))
    edge = stored(edge.select(*leaf, F.col("edge.#bucket").alias("#edge"), F.col("edge.before").alias("#before")))
    rows = keyed(work).join(F.broadcast(edge) if small else edge, leaf, "left")
    final = [*columns, "domain", "tokens"]
    inside = rows.where(F.col("#edge").isNull() | (F.col("#bucket") != F.col("#edge")))
    inside = inside.select(*[F.col(f"`{c}`") for c in final], (F.col("#whole") + (F.col("#bucket") < F.coalesce("#edge", F.lit(1 << 30))).cast("long")).alias("copies"))
    order = Window.partitionBy(*leaf).orderBy("#key", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    ending = rows.where(F.col("#bucket") == F.col("#edge")).withColumn("#upto", F.col("#before") + F.sum("tokens").over(order))
    ending = ending.select(*[F.col(f"`{c}`") for c in final], (F.col("#whole") + (F.col("#upto") <= F.col("#rest")).cast("long")).alias("copies"))
    return inside.unionByName(ending).where("copies > 0")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 1)::BIGINT AS tokens,
    'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT), 0) % 4)::VARCHAR AS domain FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
n1 AS (SELECT domain, 3 * sum(tokens)::BIGINT AS room, (substr(domain, 2)::BIGINT + 1) AS weight,
    (SELECT sum(tokens)::BIGINT FROM d) * 60 // 100 AS budget FROM leaves GROUP BY domain),
o1 AS (SELECT *, budget - coalesce(sum(room) OVER w, 0) AS rem, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS ws FROM n1
    WINDOW w AS (ORDER BY room / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s1 AS (SELECT *, last_value(CASE WHEN room * ws > rem * weight THEN NULL ELSE 1 END) OVER (ORDER BY room / weight, domain ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS x FROM o1),
l1 AS (SELECT domain, room, weight, (SELECT struct_pack(rem := s.rem, ws := s.ws) FROM s1 s WHERE s.x IS NULL ORDER BY s.room / s.weight, s.domain LIMIT 1) AS lv, x,
    room / weight AS pos, (SELECT min(struct_pack(p := s.room / s.weight, d := s.domain)) FROM s1 s WHERE s.x IS NULL) AS first_open FROM s1),
b1 AS (SELECT domain, (CASE WHEN first_open IS NULL OR struct_pack(p := pos, d := domain) < first_open THEN room ELSE lv.rem::HUGEINT * weight // lv.ws END)::BIGINT AS budget FROM l1),
n2 AS (SELECT domain, lang, 3 * sum(tokens)::BIGINT AS room, (CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END)::BIGINT AS weight, any_value(budget) AS budget
    FROM leaves JOIN b1 USING (domain) GROUP BY domain, lang),
o2 AS (SELECT *, budget - coalesce(sum(room) OVER w, 0) AS rem, sum(weight) OVER (PARTITION BY domain) - coalesce(sum(weight) OVER w, 0) AS ws FROM n2
    WINDOW w AS (PARTITION BY domain ORDER BY room / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f2 AS (SELECT domain, min(struct_pack(p := room / weight, d := lang, rem := rem, ws := ws)) AS f FROM o2 WHERE room::HUGEINT * ws > rem::HUGEINT * weight GROUP BY domain),
b2 AS (SELECT domain, lang, (CASE WHEN f IS NULL OR struct_pack(p := room / weight, d := lang) < struct_pack(p := f.p, d := f.d) THEN room ELSE f.rem::HUGEINT * weight // f.ws END)::BIGINT AS budget
    FROM o2 LEFT JOIN f2 USING (domain)),
n3 AS (SELECT domain, lang, source, tokens AS held, 3 * tokens AS room, 1::BIGINT AS weight, budget FROM leaves JOIN b2 USING (domain, lang)),
o3 AS (SELECT *, budget - coalesce(sum(room) OVER w, 0) AS rem, sum(weight) OVER (PARTITION BY domain, lang) - coalesce(sum(weight) OVER w, 0) AS ws FROM n3
    WINDOW w AS (PARTITION BY domain, lang ORDER BY room / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f3 AS (SELECT domain, lang, min(struct_pack(p := room / weight, d := source, rem := rem, ws := ws)) AS f FROM o3 WHERE room::HUGEINT * ws > rem::HUGEINT * weight GROUP BY domain, lang),
b3 AS (SELECT domain, lang, source, held, (CASE WHEN f IS NULL OR struct_pack(p := room / weight, d := source) < struct_pack(p := f.p, d := f.d) THEN room ELSE f.rem::HUGEINT * weight // f.ws END)::BIGINT AS budget
    FROM o3 LEFT JOIN f3 USING (domain, lang)),
k AS (SELECT d.*, budget // held AS whole, budget % held AS rest FROM d JOIN b3 USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || name), tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)
SELECT doc_id, domain, lang, source, tokens, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM c WHERE whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
