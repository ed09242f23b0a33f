"""Chunks and hybrid retrieval (K family), slots of questions (L family). Batch joins over many questions at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored


def paragraphs(docs: DataFrame) -> DataFrame:
    """K-4: runs of lines between blank ones and headings. A document's lines stay in its row."""
    parts = F.filter(F.transform(F.split(T.clean_page(F.col("text")), r"\n\s*\n|\n(?=#)"), lambda p: F.trim(F.regexp_replace(p, r"\s*\n\s*", " "))), lambda p: p != "")
    return docs.select("doc_id", F.posexplode(parts).alias("place", "paragraph"))


def informative(rows: DataFrame, column: str, least: int = 18) -> DataFrame:
    """K-7, K-13: without short paragraphs and those that are mostly digits."""
    return rows.where((F.length(column) >= least) & (F.regexp_count(F.col(column), F.lit(r"[0-9]")) <= 0.18 * F.length(column)))


def chunks(docs: DataFrame, size: int = 900, overlap: int = 150) -> DataFrame:
    """K-8 to K-10: chunk_id, doc_id, chunk, text: windows of a document's informative paragraphs, in order."""
    parts = informative(paragraphs(docs), "paragraph")
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "paragraph"))), lambda x: x["paragraph"]), "\n").alias("body"))
    rows = whole.select("doc_id", F.posexplode(T.windows(F.col("body"), size, overlap)).alias("chunk", "text"))
    return rows.withColumn("chunk_id", F.concat_ws("-", F.col("doc_id").cast("string"), F.col("chunk").cast("string")))


def fallback_chunks(docs: DataFrame, made: DataFrame) -> DataFrame:
    """K-12: a chunk of metadata for documents that have none."""
    return docs.join(made, "doc_id", "left_anti").select("doc_id", F.concat_ws("；", "source", "lang").alias("text"))


def normalized(vector: Column) -> Column:
    """K-15: unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each batch: its ids and its vectors as one matrix; shorter vectors end in zeros."""
    for pdf in batches:
        if len(pdf):
            width = max(1, *map(len, pdf["embedding"]))
            rows = np.zeros((len(pdf), width))
            for i, x in enumerate(pdf["embedding"]):
                rows[i, : len(x)] = x
            yield pd.DataFrame([{"n": len(pdf), "ids": pdf["vec_id"].to_numpy(np.int64).tobytes(), "rows": rows.tobytes(), "block": pdf["block"].iloc[0] if "block" in pdf else 0}])


#: Queries that a task scores at once against the vectors of a cell.
PART = 64


def _matrix(packed: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of packed rows; shorter vectors end in zeros."""
    parts = [np.frombuffer(r.rows).reshape(r.n, -1) for r in packed.itertuples()]
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.frombuffer(x, np.int64) for x in packed["ids"]]), np.concatenate([p if p.shape[1] == width else np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def _candidates(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that may be among the k largest of their row once they are rounded to six digits; of equal ones in a row only those with the k
    smallest ids, so copies of a vector don't swell what leaves a cell. -inf takes no part.

    The k-th largest of the maxima of several groups of columns is no larger than the k-th largest score."""
    n, groups = score.shape[1], min(score.shape[1], 8 * k)
    least = np.full(len(score), -np.inf)
    if n > k:
        tops = np.fmax.reduce(score[:, : n // groups * groups].reshape(len(score), -1, groups), axis=1)
        least = np.partition(tops, -k, axis=1)[:, -k]
    i, j = np.nonzero(score >= np.maximum(least - 1e-6, np.finfo(float).min)[:, None])  # rounding may tie what is this near
    s = score[i, j]
    order = np.lexsort((ids[j], -s, i))
    i, j, s = i[order], j[order], s[order]
    at = np.arange(len(i))
    first, last = np.searchsorted(i, i), np.searchsorted(i, i, "right") - 1
    kth = s[np.minimum(first + k - 1, last)] if len(i) else s
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1])
    copies = at - np.maximum.accumulate(np.where(new, at, 0))
    kept = (s >= kth - 1e-6) & (copies < k)
    return i[kept], j[kept]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 4_000, stripes: int | None = None, stripe: int = 20_000) -> DataFrame:
    """K-16: the k largest inner products of each query with all vectors but its own: query_id, the columns of vectors but the
    embedding, score, rank.

    Blocks of about `block` queries meet stripes of about `stripe` vectors, a cell at a time, as products of matrices (`stripes` gives their number instead), so a task's memory doesn't grow with
    the tables; about k rows a query and cell go on to the last rank, also if many vectors are equal. Scores are rounded to six digits, ties go to the smaller id; null vectors take no part."""
    known = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()
    slim = lambda df: df.where(known).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("embedding"))
    q, c = slim(queries), slim(vectors)
    blocks, stripes = max(1, -(-q.count() // block)), stripes or max(1, -(-c.count() // stripe))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    packed = "n int, ids binary, rows binary, block int"
    asked = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(lambda pdf: pd.concat(_packed(iter([pdf]))), packed)
    asked = asked.select("block", "n", "ids", "rows", every(stripes).alias("stripe"))
    met = c.mapInPandas(_packed, packed).select("n", "ids", "rows", F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int").alias("stripe"), every(blocks).alias("block"))

    def best(asked: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(asked) and len(met):
            (q_ids, a), (ids, c) = _matrix(asked), _matrix(met)
            width = min(a.shape[1], c.shape[1])  # what lies beyond meets zeros
            order = np.argsort(ids)
            first, last = (np.searchsorted(ids, q_ids, side, order) for side in ("left", "right"))
            for at in range(0, len(q_ids), PART):
                some = q_ids[at : at + PART]
                score = a[at : at + PART, :width] @ c[:, :width].T
                for own in np.nonzero((first < last)[at : at + PART])[0]:
                    score[own, order[first[at + own] : last[at + own]]] = -np.inf
                i, j = _candidates(score, ids, k)
                out.append(pd.DataFrame({"query_id": some[i], "vec_id": ids[j], "score": score[i, j]}))
        return pd.concat(out)

    cells = asked.groupBy("block", "stripe").cogroup(met.groupBy("block", "stripe"))
    found = cells.applyInPandas(best, "query_id long, vec_id long, score double").withColumn("score", F.round("score", 6) + F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    hits = found.withColumn("rank", rank).where(F.col("rank") <= k)
    others = [c for c in vectors.columns if c not in ("vec_id", "embedding")]
    return hits.join(vectors.select("vec_id", *others), "vec_id").select("query_id", "vec_id", *others, "score", "rank")


def scoped(hits: DataFrame, wanted: Column, company: Column, topic: Column) -> DataFrame:
    """K-17: hits in scope, 0.05 more for a company hit and 0.03 more for a topic hit; filtered after the over-fetch."""
    return hits.where(wanted).withColumn("score", F.round(F.col("score") + F.when(company, 0.05).otherwise(0.0) + F.when(topic, 0.03).otherwise(0.0), 6))


def pieces(x: Column, lengths: list[int]) -> Column:
    """Distinct substrings of the given lengths."""
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1)))
    of_length = lambda n: F.transform(starts(n), lambda i: F.substring(x, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*map(of_length, lengths))))


#: What each kind of match adds, and words of questions about an industry.
MATCHES = {"company": 3.0, "topic": 2.0, "token": 0.2}
INDUSTRY_WORDS = ("行业", "板块", "医保目录", "集采")


#: A needle that more reports hold than this one makes no pairs of question and report.
OFTEN = 200


def metadata_scores(questions: DataFrame, reports: DataFrame, k: int) -> DataFrame:
    """K-18: the k best reports of each question by what their title, company and organization hold: +3 a company, +2 a topic, +0.2 a word of
    the question (of two characters or more), -2.5 for a stock report without any of the companies asked for, +1 for an industry report if the
    question is about an industry; only scores over 0, ties to the smaller report_id.

    questions: question_id, text, companies, topics. reports: report_id, kind (stock or industry), title, company, organization.
    Both meet on pieces of the lengths that are asked for, in an equi-join. Needles that over OFTEN reports hold make no pairs: reports of one kind that hold the same ones
    of them tie but for rarer needles, which only add, so the first k of each such group are enough, and questions that ask for the same ones meet the groups
    together. Reports that only the industry point speaks for tie, too."""
    none = F.array().cast("array<string>")
    wanted = lambda c, part: F.transform(F.coalesce(c, none), lambda x: F.struct(F.lit(part).alias("part"), x.alias("needle")))
    words = F.filter(F.split("text", r"\s+"), lambda t: F.length(t) >= 2)
    rows = F.concat(wanted(F.col("companies"), "company"), wanted(F.col("topics"), "topic"), wanted(words, "token"))
    asked = questions.select("question_id", F.explode(rows).alias("x")).select("question_id", "x.*").where("needle <> ''").groupBy("question_id", "part", "needle").agg(F.count("*").alias("times"))
    lengths = [r[0] for r in asked.select(F.length("needle")).distinct().collect()] or [1]
    held = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("title", "company", "organization")])
    places = reports.select("report_id", F.explode(pieces(held, lengths)).alias("needle")).join(asked.select("needle").distinct(), "needle", "left_semi")
    places = stored(places)
    common = places.groupBy("needle").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN).select("needle")
    worth = lambda part, times: F.coalesce(*[F.when(part == p, F.lit(x)) for p, x in MATCHES.items()]) * times
    points = worth(F.col("part"), F.col("times"))
    met = asked.join(places.join(common, "needle", "left_anti"), "needle").select("question_id", "report_id", points.alias("points"), (F.col("part") == "company").alias("own"))
    held = places.join(common, "needle").groupBy("report_id").agg(F.sort_array(F.collect_list("needle")).alias("held"))
    wants = asked.join(common, "needle").groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("needle", "part", "times"))).alias("wants"))
    own = F.row_number().over(Window.partitionBy("kind", "held").orderBy("report_id"))
    group = held.join(reports.select("report_id", "kind"), "report_id").withColumn("own", own).where(F.col("own") <= k).groupBy("kind", "held").agg(F.collect_list("report_id").alias("ids"))
    pairs = wants.select("wants").distinct().withColumn("needle", F.explode("wants.needle")).join(group.withColumn("needle", F.explode("held")), "needle").select("wants", "ids").distinct()
    first_of = wants.join(pairs, "wants").select("question_id", F.explode("ids").alias("report_id"), F.lit(0.0).alias("points"), F.lit(False).alias("own"))
    facts = questions.select("question_id", (F.size(F.coalesce("companies", none)) > 0).alias("named"), F.coalesce(reduce(lambda a, b: a | b, [F.col("text").contains(w) for w in INDUSTRY_WORDS]), F.lit(False)).alias("wide"))
    first = reports.where("kind = 'industry'").orderBy("report_id").limit(k).select("report_id", "kind")
    spare = facts.where("wide").withColumn("kind", F.lit("industry")).join(F.broadcast(first), "kind").select("question_id", "report_id", F.lit(0.0).alias("points"), F.lit(False).alias("own"))
    found = met.unionByName(spare).unionByName(first_of).groupBy("question_id", "report_id").agg(F.sum("points").alias("points"), F.max("own").alias("own"))
    found = found.join(wants, "question_id", "left").join(held, "report_id", "left")
    shared = F.filter(F.coalesce("wants", F.array().cast("array<struct<needle:string,part:string,times:bigint>>")), lambda w: F.coalesce(F.array_contains("held", w["needle"]), F.lit(False)))
    more = F.aggregate(shared, F.lit(0.0), lambda acc, w: acc + worth(w["part"], w["times"]))
    found = found.select("question_id", "report_id", (F.col("points") + more).alias("points"), (F.col("own") | F.exists(shared, lambda w: w["part"] == "company")).alias("own"))
    found = found.join(facts, "question_id").join(reports.select("report_id", "kind"), "report_id")
    stock, industry = F.col("kind") == "stock", F.col("kind") == "industry"
    score = F.col("points") - F.when(stock & F.col("named") & ~F.col("own"), 2.5).otherwise(0.0) + F.when(industry & F.col("wide"), 1.0).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "report_id"))
    return found.withColumn("score", F.round(score, 6)).where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k).select("question_id", "report_id", "score", "rank")


def fused(metadata: DataFrame, vector: DataFrame) -> DataFrame:
    """K-21: both scores of a hit and their sum."""
    m, v = metadata.withColumnRenamed("score", "metadata"), vector.withColumnRenamed("score", "vector")
    out = m.join(v, ["query_id", "hit"], "full_outer")
    return out.select("query_id", "hit", F.coalesce("metadata", F.lit(0.0)).alias("metadata"), F.coalesce("vector", F.lit(0.0)).alias("vector")).withColumn("score", F.round(F.col("metadata") + F.col("vector"), 6))


def balanced(hits: DataFrame, kind: str, k: int) -> DataFrame:
    """K-22: kinds take turns; the second kind fills at most half; the rest by score."""
    own = F.row_number().over(Window.partitionBy("query_id", kind).orderBy(F.desc("score"), "vec_id"))
    turn = hits.withColumn("own", own).withColumn("late", (F.col(kind) == 1) & (F.col("own") > max(1, k // 2)))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("late", "own", kind, F.desc("score"), "vec_id"))
    return turn.withColumn("place", order).where(F.col("place") <= k).drop("own", "late")


def source_counts(hits: DataFrame, kind: str) -> DataFrame:
    """E-13"""
    return hits.groupBy(kind).agg(F.count("*").alias("hits"))


def companies(questions: DataFrame, names: DataFrame) -> DataFrame:
    """L-1: codes of the names (stock_code, stock_abbr) that a question's text holds anywhere, of whatever form.

    A text meets names by its pieces of each length that names have (a handful of lengths), in an equi-join."""
    names = names.where("length(stock_abbr) > 0").select("stock_code", "stock_abbr").distinct()
    lengths = [r[0] for r in names.select(F.length("stock_abbr")).distinct().collect()]  # as many rows as names have lengths
    if not lengths:
        lengths = [1]
    found = questions.select("question_id", F.explode(pieces(F.col("text"), lengths)).alias("stock_abbr")).join(names, "stock_abbr")
    return found.groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_set("stock_code")), ",").alias("companies"))


#: Events that a question may ask for, and what evidence of each must hold (one word of each group).
EVENTS = (
    (("资产重组",), (("资产重组", "重大资产重组", "控股股东变更", "控制权变更", "股权转让"),)),
    (("商誉减值风险",), (("商誉",), ("减值",))),
    (("应收账款回收风险",), (("应收账款",), ("回收风险", "回款风险", "回收不及预期"))),
    (("FDA", "认证"), (("FDA",), ("认证",))),
    (("集采",), (("集采", "中标"),)),
    (("业绩预告",), (("业绩预告",),)),
)


def fits_event(question: Column, text: Column) -> Column:
    """Whether a text holds what the first event in the question asks of it; true without an event."""
    has = lambda c, words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    out = F.lit(True)
    for asked, groups in reversed(EVENTS):
        out = F.when(has(question, asked), reduce(lambda a, b: a & b, [has(text, g) for g in groups])).otherwise(out)
    return out


def evidence_companies(questions: DataFrame, evidence: DataFrame, names: DataFrame) -> DataFrame:
    """K-29: companies of the stock reports that fit a question's event, in the order of the evidence, each once.

    questions: question_id, text. evidence: question_id, place, source_type, company, title, snippet. names: stock_abbr."""
    fitting = evidence.where("source_type = 'stock'").join(questions.select("question_id", F.col("text").alias("question")), "question_id")
    fitting = fitting.where(fits_event(F.col("question"), F.concat_ws("\n", "title", "snippet")))
    key = lambda c: F.lower(F.regexp_replace(c, r"[\s()（）]|股份有限公司$|有限公司$", ""))
    known = names.select(F.col("stock_abbr").alias("name"), key(F.col("stock_abbr")).alias("key")).groupBy("key").agg(F.min("name").alias("name"))
    found = fitting.withColumn("key", key(F.col("company"))).join(known, "key").groupBy("question_id", "name").agg(F.min("place").alias("place"))
    return found.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("companies"))


#: What may follow a year and the period that it makes; words before a threshold; units in 10k; numbers of the best.
PERIOD_TAILS = {"": "FY", "全年": "FY", "年度": "FY", "前三季度": "Q3", "第三季度": "Q3", "第二季度": "Q2", "第一季度": "Q1", "半年度": "H1", "上半年": "H1"}
COMPARISONS = ("超过", "高于", "低于", "不少于")  # also within 不超过, 不高于, 不低于
AMOUNTS = {"亿": 10_000.0, "元": 0.0001}
BEST_OF = {"前十": 10, "前五": 5, "前三": 3, "top10": 10, "top5": 5, "top3": 3}
RANKING, FILTERING = ("排名", "前五", "前三", "前十", "最高", "最低"), ("哪些", "筛选", "超过", "低于", "为负", "为正")


def periods(x: Column, this_year: int | None = None) -> Column:
    """L-4: all periods that a text names, each once: a year with or without its part, ranges of third quarters (after the rest), and, if this
    year is given, the last one. Parts that no report covers (fourth quarters, 三季度 alone) make no period."""
    found = F.regexp_extract_all(x, F.lit("[0-9]{4}年(?:前?三季度|第[一二三四]季度|半年度|上半年|全年|年度)?"), F.lit(0))
    tails = F.create_map(*[F.lit(v) for pair in PERIOD_TAILS.items() for v in pair])
    single = F.transform(found, lambda p: F.concat(F.substring(p, 1, 4), tails[F.substring(p, 6, 9)]))
    first, last = (F.nullif(F.regexp_extract(x, "([0-9]{4})-([0-9]{4})年第三季度", i), F.lit("")).try_cast("int") for i in (1, 2))
    spans = F.when(first <= last, F.transform(F.sequence(first, last), lambda y: F.concat(y.cast("string"), F.lit("Q3"))))
    before = F.when(x.contains("去年"), F.lit(f"{this_year - 1}FY")) if this_year else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(single, none), F.coalesce(spans, none), F.array(before))))


def top_n(x: Column) -> Column:
    """L-5: a marked number of the best, else one in digits. 前三季度 is a period, not the first three."""
    t = F.regexp_replace(F.lower(x), "前三季度", "")
    marked = F.coalesce(*[F.when(t.contains(w), n) for w, n in BEST_OF.items()])
    return F.coalesce(marked, F.nullif(F.regexp_extract(t, "(?:前|最高的)([0-9]+)(?:家|位|名|$)", 1), F.lit("")).try_cast("int"))


def threshold(x: Column) -> Column:
    """L-6: the amount (10k) or percentage after the first comparison that has one."""
    part = lambda w, i: F.nullif(F.regexp_extract(x, w + r"\s*([0-9]+(?:\.[0-9]+)?)\s*(亿|万|元)?", i), F.lit(""))
    scale = lambda w: F.coalesce(*[F.when(part(w, 2) == u, k) for u, k in AMOUNTS.items()], F.lit(1.0))
    return F.coalesce(*[part(w, 1).try_cast("double") * scale(w) for w in COMPARISONS])


def slots(questions: DataFrame, this_year: int | None = None) -> DataFrame:
    """L-4 to L-6: periods and the first of them, top-n, threshold (in 10k) of each question, and what it asks for: the best, those that pass, or values."""
    t = F.col("text")
    out = questions.select("question_id", periods(t, this_year).alias("periods"), top_n(t).alias("top_n"), threshold(t).alias("threshold"))
    intent = F.when(F.col("top_n").isNotNull(), "ranking").when(F.col("threshold").isNotNull(), "screen").otherwise("lookup")
    return out.select("question_id", F.get("periods", 0).alias("period"), "periods", "top_n", "threshold", intent.alias("intent"))


def question_type(x: Column, chart: Column, n_companies: Column, n_metrics: Column, n_periods: Column) -> Column:
    """L-8: the type of a question by its words and by what was found in it."""
    has = lambda words: reduce(lambda a, b: a | b, [x.contains(w) for w in words])
    out = F.when(chart.isNotNull() | x.contains("趋势"), "trend_or_chart").when(has(RANKING), "ranking").when(has(FILTERING), "filter")
    out = out.when((n_companies >= 2) & (n_metrics > 0), "comparison").when((n_companies > 0) & (n_metrics > 0), "single_company_metric")
    return out.when((n_metrics > 0) & (n_periods > 0), "period_stat").otherwise("generic")


def metrics(questions: DataFrame, keywords: dict[str, str]) -> DataFrame:
    """L-2: all metrics whose keyword the text holds."""
    found = F.array_compact(F.array(*[F.when(F.col("text").contains(w), F.lit(m)) for w, m in keywords.items()]))
    return questions.select("question_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("metrics"))


def missing_slots(parsed: DataFrame) -> DataFrame:
    """L-10"""
    gone = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("companies", "metrics", "period")]))
    return parsed.select("question_id", F.array_join(gone, ",").alias("missing"))


#: Words by which a turn refers to companies of the turns before.
BACK = ("这些公司", "这些企业", "上述公司", "上述企业", "这些", "上述")


def refers_back(x: Column) -> Column:
    """L-9: whether a turn refers to companies of earlier turns; null texts don't."""
    return F.coalesce(reduce(lambda a, b: a | b, [x.contains(w) for w in BACK]), F.lit(False))


def carried(turns: DataFrame, conv: str, turn: str, value: str, refers: Column | None = None) -> DataFrame:
    """L-9: a turn without a value takes the last one before it, if it refers to it (always, if `refers` is not given)."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(w)
    return turns.withColumn("carried", last if refers is None else F.coalesce(F.col(value), F.when(refers, last)))


def same_period(x: Column, periods: Column, before: Column) -> Column:
    """L-9: periods of a follow-up that asks for the same period (同期) of a year: whole years take the quarter of the period before; without
    periods the year named before 同期 does. Without a period before they stay; null periods are none."""
    own = F.coalesce(periods, F.array().cast("array<string>"))
    year, quarter = F.nullif(F.regexp_extract(x, "([0-9]{4})年同期", 1), F.lit("")), F.substring(before, 5, 10)
    moved = F.transform(own, lambda p: F.when(p.endswith("FY") & year.isNotNull(), F.concat(F.substring(p, 1, 4), quarter)).otherwise(p))
    moved = F.when(F.size(own) > 0, moved).when(year.isNotNull(), F.array(F.concat(year, quarter))).otherwise(own)
    return F.when(x.contains("同期") & before.rlike("^[0-9]{4}.{2}"), F.array_distinct(moved)).otherwise(own)


def cumulative_text(turns: DataFrame) -> DataFrame:
    """A-11: the questions of a dialog so far, joined."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.where("role = 'user'").select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), " | ").alias("question"))


def best_version(files: DataFrame) -> DataFrame:
    """A-4: the chosen file of each (company, year, period): corrected first, no duplicate suffix, then the larger name; with the group's size."""
    w = Window.partitionBy("company", "year", "period")
    order = w.orderBy(F.desc("corrected"), "duplicate", F.desc("name"))
    return files.withColumn("group_size", F.count("*").over(w)).withColumn("selected", F.row_number().over(order) == 1)


def parsed_titles(names: DataFrame) -> DataFrame:
    """A-3: company, year, period, corrected, duplicate of names like `company：yearPeriodReport.pdf`."""
    n = F.col("name")
    return names.select(
        "name",
        F.split(n, "：")[0].alias("company"),
        F.regexp_extract(n, "：([0-9]{4})年", 1).try_cast("int").alias("year"),
        F.regexp_extract(T.report_period(F.lit(""), n), "(Q1|H1|Q3|FY)", 1).alias("period"),
        n.contains("更正").alias("corrected"),
        n.rlike(r"\([0-9]+\)\.pdf$").alias("duplicate"),
    )


def period_end(period: Column) -> Column:
    """A-5"""
    tail = F.substring(period, 5, 2)
    return F.concat(F.substring(period, 1, 4), F.when(tail == "Q1", "0331").when(tail == "H1", "0630").when(tail == "Q3", "0930").otherwise("1231"))


def round_robin(rows: DataFrame, group: str, entity: str, n: int) -> DataFrame:
    """A-14: one row an entity, groups taking turns, n in all."""
    one = rows.groupBy(group, entity).agg(F.min("id").alias("id"))
    turn = F.row_number().over(Window.partitionBy(group).orderBy(entity))
    return one.withColumn("turn", turn).orderBy("turn", group).limit(n).select(group, entity, "id")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A-15: n rows by a seeded hash of their key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def filled(first: DataFrame, rows: DataFrame, key: str, n: int) -> DataFrame:
    """A-14, E-15: the rows of a sample and, up to n in all, the first others of `rows` by key. first has a column turn, its order, then key."""
    rest = rows.join(first.select(key), key, "left_anti").orderBy(key).limit(n)
    both = first.select(*rows.columns, F.lit(0).alias("late"), "turn").unionByName(rest.select(*rows.columns, F.lit(1).alias("late"), F.lit(0).alias("turn")))
    cut = both.orderBy("late", "turn", key).limit(n)
    return cut.withColumn("place", F.row_number().over(Window.orderBy("late", "turn", key))).drop("late", "turn")  # over n rows


def filled_round_robin(rows: DataFrame, group: str, entity: str, n: int) -> DataFrame:
    """A-14: id, group and entity of n rows: one an entity while groups take turns, then the other rows by id. ids are unique."""
    one = rows.groupBy(entity).agg(F.min(F.struct(group, "id")).alias("x")).select("x.*", entity)
    turn = one.withColumn("own", F.row_number().over(Window.partitionBy(group).orderBy("id"))).where(F.col("own") <= n)
    first = turn.orderBy("own", group).limit(n)
    return filled(first.withColumn("turn", F.row_number().over(Window.orderBy("own", group))), rows.select("id", group, entity), "id", n)  # over n rows


def ordered_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A-15: a seeded sample in the order of its key, with places."""
    return seeded_sample(rows, key, n, seed).withColumn("place", F.row_number().over(Window.orderBy(key)))  # over n rows


def with_fallback(hits: DataFrame, other: DataFrame) -> DataFrame:
    """K-21: the hits, and for queries that have none those of the other search, which `fallback` marks."""
    missing = other.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    return hits.withColumn("fallback", F.lit(False)).unionByName(missing.withColumn("fallback", F.lit(True)))


def status_summary(rows: DataFrame, status: str) -> DataFrame:
    """A-13"""
    return rows.groupBy(status).agg(F.count("*").alias("n"))


#: Intents whose retrieval starts from rows, words by which a question means the first row's company, and words that let evidence choose companies.
SEEDED_INTENTS = ("hybrid_sql_rag", "causal_analysis")
ONE_COMPANY = ("该公司", "这家公司", "其主营", "主营业务类型", "业务类型", "成本控制优势")
EVIDENCE_DECIDES = ("应收账款回收风险", "回款风险", "回收不及预期", "FDA", "FDA认证", "集采中标", "中标企业", "业绩预告", "风险提示")


def _first_names(rows: DataFrame, n: int) -> DataFrame:
    """The first n distinct names of each question's rows, in order: question_id, names.

    Rows fold to one a name before names are ranked, and only n of them are gathered."""
    one = rows.where("trim(stock_abbr) <> ''").groupBy("question_id", F.trim("stock_abbr").alias("name")).agg(F.min("place").alias("place"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy("place", "name"))
    first = one.withColumn("place", place).where(F.col("place") <= n)
    return first.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))


def seeded_by_rows(questions: DataFrame, rows: DataFrame, n: int = 5) -> DataFrame:
    """J-15: retrieval plans of questions without companies, seeded from what their SQL found: question_id, companies, scope, seeded.

    Questions of SEEDED_INTENTS take the companies of their context, else the first n of their rows, and a hybrid scope becomes stock; a question about "this
    company" that still has none takes that of its first row. questions: question_id, text, intent, needs_retrieval, scope, companies, context (arrays,
    null: none). rows: question_id, place, stock_abbr."""
    none = F.array().cast("array<string>")
    own, context = F.coalesce("companies", none), F.array_distinct(F.filter(F.transform(F.coalesce("context", none), lambda c: F.trim(c)), lambda c: c != ""))
    names = F.coalesce("names", none)
    asks = F.coalesce(F.col("needs_retrieval") & F.col("intent").isin(*SEEDED_INTENTS), F.lit(False)) & (F.size(own) == 0)
    seeds = F.when(asks, F.when(F.size(context) > 0, context).otherwise(names)).otherwise(none)
    alone = F.coalesce(reduce(lambda a, b: a | b, [F.col("text").contains(w) for w in ONE_COMPANY]), F.lit(False)) & (F.size(own) == 0) & (F.size(seeds) == 0) & (F.size(names) > 0)
    x = questions.join(_first_names(rows, n), "question_id", "left").withColumns({"#own": own, "#seeds": seeds, "#alone": alone, "#first": F.slice(names, 1, 1)})
    found = F.when(F.col("#alone"), F.col("#first")).when(F.size("#seeds") > 0, F.col("#seeds")).otherwise(F.col("#own"))
    scope = F.when(F.col("#alone") | ((F.size("#seeds") > 0) & (F.col("scope") == "hybrid")), "stock").otherwise(F.col("scope"))
    return x.select("question_id", found.alias("companies"), scope.alias("scope"), (F.col("#alone") | (F.size("#seeds") > 0)).alias("seeded"))


def seeded_by_evidence(questions: DataFrame, rows: DataFrame, companies: DataFrame, pool: DataFrame) -> DataFrame:
    """J-15: rows of each question after its evidence has named companies: question_id and the columns of rows.

    Questions that need SQL, have no companies and either found no rows or let evidence decide (EVIDENCE_DECIDES) take the rows of the pool whose company the
    evidence names; one that lets evidence decide loses its rows if the evidence names none; all others keep theirs.
    questions: question_id, text, needs_sql, companies. companies: question_id, companies (array). pool: stock_abbr and the other columns of rows."""
    none = F.array().cast("array<string>")
    decides = F.coalesce(reduce(lambda a, b: a | b, [F.col("text").contains(w) for w in EVIDENCE_DECIDES]), F.lit(False))
    x = questions.select("question_id", (F.coalesce("needs_sql", F.lit(False)) & (F.size(F.coalesce("companies", none)) == 0)).alias("free"), decides.alias("decides"))
    x = x.join(companies.select("question_id", F.array_distinct("companies").alias("found")), "question_id", "left")
    x = x.join(rows.select("question_id").distinct().withColumn("has", F.lit(True)), "question_id", "left")
    named = F.size(F.coalesce("found", none)) > 0
    anew = F.col("free") & named & (F.col("has").isNull() | F.col("decides"))
    x = x.select("question_id", "found", anew.alias("anew"), (F.col("free") & F.col("decides") & ~named).alias("cleared"))
    others = [c for c in rows.columns if c != "question_id"]
    kept = rows.join(x.where("anew or cleared").select("question_id"), "question_id", "left_anti")
    fresh = x.where("anew").select("question_id", F.explode("found").alias("stock_abbr")).join(pool, "stock_abbr")
    return kept.unionByName(fresh.select("question_id", *others))
