"""Page classes, headings, captions, evidence selection and references (K family), plans of retrieval (L-3, L-7, L-11, L-12), KPI enrichment (D-6)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.statements import KEY
from .cells import aliases_of
from .periods import sanitize
from .retrieval import filled


def without_noise(x: Column, patterns: list[str]) -> Column:
    """K-2: inline noise removed by one alternation."""
    return F.regexp_replace(x, "|".join(f"(?:{p})" for p in patterns), "")


def body_pages(pages: DataFrame, markers: list[str]) -> DataFrame:
    """K-3: pages with fewer than two markers of contents or disclaimers."""
    return pages.where(sum((F.col("text").contains(m).cast("int") for m in markers), F.lit(0)) < 2)


def with_headings(lines: DataFrame, doc: str, order: str, heading: Column) -> DataFrame:
    """K-5: each line with the last heading at or before it."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(heading, F.col("line")), ignorenulls=True).over(w))


def captions(x: Column, pattern: str) -> Column:
    """K-11: distinct labels of figures and tables in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))


def caption_text(label: Column, caption: Column) -> Column:
    """B-28"""
    return F.concat_ws("：", label, caption)


def report_metadata(reports: DataFrame, fields: list[str]) -> DataFrame:
    """K-19: given fields, cleaned, as a map."""
    clean = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in fields]
    return reports.select("report_id", F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*clean)), lambda k, v: v.isNotNull()).alias("metadata"))


def described(fields: DataFrame, defaults: DataFrame) -> DataFrame:
    """K-20: descriptions of fields, a default where none is given."""
    return fields.join(defaults.withColumnRenamed("description", "#d"), "field", "left").withColumn("description", F.coalesce("description", "#d")).drop("#d")


def retried(questions: DataFrame, hits: DataFrame, second: DataFrame) -> DataFrame:
    """K-23: hits of a second pass for questions that had none."""
    again = second.join(questions.join(hits, "query_id", "left_anti").select("query_id"), "query_id", "left_semi")
    return hits.withColumn("pass", F.lit(1)).unionByName(again.withColumn("pass", F.lit(2)))


def cut_hits(hits: DataFrame, key: str, k: int, gap: float) -> DataFrame:
    """K-24, U-5: the best hit of each key, the first k of a question, and whether its top one is clear of the next."""
    one = hits.withColumn("r", F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.desc("score"), "vec_id"))).where("r = 1").drop("r")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = one.withColumn("place", F.row_number().over(w)).withColumn("clear", F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0)) >= gap)
    return out.where(F.col("place") <= k)


def reranked(hits: DataFrame, scores: DataFrame) -> DataFrame:
    """K-25: hits in the order of outside scores; those without come last."""
    order = Window.partitionBy("query_id").orderBy(F.col("outside").desc_nulls_last(), F.desc("score"), "vec_id")
    return hits.join(scores, ["query_id", "vec_id"], "left").withColumn("place", F.row_number().over(order))


def _best(rows: DataFrame, score: Column, least: float | None = None) -> DataFrame:
    """The chunk with the best score of each question and document; the earlier one on ties."""
    rows = rows.withColumn("chunk_score", F.round(score, 6))
    rows = rows if least is None else rows.where(F.col("chunk_score") >= least)
    best = F.min_by(F.struct("chunk", "chunk_score"), F.struct((-F.col("chunk_score")).alias("s"), "chunk")).alias("x")
    return rows.groupBy("query_id", "doc_id").agg(best).select("query_id", "doc_id", "x.*")


def _n_terms(*texts: str) -> Column:
    return F.size(F.filter("terms", lambda t: reduce(lambda a, b: a | b, [F.coalesce(F.col(c).contains(t), F.lit(False)) for c in texts])))


def best_chunk(evidence: DataFrame, chunks: DataFrame, short: int = 30) -> DataFrame:
    """K-26: the best chunk of each piece of evidence: 2 for a body, 0.5 for a section, -1.5 if short, 2 if it names the company, else -0.8,
    1 for each term of the question, 0.2 for figures.

    evidence: query_id, doc_id, company (null: not known), terms. chunks: doc_id, chunk, kind, text, section, figures."""
    named = F.when(F.col("company") == "", 0.0).when(F.col("text").contains(F.col("company")), 2.0).when(F.col("company").isNotNull(), -0.8).otherwise(0.0)
    score = F.when(F.col("kind") == "body", 2.0).otherwise(0.0) + F.when(F.col("section") != "", 0.5).otherwise(0.0) - F.when(F.length("text") < short, 1.5).otherwise(0.0)
    return _best(evidence.join(chunks, "doc_id"), score + named + _n_terms("text") + F.when(F.col("figures"), 0.2).otherwise(0.0))


def best_visual(evidence: DataFrame, chunks: DataFrame, least: float = 1.0) -> DataFrame:
    """K-27: the best visual chunk of each piece of evidence, if it has `least`: 1 for a caption, 1.5 if it names the company, 1 for each term of
    the question, 1.2 on the same page, 0.6 at most two and 0.2 at most four pages away.

    evidence: query_id, doc_id, company, terms, page (0: not known). chunks: doc_id, chunk, text, caption, page of visual chunks."""
    rows = evidence.withColumnRenamed("page", "#page").join(chunks, "doc_id")
    holds = lambda c: F.coalesce(F.col(c).contains(F.col("company")), F.lit(False))
    gap = F.when((F.col("page") > 0) & (F.col("#page") > 0), F.abs(F.col("page") - F.col("#page")))
    near = F.when(gap == 0, 1.2).when(gap <= 2, 0.6).when(gap <= 4, 0.2).otherwise(0.0)
    named = F.when((F.col("company") != "") & (holds("text") | holds("caption")), 1.5).otherwise(0.0)
    return _best(rows, F.when(F.col("caption") != "", 1.0).otherwise(0.0) + named + _n_terms("text", "caption") + near, least)


def reference_rows(rows: DataFrame, n: int = 5, deepest: int = 20) -> DataFrame:
    """K-28: the first n references of a question; if none has an image, the best of the next ones that has takes the last place."""
    w = Window.partitionBy("query_id")
    x = rows.where(F.col("place") <= deepest)
    x = x.withColumn("any", F.max(F.when(F.col("place") <= n, F.col("image").cast("int"))).over(w)).withColumn("spare", F.min(F.when((F.col("place") > n) & F.col("image"), F.col("place"))).over(w))
    swap = (F.col("any") == 0) & F.col("spare").isNotNull()
    return x.where(F.when(swap, (F.col("place") < n) | (F.col("place") == F.col("spare"))).otherwise(F.col("place") <= n)).drop("any", "spare")


def fusion_rows(questions: DataFrame, hits: DataFrame, preview: int = 3) -> DataFrame:
    """K-31: for each question the number of hits and a preview of the best (numbered before they are gathered)."""
    first = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= preview, F.struct("place", "vec_id")))), lambda x: x["vec_id"].cast("string")), ",").alias("preview"))
    return questions.join(first, "query_id", "left").select("query_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("preview", F.lit("")).alias("preview"))


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """E-14: chunks and documents of each source, and documents with a body."""
    return chunks.groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(F.when(F.col("kind") == "body", F.col("doc_id"))).alias("n_body"))


def sample_chunks(chunks: DataFrame, n: int = 6) -> DataFrame:
    """E-15: a chunk of each pair of source and kind, the first n pairs."""
    return chunks.groupBy("source", "kind").agg(F.min("doc_id").alias("doc_id")).orderBy("source", "kind").limit(n)


def sample_filled(chunks: DataFrame, n: int = 6) -> DataFrame:
    """E-15: a chunk of each pair of source and kind, pairs in order, then the first others by doc_id, n in all. doc_ids are unique."""
    first = sample_chunks(chunks, n)
    return filled(first.withColumn("turn", F.row_number().over(Window.orderBy("source", "kind"))), chunks.select("doc_id", "source", "kind"), "doc_id", n)  # over n rows


def chart_type(x: Column, keywords: dict[str, str]) -> Column:
    """L-7: the type of the keyword that comes last."""
    places = [F.struct((F.length(x) - F.locate(w[::-1], F.reverse(x))).alias("at"), F.when(x.contains(w), F.lit(t)).alias("t")) for w, t in keywords.items()]
    return F.greatest(*[F.when(x.contains(w), p) for (w, _), p in zip(keywords.items(), places, strict=True)])["t"]


def topics(x: Column, words: list[str]) -> Column:
    """L-3"""
    return F.array_join(F.array_compact(F.array(*[F.when(x.contains(w), F.lit(w)) for w in words])), ",")


def retrieval_plan(slots: DataFrame, floor: int = 5) -> DataFrame:
    """L-11: scope, mode and number of hits from slots."""
    scope = F.when(F.coalesce(F.col("companies"), F.lit("")) != "", "stock").otherwise("industry")
    return slots.select("question_id", scope.alias("scope"), F.when(F.col("intent") == "lookup", "sql").otherwise("hybrid").alias("mode"), F.greatest(F.coalesce("top_n", F.lit(0)), F.lit(floor)).alias("top_k"))


def metric_columns(metrics: DataFrame, dictionary: DataFrame) -> DataFrame:
    """L-12: columns of metrics, and whether each is supported."""
    rows = metrics.select("question_id", F.explode(F.split("metrics", ",")).alias("metric"))
    return rows.join(F.broadcast(dictionary), "metric", "left").select("question_id", "metric", "column", F.col("column").isNotNull().alias("supported"))


def _margin_revenue(income: Column, own: Column, cost: Column, profit: Column) -> Column:
    """Of two positive revenues the one with the less odd margins, the larger on ties; without any the income sheet's if not 0."""
    def candidate(revenue: Column) -> Column:
        gross, net = F.try_divide((revenue - cost) * 100, revenue), F.try_divide(profit * 100, revenue)
        odd = [F.when(F.abs(m) > 100, F.abs(m) + 1_000) for m in (gross, net)] + [F.when(m < -50, -m - 50) for m in (gross, net)] + [F.when(net > gross + 20, net - gross + 480)]
        score = sum((F.coalesce(o, F.lit(0.0)) for o in odd), F.lit(0.0))
        return F.when(revenue > 0, F.struct(score.alias("s"), (-revenue).alias("l"), revenue.alias("revenue")))
    return F.coalesce(F.least(candidate(income), candidate(own))["revenue"], F.nullif(income, F.lit(0.0)), own)


def _related(kpi: DataFrame, income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Key figures beside what they are checked against: revenue, profit, cost and growth of income (#r, #p, #c, #<growth>), equity (#e), cash flow (#o)."""
    x = kpi
    growth = [c for c in GROWTH if c in income.columns]
    for df, names in ((income, {"total_operating_revenue": "#r", "net_profit": "#p", "operating_expense_cost_of_sales": "#c"} | {c: f"#{c}" for c in growth}), (balance, {"equity_total_equity": "#e"}), (cash, {"operating_cf_net_amount": "#o"})):
        x = x.join(df.select(*KEY, *[F.col(a).alias(b) for a, b in names.items()]), KEY, "left")
    for c in ("total_operating_revenue", "net_profit_10k_yuan", "roe", "roe_weighted_excl_non_recurring", "net_profit_excl_non_recurring", *growth):
        x = x if c in x.columns else x.withColumn(c, F.lit(None).cast("double"))
    return x


def enriched_kpi(kpi: DataFrame, income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """D-6: key figures from the joined sheets. Amounts are filled where missing and, within a year, replaced beyond max(100, 30 %) or with another
    sign; margins are replaced beyond 20 points; returns and growth are filled where missing or over 1,000; figures a share are replaced beyond
    max(1, 80 %) or with another sign. Missing sheets leave the own figures."""
    out = _enriched(_related(kpi, income, balance, cash))
    return out.drop(*[c for c in out.columns if c.startswith("#")])


def _enriched(x: DataFrame) -> DataFrame:
    """One pass over key figures beside their related ones."""
    growth = [c for c in GROWTH if f"#{c}" in x.columns]
    own, r, p, cost, equity, flow = (F.col(c) for c in ("total_operating_revenue", "#r", "#p", "#c", "#e", "#o"))
    within = F.right("report_period", F.lit(2)).isin("Q1", "H1", "Q3")
    replaced = lambda c, new, off: F.when(new.isNotNull() & (F.col(c).isNull() | off(F.col(c), new)), new).otherwise(F.col(c))
    amount = lambda a, b: within & F.when(a == 0, F.abs(b) > 100).otherwise((a * b < 0) | (F.abs(a - b) > F.greatest(F.lit(100.0), F.abs(b) * 0.3)))
    wild = lambda a, b: F.abs(a) > 1_000
    margin = lambda a, b: wild(a, b) | (F.abs(a - b) > 20)
    a_share = lambda a, b: F.when((a == 0) | (b == 0), F.abs(a - b) > 1).otherwise((a * b < 0) | (F.abs(a - b) > F.greatest(F.lit(1.0), F.abs(a) * 0.8, F.abs(b) * 0.8)))
    x = x.withColumn("#m", _margin_revenue(r, own, cost, p))
    shares = F.try_divide(p * 10_000, F.col("eps"))
    shares = F.when(F.abs(shares).between(1e6, 1e12), shares)
    return x.withColumns({
        "total_operating_revenue": replaced("total_operating_revenue", r, amount),
        "net_profit_10k_yuan": replaced("net_profit_10k_yuan", p, amount),
        "gross_profit_margin": replaced("gross_profit_margin", F.try_divide((F.col("#m") - cost) * 100, F.col("#m")), margin),
        "net_profit_margin": replaced("net_profit_margin", F.try_divide(p * 100, F.col("#m")), margin),
        "roe": replaced("roe", F.try_divide(p * 100, equity), wild),
        "roe_weighted_excl_non_recurring": replaced("roe_weighted_excl_non_recurring", F.try_divide(F.col("net_profit_excl_non_recurring") * 100, equity), wild),
        "net_asset_per_share": replaced("net_asset_per_share", F.try_divide(equity * 10_000, shares), a_share),
        "operating_cf_per_share": replaced("operating_cf_per_share", F.try_divide(flow * 10_000, shares), a_share),
        **{c: replaced(c, F.col(f"#{c}"), wild) for c in growth},
    })


#: Growth of key figures that income has, and percentages that are checked again between passes.
GROWTH = ("operating_revenue_yoy_growth", "net_profit_yoy_growth")
CHECKED_AGAIN = (
    "gross_profit_margin", "net_profit_margin", "roe", "roe_weighted_excl_non_recurring", "operating_revenue_yoy_growth", "operating_revenue_qoq_growth", "net_profit_yoy_growth", "net_profit_qoq_growth",
    "net_profit_excl_non_recurring_yoy",
)


def settled_kpi(kpi: DataFrame, income: DataFrame, balance: DataFrame, cash: DataFrame, passes: int = 2) -> DataFrame:
    """D-8: key figures sanitized, enriched, their percentages beyond 1,000 dropped, and enriched again, `passes` times in all; history is an array of
    (step, field, before, after) of what each step changed. Later passes see what earlier ones replaced, so a margin may follow a replaced revenue.

    All steps are projections over one join; a step that changes nothing leaves no entry, so passes beyond the last that changes a row add nothing."""
    x = _related(kpi, income, balance, cash).withColumn("history", F.array().cast("array<struct<step:string,field:string,before:double,after:double>>"))
    own = [c for c, t in x.dtypes if t == "double" and not c.startswith("#")]

    def step(x: DataFrame, name: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        y = change(x.withColumns({f"#was_{c}": F.col(c) for c in own}))
        entry = lambda c: F.when(~F.col(c).eqNullSafe(F.col(f"#was_{c}")), F.struct(F.lit(name).alias("step"), F.lit(c).alias("field"), F.col(f"#was_{c}").alias("before"), F.col(c).alias("after")))
        return y.withColumn("history", F.concat("history", F.array_compact(F.array(*map(entry, own))))).drop(*[f"#was_{c}" for c in own])

    checked = [c for c in CHECKED_AGAIN if c in own]
    recheck = lambda x: x.withColumns({c: F.when(F.abs(c) <= 1_000, F.col(c)) for c in checked})
    x = step(x, "sanitize", lambda x: sanitize(x, own))
    for i in range(1, passes + 1):
        x = step(x, f"enrich {i}", _enriched)
        if i < passes:
            x = step(x, f"check {i}", recheck)
    return x.drop(*[c for c in x.columns if c.startswith("#")])


def record_fill(balance: DataFrame) -> DataFrame:
    """C-10b: equity and liability ratio of a record that has assets and liabilities."""
    a, li = F.col("asset_total_assets"), F.col("liability_total_liabilities")
    return balance.withColumns({"equity_total_equity": F.coalesce("equity_total_equity", a - li), "asset_liability_ratio": F.try_divide(li * 100, a)})


def return_prechecks(kpi: DataFrame, income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """R-25, R-26: issues of ROE, of net assets and of operating cash flow a share. An implausible derived ROE (the gate) also ends the
    checks a share, as in the source's rules."""
    x = kpi.join(income.select(*KEY, F.col("net_profit").alias("#p")), KEY)
    x = x.join(balance.select(*KEY, F.col("equity_total_equity").alias("#e")), KEY, "left").join(cash.select(*KEY, F.col("operating_cf_net_amount").alias("#o")), KEY, "left")
    derived = F.try_divide(F.col("#p") * 100, F.col("#e"))
    yearly = F.col("report_period").endswith("FY") & (F.col("#e") > 0) & (F.abs("roe") <= 100)
    gated = F.coalesce(yearly & ((F.abs(derived) > 100) | (derived * F.col("roe") < 0)), F.lit(False))
    shares = F.try_divide(F.col("#p") * 10_000, F.col("eps"))
    a_share = lambda c: F.when(shares.between(1e6, 1e12), F.try_divide(F.col(c) * 10_000, shares))
    beyond = lambda a, b, least: F.abs(a - b) > F.greatest(F.lit(least), F.abs(a) * 0.8, F.abs(b) * 0.8)
    apart = lambda a, b: (a * b < 0) | beyond(a, b, 2.0)
    found = {
        "roe_consistency_precheck": yearly & beyond(F.col("roe"), derived, 8.0),
        "net_asset_per_share_consistency_precheck": apart(F.col("net_asset_per_share"), a_share("#e")),
        "operating_cf_per_share_consistency_precheck": apart(F.col("operating_cf_per_share"), a_share("#o")),
    }
    return x.where(~gated).select(*KEY, F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))).alias("rule"))


def snapped(df: DataFrame, columns: list[str]) -> DataFrame:
    """B-29: amounts of 1e-3 or less in size are 0."""
    return reduce(lambda d, c: d.withColumn(c, F.when(F.abs(c) <= 1e-3, F.lit(0.0)).otherwise(F.col(c))), columns, df)


def only_without_long_grids(page_grids: DataFrame, long_grids: DataFrame) -> DataFrame:
    """C-19"""
    return page_grids.join(long_grids.select("source_name", "table_name").distinct(), ["source_name", "table_name"], "left_anti")


#: What may follow a marker on its line; signals of each sheet; marks of pages about other matters.
MARKER_TAILS = ("", "续", "(续)", "续表", "(续表)")
SIGNALS = {
    "balance": ("资产总计", "负债合计", "所有者权益"),
    "income": ("营业收入", "营业成本", "净利润"),
    "cash": ("经营活动产生的现金流量净额", "现金及现金等价物净增加额"),
    "kpi": ("营业收入", "每股收益", "净资产收益率"),
}
OTHER_MATTERS = ("受影响的合并", "会计政策变更前", "关联交易", "审计报告")


def has_marker(page: Column, markers: list[str]) -> Column:
    """C-14: whether a line, without numbering and colons at its ends, is a marker, continued or not."""
    bare = lambda line: F.regexp_replace(F.regexp_replace(T.clean_label(line), r"^[(]?[一二三四五六七八九十0-9]+[).、]*", ""), r"^:+|:+$", "")
    return F.exists(F.split(F.coalesce(page, F.lit("")), r"\r?\n"), lambda line: bare(line).isin(*[m + t for m in markers for t in MARKER_TAILS]))


def range_score(text: Column, sheet: str) -> Column:
    """C-16: 10 an alias, digits / 80 up to 10, 8 for a unit, 4 for 项目, 12 a signal of the sheet, -25 for other matters."""
    x = T.clean_label(text)
    holds = lambda words: sum((x.contains(w).cast("int") for w in words), F.lit(0))
    aliases = sorted({a for a, _ in aliases_of(sheet)})
    some = x.rlike("单位:?(人民币)?(亿元|万元|元)").cast("int") * 8 + x.contains("项目").cast("int") * 4 - (holds(OTHER_MATTERS) > 0).cast("int") * 25
    return holds(aliases) * 10 + F.least(F.regexp_count(text, F.lit("[0-9]")) / 80, F.lit(10.0)) + some + holds(SIGNALS[sheet]) * 12


def page_ranges(pages: DataFrame, sheet: str, starts: list[str], stops: list[str], span: int = 4) -> DataFrame:
    """C-14 to C-16: ranges from a page with a start marker up to the next page with a stop marker, at most `span` pages, and of each document
    the one with the best score, the earlier on ties.

    pages: doc_id, page, text (null: empty). Returns doc_id, first, last, score; documents without a start marker have no row. A page meets only
    the `span` - 1 pages after it, in one window over its document."""
    ahead = Window.partitionBy("doc_id").orderBy("page").rowsBetween(0, span - 1)
    page = F.struct("page", F.coalesce("text", F.lit("")).alias("text"), has_marker(F.col("text"), stops).alias("stop"))
    x = pages.select("doc_id", page.alias("p"), has_marker(F.col("text"), starts).alias("start"), "page").withColumn("ahead", F.collect_list("p").over(ahead)).where("start")
    stop = F.array_position(F.transform(F.slice("ahead", 2, span), lambda p: p["stop"]), F.lit(True))
    x = x.select("doc_id", F.slice("ahead", F.lit(1), F.when(stop > 0, stop + 1).otherwise(F.lit(span)).cast("int")).alias("range"))
    score = F.round(range_score(F.array_join(F.transform("range", lambda p: p["text"]), "\n"), sheet), 6)
    x = x.select("doc_id", F.get("range", F.lit(0))["page"].alias("first"), F.get("range", F.size("range") - 1)["page"].alias("last"), score.alias("score"))
    return x.groupBy("doc_id").agg(F.min_by(F.struct("first", "last", "score"), F.struct((-F.col("score")).alias("s"), "first")).alias("x")).select("doc_id", "x.*")


def relaxed_cash_gap() -> Column:
    """R-27: the cash flow issue of R-22, but not for a net flow of about zero."""
    total = F.col("operating_cf_net_amount") + F.col("investing_cf_net_amount") + F.col("financing_cf_net_amount")
    net = F.col("net_cash_flow")
    return (F.abs(net - total) > F.greatest(F.lit(100.0), F.abs(net) * 0.05)) & (F.abs(net) > 1e-3)
