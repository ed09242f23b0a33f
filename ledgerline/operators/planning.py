"""Plans of retrieval (L-11) and their repeated search with wider topics (K-23)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Words of a question, and the topics that they add, in this order.
WHY = ("为什么", "原因", "驱动")
EXPANSIONS = (
    (WHY, ("增长驱动", "业务结构", "市场拓展", "产品线", "品牌", "渠道")),
    (("海外市场拓展", "海外拓展", "出海"), ("海外市场拓展", "海外拓展", "出海", "国际化", "海外业务", "出口")),
    (("人工智能", "产业升级", "AI"), ("人工智能", "产业升级", "AI", "智能化", "数字化", "信息化")),
    (("资产重组", "并购重组"), ("资产重组", "重大资产重组", "并购", "重组", "控制权变更", "股权转让")),
    (("FDA", "认证"), ("FDA", "FDA认证", "认证", "海外注册", "国际认证")),
    (("业绩预告",), ("业绩预告", "预告", "净利润预告", "业绩快报")),
    (("主营业务收入", "营业总收入", "营业收入"), ("主营业务收入", "营业总收入", "收入增长")),
    (("主营业务类型", "业务类型", "成本控制", "成本结构", "营业总成本", "营业成本", "销售费用", "管理费用", "研发费用"), ("主营业务", "主营业务类型", "业务类型", "成本控制", "成本结构", "销售费用", "研发费用", "中药", "创新药")),
    (("中药材", "价格波动", "价格趋势", "趋势", "供需", "库存", "种植", "气候"), ("中药材", "价格", "价格波动", "趋势", "供需", "库存", "种植", "气候", "政策", "中药")),
    (("偿债风险", "偿债能力", "流动比率"), ("偿债风险", "偿债能力", "流动比率", "短期偿债", "现金流", "负债")),
    (("投资项目", "投资性现金流"), ("投资项目", "投资说明", "资本开支", "投资性现金流", "扩产")),
    (("大健康", "新品上市周期", "研发投入结构", "种植基地", "订单农业", "基地共建"), ("大健康", "新品上市", "新品上市周期", "新药上市", "研发投入结构", "研发投入", "研发费用", "研发强度", "研发管线", "创新管线", "种植基地", "订单农业", "基地共建")),
)
#: Words by which a question must search, is about what is to come, may be asked again, and topics of the second search.
MUST_SEARCH = ("结合研报", "结合个股研报", "结合行业研报", "检索研报", "研报中", "提取研报", "提取研报观点", "提取观点", "观点", "风险预警", "说明")
TO_COME = ("未来", "趋势", "预测", "价格波动", "中药材价格")
ASKED_AGAIN = ("为什么", "原因", "驱动", "变化", "提升", "上升")
SECOND_TOPICS = ("收入增长", "业绩增长", "产品", "渠道", "品牌", "业务结构", "市场拓展", "并购整合")
SECOND_MOST, LEAST, USUAL = 12, 8, 5
#: What decides on a scope.
STOCK_NAMES = ("company_announcement", "annual_report", "stock_report", "research_report")
INDUSTRY_NAMES = ("industry_report", "sector", "行业", "板块")
SCOPE_WHY = ("为什么", "原因", "驱动", "变化", "上升", "下降")
STOCK_WORDS = ("结合个股研报", "个股研报", "业绩预告", "FDA", "资产重组", "海外市场拓展")
INDUSTRY_WORDS = ("结合行业研报", "政策研报", "行业研报", "行业周报", "投资策略", "行业趋势", "景气度")
PRODUCT_WORDS = ("新品上市周期", "研发投入结构", "大健康产品布局", "大健康")
WIDE_WORDS = ("行业", "景气度", "关系", "影响", "对比", "趋势")
WIDE_TOPICS = ("行业", "板块", "景气度", "趋势")
SEMANTIC = ("semantic_search", "semantic", "embedding", "dense")
KEYWORD = ("keyword", "bm25")

PLAN = ["question_id", "text", "companies", "topics", "needs_retrieval", "top_k", "scope", "mode"]


def holds(x: Column, words: tuple[str, ...]) -> Column:
    """Whether x holds any of the words; false where it is null."""
    return F.coalesce(reduce(lambda a, b: a | b, [x.contains(w) for w in words]), F.lit(False))


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def _given(x: Column) -> Column:
    """An array without nulls and blanks, trimmed; empty where it is null."""
    return F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")


def expanded(question: Column, topics: Column) -> Column:
    """The topics, each once, and those that the words of the question add."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(_given(topics), *[F.when(holds(question, w), _words(t)).otherwise(none) for w, t in EXPANSIONS]))


def related(topics: Column) -> Column:
    """The topics and, of the expansions that share one with them, all others."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(topics, *[F.when(F.arrays_overlap(topics, _words(t)), _words(t)).otherwise(none) for _, t in EXPANSIONS]))


def scope_of(question: Column, given: Column, companies: Column, topics: Column) -> Column:
    """stock, industry or hybrid: as given, else by the names given, the question's words, its companies and topics."""
    tokens = F.transform(_given(given), lambda t: F.lower(t))
    plain = F.filter(tokens, lambda t: t.isin("stock", "industry", "hybrid"))
    joined, named = F.array_join(tokens, " "), F.size(companies) > 0
    ours, theirs = F.when(named, "stock").otherwise("hybrid"), F.when(named, "hybrid").otherwise("industry")
    wide = holds(question, WIDE_WORDS) | F.exists(topics, lambda t: holds(t, WIDE_TOPICS))
    return (
        F.when(F.size(plain) > 0, F.get(plain, 0))
        .when(holds(joined, STOCK_NAMES), F.when(named & holds(question, SCOPE_WHY), "hybrid").otherwise(ours))
        .when(holds(joined, INDUSTRY_NAMES), theirs)
        .when(holds(question, STOCK_WORDS), ours)
        .when(holds(question, INDUSTRY_WORDS), theirs)
        .when(~named & holds(question, PRODUCT_WORDS), "industry")
        .when(named, F.when(wide, "hybrid").otherwise("stock"))
        .otherwise(F.when(holds(question, ("行业", "板块")), "industry").otherwise("hybrid"))
    )


def normalized_plans(plans: DataFrame, vectors: bool = True) -> DataFrame:
    """L-11: plans with companies, topics, scope, mode, number of hits and need of retrieval settled.

    plans: question_id, text, intent, companies, topics, scope (array), mode, needs_retrieval, top_k and slot_companies, slot_topics, slot_needs, which count
    where the plan's own are empty or null. vectors: whether there are embeddings to search. Any value may be null."""
    q, must = F.coalesce("text", F.lit("")), holds(F.col("text"), MUST_SEARCH)
    either = lambda a, b: F.when(F.size(_given(F.col(a))) > 0, _given(F.col(a))).otherwise(_given(F.col(b)))
    search = "hybrid" if vectors else "metadata"
    mode = F.lower(F.trim(F.coalesce("mode", F.lit(""))))
    x = plans.select(
        "question_id", q.alias("text"), F.coalesce("intent", F.lit("")).alias("intent"), must.alias("must"),
        F.when(holds(q, TO_COME), F.array().cast("array<string>")).otherwise(either("companies", "slot_companies")).alias("companies"), expanded(q, either("topics", "slot_topics")).alias("topics"),
        F.col("scope").alias("given"), F.coalesce("needs_retrieval", "slot_needs", F.lit(True)).alias("needs"), F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(USUAL)).alias("k"),
        F.when(mode.isin("metadata", "vector", "hybrid"), mode).when(mode.isin(*KEYWORD), "metadata").otherwise(search).alias("mode"),
    )
    sql = F.col("intent").isin("sql_only", "sql_chart")
    more = F.col("must") | F.col("intent").isin("industry_open_analysis", "causal_analysis") | (holds(F.col("text"), WHY) & (F.size("companies") > 0))
    least = F.when(sql & ~F.col("must"), F.lit(0)).otherwise(F.col("k"))
    return x.select(
        "question_id", "text", "companies", "topics", F.when(sql, F.col("must")).otherwise(F.col("needs") | F.col("must")).alias("needs_retrieval"), F.when(more, F.greatest(least, F.lit(LEAST))).otherwise(least).alias("top_k"),
        F.when(F.col("intent") == "industry_open_analysis", "industry").otherwise(scope_of(F.col("text"), F.col("given"), F.col("companies"), F.col("topics"))).alias("scope"), "mode",
    )


def second_plans(plans: DataFrame, vectors: bool = True) -> DataFrame:
    """The plans that are searched once more, of questions with a company and words of change: both scopes, at most twelve topics."""
    x = plans.where((F.size("companies") > 0) & holds(F.col("text"), ASKED_AGAIN))
    topics = F.slice(F.array_distinct(F.concat(expanded(F.col("text"), F.col("topics")), _words(SECOND_TOPICS))), 1, SECOND_MOST)
    top_k = F.greatest(F.coalesce(F.nullif("top_k", F.lit(0)), F.lit(USUAL)), F.lit(LEAST))
    return x.withColumns({"topics": topics, "needs_retrieval": F.lit(True), "top_k": top_k, "scope": F.lit("hybrid"), "mode": F.lit("hybrid" if vectors else "metadata")})


def related_plans(plans: DataFrame) -> DataFrame:
    """Plans whose topics grow by those of the expansions that they share a topic with, in both scopes."""
    return plans.withColumn("#t", related(F.col("topics"))).where(F.size("#t") > F.size("topics")).withColumns({"topics": F.col("#t"), "scope": F.lit("hybrid")}).drop("#t")


def topic_hits(plans: DataFrame, reports: DataFrame) -> DataFrame:
    """question_id, report_id, score, place: the top_k reports that share a topic with a plan and are in its scope, +2 a topic, +3 for one of its companies.

    reports: report_id, kind (stock or industry), company (null: none), topics. Reports of the same kind and topics score alike whatever their company, but for
    a plan's own companies; so topics meet once for all plans of the same topics and scope, the first top_k of them are enough, and reports of the own companies
    come by a join on the company. What meets grows with different sets of topics, not with plans times reports."""
    key, wide = ["companies", "topics", "scope", "top_k"], ["topics", "scope", "top_k"]
    asked = plans.where("top_k > 0").select(*key).distinct()
    most = asked.agg(F.max("top_k")).first()[0] or 0
    sets = reports.select("report_id", "kind", "company", F.array_sort(F.array_distinct(_given(F.col("topics")))).alias("set")).where(F.size("set") > 0)
    first = lambda by: sets.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("report_id"))).where(F.col("n") <= most).drop("n")
    best = lambda rows, by: rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "report_id"))).where(F.col("place") <= F.col("top_k"))
    fits = (F.col("scope") == "hybrid") | (F.col("scope") == F.col("kind"))
    open_ = asked.where((F.col("scope") != "stock") | (F.size("companies") == 0))
    classes = sets.select("kind", "set").distinct()
    met = open_.select(*wide).distinct().withColumn("topic", F.explode(F.array_distinct("topics"))).join(classes.withColumn("topic", F.explode("set")), "topic").where(fits).groupBy(*wide, "kind", "set").agg((F.count("*") * 2.0).alias("score"))
    any_ = best(met.join(first(["kind", "set"]).drop("company"), ["kind", "set"]), wide).select(*wide, "report_id", "score")
    shared = F.size(F.array_intersect("topics", "set"))
    own = asked.withColumn("company", F.explode(F.array_distinct("companies"))).join(first(["kind", "company", "set"]), "company").where(fits & (shared > 0)).select(*key, "report_id", (shared * 2.0 + 3.0).alias("score"))
    both = open_.join(any_, wide).select(*key, "report_id", "score").unionByName(own).groupBy(*key, "report_id").agg(F.max("score").alias("score"))
    return plans.join(best(both, key), key).select("question_id", "report_id", "score", "place")


def searched(plans: DataFrame, search: Callable[[DataFrame], DataFrame], wider: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """K-23: the hits of plans and, turn by turn, of wider plans for the questions that had none so far, with the turn that found them.

    search: from plans to hits with question_id. wider: a function a turn, from plans to those that it changes; a plan that it leaves out waits for the next
    turn. Plans that need no retrieval have no hits. Plans and hits of a turn are stored, so a turn never repeats those before."""
    open_ = stored(plans.where("needs_retrieval"))
    hits = [stored(search(open_).withColumn("turn", F.lit(1)))]
    for turn, widen in enumerate(wider, 2):
        left = stored(open_.join(hits[-1].select("question_id").distinct(), "question_id", "left_anti"))
        again = stored(widen(left).select(*left.columns))
        if again.isEmpty():
            open_ = left
            continue
        hits.append(stored(search(again).withColumn("turn", F.lit(turn))))
        open_ = again.unionByName(left.join(again.select("question_id"), "question_id", "left_anti"))
    return reduce(DataFrame.unionByName, hits)
