"""Registered queries of plans of retrieval (L-11), of their repeated search (K-23), of resumable builds (K-14) and of sheets from paths (A-7), with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planning as P
from ..operators import view as V
from ..sources import tables as A
from ..sources.statements import ORACLE_BASE, sheets
from ..streaming import embedding as S
from .statement_queries import O as STATEMENT_SQL
from .statement_queries import VIEW_COLUMNS

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}

#: Questions of third quarters; {} stands for the company.
TEXTS = ("{}为什么增长", "中药材价格波动与供需", "海外市场拓展的原因", "{}的主营业务收入是多少，结合研报说明", "偿债能力有何变化", "{}资产重组后的变化", "大健康产品布局", "AI与产业升级对行业的影响", "{}净利润是多少", "{}净利润变化")
INTENTS = ("sql_only", "industry_open_analysis", "causal_analysis", "sql_chart", None, "", "other")
SCOPES = (None, ["stock"], ["Sector", "x"], ["annual_report"], [" Hybrid "], ["", "news"])
MODES = (None, "semantic", "BM25", "vector", "keyword", "dense")
TOPICS = (["政策"], None, ["集采", ""], ["品牌", " 渠道 ", "集采"], ["行业景气度"])
REPORT_TOPICS = (["收入增长"], ["并购", "重组"], ["出口", "品牌"], ["现金流"], ["渠道", "新品上市"], ["气候", "业务结构", "气候"], ["信息化"])


def _one_of(values: tuple, i: Column, kind: str) -> Column:
    """The i-th of some values."""
    lit = lambda v: (F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).cast(kind)
    return F.get(F.array(*map(lit, values)), i % len(values))


def _sql_value(v) -> str:
    return "NULL" if v is None else "[" + ", ".join(map(_sql_value, v)) + "]" if isinstance(v, (list, tuple)) else f"'{v}'"


def _sql_one_of(values: tuple, i: str) -> str:
    return f"([{', '.join(map(_sql_value, values))}])[{i} % {len(values)} + 1]"


def given_plans(spark: SparkSession, d: str) -> DataFrame:
    """A plan for each company and third quarter, with gaps, blanks and names of other systems."""
    x = sheets(spark, d)["income"].where("report_period like '%Q3'")
    k, y = F.col("stock_code").cast("int"), F.col("report_year")
    own = lambda test: F.when(test, F.array("stock_abbr"))
    return x.select(
        F.concat_ws("-", "stock_code", "report_period").alias("question_id"), F.replace(_one_of(TEXTS, k + y, "string"), F.lit("{}"), F.col("stock_abbr")).alias("text"), _one_of(INTENTS, k + y * 2, "string").alias("intent"),
        own(k % 3 > 0).alias("companies"), own(y % 2 == 0).alias("slot_companies"), _one_of(TOPICS, y, "array<string>").alias("topics"), own(F.lit(True)).cast("array<string>").alias("slot_topics"),
        _one_of(SCOPES, k, "array<string>").alias("scope"), _one_of(MODES, y + k, "string").alias("mode"), F.when(k % 4 > 0, k % 4 > 1).alias("needs_retrieval"), F.when(y % 3 > 0, y % 3 > 1).alias("slot_needs"),
        F.when(k % 7 == 0, 0).when(k % 7 == 1, 12).alias("top_k"),
    )


def given_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report for each row of the key figures, every fourth on an industry."""
    k, y = F.col("stock_code").cast("int"), F.col("report_year")
    industry = (k + y) % 4 == 0
    return sheets(spark, d)["kpi"].select(F.concat_ws("-", "stock_code", "report_period").alias("report_id"), F.when(industry, "industry").otherwise("stock").alias("kind"), F.when(~industry, F.col("stock_abbr")).alias("company"), _one_of(REPORT_TOPICS, k * 3 + y, "array<string>").alias("topics"))


def _plans(spark: SparkSession, d: str) -> DataFrame:
    return P.normalized_plans(given_plans(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("companies", "topics")}).drop("text")


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    reports = given_reports(spark, d)
    return P.searched(P.normalized_plans(given_plans(spark, d)), lambda plans: P.topic_hits(plans, reports), [P.second_plans, P.related_plans])


_any = lambda x, words: "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"
_rules = ", ".join(f"({i}, {_sql_value(w)}, {_sql_value(t)})" for i, (w, t) in enumerate(P.EXPANSIONS, 1))
_clean = lambda x: f"list_filter(list_transform(coalesce({x}, []::VARCHAR[]), lambda z: trim(z, ' ')), lambda z: z <> '')"
# topics by their first place: the plan's own, then those of each expansion in order
_expand = lambda source, name: f"""{name}_t AS (
  SELECT question_id, topic, min(nr) AS nr FROM (
    SELECT question_id, unnest(topics) AS topic, generate_subscripts(topics, 1) AS nr FROM {source}
    UNION ALL SELECT question_id, unnest(t), r.i * 1000 + generate_subscripts(t, 1) FROM {source} s JOIN rules r ON len(list_filter(r.w, lambda z: contains(s.text, z))) > 0) GROUP BY ALL),
{name} AS (SELECT s.* REPLACE (coalesce(l.topics, []) AS topics) FROM {source} s LEFT JOIN (SELECT question_id, list(topic ORDER BY nr) AS topics FROM {name}_t GROUP BY 1) l USING (question_id))"""  # noqa: E731
_SQL_PLANS = f"""WITH {ORACLE_BASE}, rules(i, w, t) AS (VALUES {_rules}),
g0 AS (SELECT concat_ws('-', stock_code, report_period) AS question_id, stock_abbr AS n, stock_code::INT AS k, report_year AS y FROM income WHERE report_period LIKE '%Q3'),
g1 AS (SELECT *, replace({_sql_one_of(TEXTS, "(k + y)")}, '{{}}', n) AS text, coalesce({_sql_one_of(INTENTS, "(k + y * 2)")}, '') AS intent, {_clean(_sql_one_of(TOPICS, "y"))} AS own, list_transform({_clean(_sql_one_of(SCOPES, "k"))}, lambda z: lower(z)) AS given,
  lower(coalesce({_sql_one_of(MODES, "(y + k)")}, '')) AS m, coalesce(CASE WHEN k % 4 > 0 THEN k % 4 > 1 END, CASE WHEN y % 3 > 0 THEN y % 3 > 1 END, true) AS needs, CASE WHEN k % 7 = 1 THEN 12 ELSE 5 END AS k0 FROM g0),
g2 AS (SELECT question_id, text, intent, given, needs, k0, CASE WHEN len(own) > 0 THEN own ELSE [n] END AS topics, CASE WHEN NOT {_any("text", P.TO_COME)} AND (k % 3 > 0 OR y % 2 = 0) THEN [n] ELSE []::VARCHAR[] END AS companies, {_any("text", P.MUST_SEARCH)} AS must,
  CASE WHEN m IN ('metadata', 'vector', 'hybrid') THEN m WHEN m IN ('keyword', 'bm25') THEN 'metadata' ELSE 'hybrid' END AS mode FROM g1),
{_expand("g2", "g3")},
g4 AS (SELECT *, array_to_string(given, ' ') AS j, len(companies) > 0 AS named FROM g3),
plans AS (SELECT question_id, text, companies, topics, CASE WHEN intent IN ('sql_only', 'sql_chart') THEN must ELSE needs OR must END AS needs_retrieval,
  greatest(CASE WHEN intent IN ('sql_only', 'sql_chart') AND NOT must THEN 0 ELSE k0 END, CASE WHEN must OR intent IN ('industry_open_analysis', 'causal_analysis') OR named AND {_any("text", P.WHY)} THEN 8 ELSE 0 END)::INT AS top_k,
  CASE WHEN intent = 'industry_open_analysis' THEN 'industry' WHEN len(list_intersect(given, ['stock', 'industry', 'hybrid'])) > 0 THEN list_filter(given, lambda z: z IN ('stock', 'industry', 'hybrid'))[1]
    WHEN {_any("j", P.STOCK_NAMES)} THEN CASE WHEN NOT named OR {_any("text", P.SCOPE_WHY)} THEN 'hybrid' ELSE 'stock' END WHEN {_any("j", P.INDUSTRY_NAMES)} THEN CASE WHEN named THEN 'hybrid' ELSE 'industry' END
    WHEN {_any("text", P.STOCK_WORDS)} THEN CASE WHEN named THEN 'stock' ELSE 'hybrid' END WHEN {_any("text", P.INDUSTRY_WORDS)} THEN CASE WHEN named THEN 'hybrid' ELSE 'industry' END
    WHEN NOT named AND {_any("text", P.PRODUCT_WORDS)} THEN 'industry' WHEN named THEN CASE WHEN {_any("text", P.WIDE_WORDS)} OR {_any("array_to_string(topics, '|')", P.WIDE_TOPICS)} THEN 'hybrid' ELSE 'stock' END
    WHEN {_any("text", ("行业", "板块"))} THEN 'industry' ELSE 'hybrid' END AS scope, mode FROM g4)"""
Q["l11_normalized_plans"] = _plans
O["l11_normalized_plans"] = _SQL_PLANS + " SELECT question_id, array_to_string(companies, ',') AS companies, array_to_string(topics, ',') AS topics, needs_retrieval, top_k, scope, mode FROM plans"

# the score is of the distinct topics that both share
_search = lambda plans, name, turn: f"""{name}_m AS (
  SELECT question_id, report_id, top_k, len(list_intersect(p.topics, r.topics)) * 2.0 + CASE WHEN list_contains(companies, company) THEN 3 ELSE 0 END AS score FROM {plans} p JOIN reports r
  ON len(list_intersect(p.topics, r.topics)) > 0 AND (scope = 'hybrid' OR scope = kind AND (kind = 'industry' OR len(companies) = 0 OR list_contains(companies, company)))),
{name} AS (SELECT question_id, report_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, report_id)::INT AS place, {turn} AS turn, top_k FROM {name}_m QUALIFY place <= top_k)"""  # noqa: E731
_left = lambda plans, hits: f"SELECT * FROM {plans} WHERE question_id NOT IN (SELECT question_id FROM {hits})"
Q["k23_wider_searches"] = _rounds
O["k23_wider_searches"] = f"""{_SQL_PLANS},
reports AS (SELECT concat_ws('-', stock_code, report_period) AS report_id, CASE WHEN (stock_code::INT + report_year) % 4 = 0 THEN 'industry' ELSE 'stock' END AS kind, CASE WHEN (stock_code::INT + report_year) % 4 <> 0 THEN stock_abbr END AS company, {_sql_one_of(REPORT_TOPICS, "(stock_code::INT * 3 + report_year)")} AS topics FROM kpi),
open1 AS (SELECT * FROM plans WHERE needs_retrieval), {_search("open1", "h1", 1)}, left1 AS ({_left("open1", "h1")}),
more AS (SELECT * FROM left1 WHERE len(companies) > 0 AND {_any("text", P.ASKED_AGAIN)}), {_expand("more", "more1")},
open2 AS (SELECT * REPLACE (list_concat(topics, list_filter({_sql_value(P.SECOND_TOPICS)}, lambda z: NOT list_contains(topics, z)))[1:12] AS topics, greatest(CASE WHEN top_k = 0 THEN 5 ELSE top_k END, 8)::INT AS top_k, 'hybrid' AS scope, 'hybrid' AS mode) FROM more1),
{_search("open2", "h2", 2)}, left2 AS ({_left("open2", "h2")} UNION ALL {_left("left1", "open2")}),
wide AS (SELECT question_id, list(DISTINCT z) AS more FROM (SELECT question_id, unnest(t) AS z FROM left2 JOIN rules ON len(list_intersect(topics, t)) > 0) GROUP BY 1),
open3 AS (SELECT l.* REPLACE (list_distinct(list_concat(topics, more)) AS topics, 'hybrid' AS scope) FROM left2 l JOIN wide USING (question_id) WHERE len(list_filter(more, lambda z: NOT list_contains(topics, z))) > 0),
{_search("open3", "h3", 3)}
SELECT * EXCLUDE (top_k) FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)"""


def _resumed(spark: SparkSession, d: str) -> DataFrame:
    """The chunks' measures, from a build in batches and a second call, which finds nothing to do."""
    chunks = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")
    source = A.stored_path(chunks.repartition(spark.sparkContext.defaultParallelism, "chunk_id"))
    letters = lambda x: F.array(F.length(x), F.length(F.regexp_replace(x, "[^a-z]", "")), F.length(F.regexp_replace(x, "[^ ]", ""))).cast("array<float>")
    for _ in range(2):
        S.build_resumable(spark, source, f"{source}-index", "letters", letters, files_a_batch=3)
    n = spark.read.parquet(source).count()
    state = S.progress(spark, f"{source}-index", "letters", n).select("index_status", F.col("dim").alias("n_dims"))
    return S.embedded(spark, f"{source}-index", "letters", n).select("chunk_id", *[F.get("embedding", i).cast("int").alias(c) for i, c in enumerate(("n_chars", "n_letters", "n_spaces"))]).join(F.broadcast(state))


Q["k14_resumed_build"] = _resumed
O["k14_resumed_build"] = "SELECT doc_id::VARCHAR AS chunk_id, length(text)::INT AS n_chars, length(regexp_replace(text, '[^a-z]', '', 'g'))::INT AS n_letters, length(regexp_replace(text, '[^ ]', '', 'g'))::INT AS n_spaces, 'ready' AS index_status, 3 AS n_dims FROM documents"


def _from_paths(spark: SparkSession, d: str) -> DataFrame:
    """The wide view of sheets that were written to a folder each and are read by path."""
    s = sheets(spark, d)
    read = lambda n: A.read_sheet(spark, path=A.stored_path(s[n]), schema=dict(s[n].dtypes))
    return V.wide(*map(read, ("income", "kpi", "balance", "cash"))).select(*VIEW_COLUMNS)


Q["a7_sheets_from_paths"] = _from_paths
O["a7_sheets_from_paths"] = STATEMENT_SQL["v1_wide_view"]
