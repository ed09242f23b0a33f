"""What an answer cites and shows: references with pictures (K-28, B-28) and the facts and evidence of a question in one row (K-31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The folder of given data, and how the folder of reports in it is written in a reference.
GIVEN, REPORTS, REPORTS_CITED = "正式数据", "附件5：研报数据", "附件 5：研报数据"


def _text(x: Column) -> Column:
    return F.trim(F.coalesce(x.cast("string"), F.lit("")))


def caption(label: Column, text: Column) -> Column:
    """B-28: `label：text`, or the one of both that there is; empty if there is none."""
    label, text = _text(label), _text(text)
    return F.when((label != "") & (text != ""), F.concat(label, F.lit("："), text)).otherwise(F.concat(label, text))


def relative_path(path: Column, base: str) -> Column:
    """B-28: a path as references give it: what lies in the folder of given data below base from there (`../`), all else in base from base
    (`./`), others as they are; empty for null and blanks. Repeated and closing slashes fall away."""
    p = _text(path)
    p = F.regexp_replace(F.regexp_replace(p, "/+", "/"), "(?<=.)/$", "")
    root = base.rstrip("/") + "/"
    rel = F.substring(p, len(root) + 1, 1 << 30)
    given = f"^(?:.*?/)?{GIVEN}(?:/(.*))?$"
    tail = F.regexp_replace(F.regexp_extract(rel, given, 1), f"^{REPORTS}(?=/|$)", REPORTS_CITED)
    inside = F.when(rel.rlike(given), F.concat(F.lit("../"), tail)).otherwise(F.concat(F.lit("./"), rel))
    return F.when(p.startswith(root), inside).otherwise(p)


def picture(captions: Column, visual: Column, most: int = 3) -> Column:
    """K-28: the first captions (array of texts; blanks among them count but don't show), and the visual caption unless they hold it; null if there is nothing."""
    listed = F.array_join(F.filter(F.transform(F.slice(F.coalesce(captions, F.array().cast("array<string>")), 1, most), _text), lambda x: x != ""), "；")
    visual = _text(visual)
    shown = F.when(listed == "", visual).when((visual == "") | listed.contains(visual), listed).otherwise(F.concat(listed, F.lit("；"), visual))
    return F.nullif(shown, F.lit(""))


def references(hits: DataFrame, base: str, n: int = 5, deepest: int = 20, longest: int = 600) -> DataFrame:
    """K-28: the first n references of each question: place, path, text of at most `longest` characters and picture. If none of them has a picture,
    the first one down to place `deepest` that has takes the last place.

    hits: query_id, place (from 1, each once), path, text, chunk_text (used where text is blank), captions, chunk_captions (used where there are no captions),
    visual. Others of their columns are left out. Ranks beyond `deepest` go before anything is moved, so a question is at most that many rows."""
    first = lambda a, b: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, a).otherwise(b)
    text = F.when(_text(F.col("text")) != "", _text(F.col("text"))).otherwise(_text(F.col("chunk_text")))
    rows = hits.where(F.col("place") <= deepest).select("query_id", "place", relative_path(F.col("path"), base).alias("path"), F.substring(text, 1, longest).alias("text"), picture(first(F.col("captions"), F.col("chunk_captions")), F.col("visual")).alias("picture"))
    w = Window.partitionBy("query_id")
    shown = F.min(F.when(F.col("picture").isNotNull(), F.col("place"))).over(w)
    rows = rows.withColumn("#spare", F.when(shown > n, shown))
    last = F.col("place") == F.col("#spare")
    kept = rows.where((F.col("place") < n) | last | ((F.col("place") == n) & F.col("#spare").isNull()))
    return kept.select("query_id", F.when(last, n).otherwise(F.col("place")).cast("int").alias("place"), "path", "text", "picture")


def fused(questions: DataFrame, rows: DataFrame, evidence: DataFrame, preview: int = 5) -> DataFrame:
    """K-31: for each question how many rows and pieces of evidence there are, the first of both, titles of the evidence, and its number by type.

    questions: query_id. rows: query_id, place, row (text). evidence: query_id, place, title, source_type (blank: unknown). Counts are aggregated before they
    move and only the first places are gathered; what has no place counts, but is in no preview. A question without rows or evidence stays."""
    early = F.col("place").between(1, preview)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(early, F.struct("place", F.coalesce(c, F.lit("")).alias("x"))))), lambda v: v["x"])
    sql = rows.groupBy("query_id").agg(F.count("*").alias("sql_row_count"), ordered(F.col("row")).alias("sql_preview"))
    kind = F.when(_text(F.col("source_type")) == "", "unknown").otherwise(F.col("source_type"))
    kinds = evidence.groupBy("query_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.collect_list(F.when(early, F.struct("place", F.coalesce("title", F.lit("")).alias("x")))).alias("first"))
    first = F.array_sort(F.flatten(F.collect_list("first")))
    found = kinds.groupBy("query_id").agg(F.sum("n").alias("evidence_count"), F.transform(first, lambda v: v["x"]).alias("evidence_titles"), F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))
    found = found.select("query_id", "evidence_count", "evidence_titles", F.to_json(F.map_from_entries("kinds")).alias("source_breakdown"))
    none = F.array().cast("array<string>")
    out = questions.select("query_id").join(sql, "query_id", "left").join(found, "query_id", "left")
    return out.select(
        "query_id", F.coalesce("sql_row_count", F.lit(0)).alias("sql_row_count"), F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
        F.coalesce("sql_preview", none).alias("sql_preview"), F.coalesce("evidence_titles", none).alias("evidence_titles"), F.coalesce("source_breakdown", F.lit("{}")).alias("source_breakdown"),
    )
