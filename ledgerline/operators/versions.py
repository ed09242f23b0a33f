"""Names of report files of the second exchange, and the version of each report that is kept (A-3, A-4, A-17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Period words of titles and the periods that they mean, marks of corrected titles, types of reports.
PERIODS = {"第一季度": "一季度", "一季度": "一季度", "半年度": "半年度", "第三季度": "三季度", "三季度": "三季度", "年度": "年度"}
CORRECTED = ("更正后", "更新后")
SUMMARY, WHOLE = "摘要", "全文"
#: What makes two files versions of one report.
REPORT = ["company", "year", "period", "report_type"]


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _solid(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", "")


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x computed once however often f names it, also where a filter on the result moves below."""
    return F.transform(F.array(x), f)[0]


def _said(name: Column) -> Column:
    """What a name says as a struct; parsed is false or null if it has another form."""
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    said = F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair])

    def parts(a: Column) -> Column:
        stem, cut = a["stem"], a["cut"]
        return _let(F.struct(_solid(F.substring(stem, F.lit(1), cut - 1)).alias("company"), _bare(F.substring(stem, cut + 1, F.length(stem))).alias("tail")), lambda b: _let(rest(b["company"], b["tail"]), lambda r: read(a, b["company"], r)))

    def rest(company: Column, tail: Column) -> Column:
        again = (company != "") & _solid(tail).startswith(company)
        rest = F.when(again, _bare(F.substring(tail, F.length(company) + 1, F.length(tail)))).otherwise(tail)
        return _let(rest, lambda r: F.struct(r.alias("rest"), F.regexp_extract(r, "(20[0-9]{2})年", 1).alias("year"), F.regexp_extract(r, f"({'|'.join(PERIODS)})", 1).alias("word")))

    def read(a: Column, company: Column, r: Column) -> Column:
        rest = r["rest"]
        return F.struct(
            (name.rlike(r"(?i)\.pdf$") & (a["cut"] > 0) & (r["year"] != "") & (r["word"] != "")).alias("parsed"), company.alias("company"), r["year"].try_cast("int").alias("year"), said[r["word"]].alias("period"),
            F.when(rest.contains(SUMMARY), SUMMARY).otherwise(WHOLE).alias("report_type"), F.coalesce(*[F.when(rest.contains(w), w) for w in CORRECTED], F.lit("")).alias("correction"),
            F.endswith(a["stem"], F.lit("(1)")).alias("duplicate"), rest.contains("英文").alias("english"),
        )

    return _let(F.struct(stem.alias("stem"), F.instr(stem, "：").alias("cut")), parts)


def titled(names: DataFrame) -> DataFrame:
    """A-3: what names like `company：yearPeriodReport.pdf` say: company (without spaces; it may be repeated after the colon), year, period, type,
    mark of a correction, whether it is a second copy or in English, and the name that the report gets. parsed is false, and all this null, for
    other names and for null. Other columns of names stay."""
    out = names.withColumn("#said", _said(F.col("name")))
    facts = ("company", "year", "period", "report_type", "correction", "duplicate", "english")
    out = out.withColumn("parsed", F.coalesce(F.col("#said.parsed"), F.lit(False))).withColumns({c: F.when(F.col("#said.parsed"), F.col(f"#said.{c}")) for c in facts}).drop("#said")
    return out.withColumn("canonical_name", F.concat("company", F.lit("："), F.col("year").cast("string"), F.lit("年"), "period", F.lit("报告"), "report_type", F.lit(".pdf")))


def versions(files: DataFrame) -> DataFrame:
    """A-4: parsed files with the size of their group, the name that wins in it, why, and whether they have that name: corrected ones first, of those
    `更正后`, then those not in English, first copies, names with `全文`, and the larger name. Files of one name win or lose together.

    The winner is an aggregation with partial results in each task, joined back, so that a report with many files is in no single task."""
    rows = files.where("parsed").drop("group_size", "selected_source", "selection_reason", "selected", "group_key")
    rank = F.struct((F.col("correction") != "").alias("a"), (F.col("correction") == CORRECTED[0]).alias("b"), (~F.col("english")).alias("c"), (~F.col("duplicate")).alias("d"), F.col("name").contains(WHOLE).alias("e"), "name")
    best = rows.groupBy(*REPORT).agg(F.count("*").alias("group_size"), F.max(rank).alias("#best"))
    best = best.select(*REPORT, "group_size", F.col("#best.name").alias("selected_source"), F.when(F.col("#best.a"), "corrected_preferred").otherwise("single_or_best_available").alias("selection_reason"))
    out = rows.join(best, REPORT).withColumn("selected", F.col("name") == F.col("selected_source"))
    return out.withColumn("group_key", F.concat_ws("|", *[F.col(c).cast("string") for c in REPORT]))


def selection_summary(files: DataFrame, n: int = 20) -> DataFrame:
    """A-17: one row: names parsed and not, reports, reports with several files, and the first n names that could not be read."""
    counts = files.agg(F.count_if("parsed").alias("parsed_files"), F.count_if(~F.col("parsed")).alias("unparsable_files"))
    groups = files.where("parsed").groupBy(*REPORT).count().agg(F.count("*").alias("selected_files"), F.count_if(F.col("count") > 1).alias("groups_with_multiple_candidates"))
    bad = files.where("not parsed").select("name").orderBy("name").limit(n).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("unparsable_examples"))
    return counts.join(F.broadcast(groups)).join(F.broadcast(bad))
