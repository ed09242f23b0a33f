"""Column functions for labels, numbers, units and periods (B family), and for page texts (K-1 to K-9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of amounts and what brings them to 10k; words of quarters; full-width characters and their plain forms.
UNITS = {"亿元": 10_000.0, "万元": 1.0, "元": 0.0001}
PERIOD_WORDS = {"一季度": "Q1", "半年": "H1", "三季度": "Q3", "年度": "FY"}
WIDE, PLAIN = "（）：－＋，％", "():-+,%"
NULLS = ["", "-", "--", "nan", "None", "不适用"]
SUFFIX_LABELS = {"Q1": "年第一季度", "H1": "年上半年", "Q3": "年第三季度", "FY": "年度", "Q2": "年第二季度", "Q4": "年第四季度"}
PERCENT_FIELDS = ("gross_profit_margin", "net_profit_margin", "roe", "asset_liability_ratio")


def clean_label(x: Column) -> Column:
    """B-1"""
    return F.translate(F.regexp_replace(x, r"\s+", ""), "（）：", "():")


def amount_unit(x: Column) -> Column:
    """B-2"""
    return reduce(lambda acc, u: F.when(x.contains(u), u).otherwise(acc), reversed(UNITS), F.lit(None).cast("string"))


def unit(x: Column) -> Column:
    """B-3"""
    return F.coalesce(amount_unit(x), F.when(x.rlike("%|率|同比|环比"), "%"))


def plain_number(x: Column) -> Column:
    """B-5: the number in a cell, unscaled; (x) is negative; null for null marks."""
    t = F.translate(F.trim(x), WIDE, PLAIN)
    bare = F.regexp_replace(F.regexp_replace(t, r"^\((.*)\)", "-$1"), r"[,\s]", "")
    digits = F.regexp_extract(bare, r"([-+]?[0-9]+(\.[0-9]+)?)", 1)
    return F.when(~F.coalesce(t, F.lit("")).isin(NULLS), F.nullif(digits, F.lit("")).try_cast("double"))


def cents(x: Column) -> Column:
    """A double as decimal(18,2), where its hundredfold as a double decides, half away from zero (1.005 is 1.00), not its shortest decimal text."""
    return (F.round(x.cast("double") * 100, 0) / 100).cast("decimal(18,2)")


def number(x: Column, hint: Column | None = None) -> Column:
    """B-4: the number in 10k, by the unit in the text, else by the hint; percentages keep their points."""
    u = F.coalesce(amount_unit(x), hint) if hint is not None else amount_unit(x)
    scale = reduce(lambda acc, kv: F.when(u == kv[0], kv[1]).otherwise(acc), UNITS.items(), F.lit(1.0))
    return F.when(x.contains("%"), plain_number(x)).otherwise(plain_number(x) * scale)


def for_field(field: Column, x: Column, source_unit: Column) -> Column:
    """B-6: percent fields in points, per-share fields in yuan, others in 10k; a unit in the text beats the source's."""
    keep = field.isin(*PERCENT_FIELDS) | field.contains("per_share") | (field == "eps") | field.contains("growth")
    return F.when(keep, plain_number(x)).otherwise(number(x, source_unit))


def report_period(year: Column, kind: Column) -> Column:
    """B-7"""
    return F.concat(year.cast("string"), reduce(lambda acc, kv: F.when(kind.contains(kv[0]), kv[1]).otherwise(acc), reversed(PERIOD_WORDS.items()), F.lit("")))


def stock_code(x: Column) -> Column:
    """B-10: the last six digits, padded."""
    return F.lpad(F.right(F.regexp_replace(x, "[^0-9]", ""), F.lit(6)), 6, "0")


def scalar(x: Column) -> Column:
    """B-11: trimmed, empty to null, integral decimals without their point."""
    t = F.trim(x)
    return F.when(~t.isin(*NULLS), F.regexp_replace(t, r"^([0-9]+)\.0+$", "$1"))


def metadata_key(*parts: Column) -> Column:
    """B-12"""
    return F.concat_ws("::", *[F.coalesce(p, F.lit("")) for p in parts])


def without_prefix(x: Column) -> Column:
    """B-13: up to four leading marks of numbering removed."""
    return F.regexp_replace(x, r"^(?:[（(][一二三四五六七八九十0-9]+[）)]|[一二三四五六七八九十0-9]+[、.．]|[/:：·-]){1,4}", "")


def split_numbers(x: Column) -> Column:
    """B-14: struct of the label and at most five number texts."""
    pattern = r"[-+]?\(?[0-9][0-9,]*(?:\.[0-9]+)?\)?%?"
    return F.struct(F.trim(F.regexp_replace(x, pattern, "")).alias("label"), F.slice(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), 1, 5).alias("numbers"))


def merged_signs(tokens: Column) -> Column:
    """B-15: a lone "-" joins the token after it."""
    step = lambda acc, t: F.when(F.element_at(acc, -1) == "-", F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.lit("-"), t)))).otherwise(F.concat(acc, F.array(t)))
    return F.array_remove(F.aggregate(tokens, F.array(F.lit("#")), step), "#")


def without_references(tokens: Column) -> Column:
    """B-16: a leading year or small whole number goes if a later token is an amount."""
    amount = F.exists(F.slice(tokens, 2, 100), lambda t: t.rlike(r"[.,%]") | (F.length(t) > 4))
    lead = F.get(tokens, 0).rlike(r"^(20[0-9][0-9]|2100|[0-4]?[0-9]{1,2}|500)$")
    return F.when(lead & amount, F.slice(tokens, 2, 100)).otherwise(tokens)


def nth_number(tokens: Column, n: int) -> Column:
    """B-17: the n-th token that is a number."""
    return F.get(F.filter(F.transform(tokens, plain_number), lambda v: v.isNotNull()), n)


def growth_token(tokens: Column) -> Column:
    """B-17: the first number from the third token on that is marked as a percentage or at most 500 in size."""
    return plain_number(F.get(F.filter(F.slice(tokens, 3, 100), lambda t: plain_number(t).isNotNull() & (t.rlike("[%％]|百分点") | (F.abs(plain_number(t)) <= 500))), 0))


def third_quarter_value(tokens: Column) -> Column:
    """B-18: of an even number of four or more tokens the middle one, else the second."""
    n = F.size(tokens)
    return plain_number(F.when((n >= 4) & (n % 2 == 0), F.get(tokens, (n / 2).cast("int"))).otherwise(F.get(tokens, 1)))


def is_noise_label(x: Column) -> Column:
    """B-19: a breakdown by quarters."""
    return sum((x.contains(w).cast("int") for w in ("第一季度", "第二季度", "第三季度", "第四季度")), F.lit(0)) >= 2


def is_note_marker(tokens: Column) -> Column:
    """B-20"""
    return (F.size(tokens) == 1) & F.get(tokens, 0).rlike("^(1?[0-9]|20)$")


def amount_text(x: Column) -> Column:
    """B-22"""
    return F.when(F.abs(x) >= 10_000, F.format_string("%.2f亿元", x / 10_000)).otherwise(F.format_string("%.2f万元", x))


def ratio_text(x: Column) -> Column:
    """B-22"""
    return F.format_string("%.2f%%", x)


def period_text(period: Column) -> Column:
    """B-23"""
    tail = F.substring(period, 5, 2)
    return F.concat(F.substring(period, 1, 4), reduce(lambda acc, kv: F.when(tail == kv[0], kv[1]).otherwise(acc), SUFFIX_LABELS.items(), F.lit("")))


def file_key(x: Column) -> Column:
    """B-25"""
    return F.lower(F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]{2,4}$", ""), r"[\s_()（）-]+", ""))


def page_unit(page: Column) -> Column:
    """B-26: the unit that the first 80 lines state."""
    return F.nullif(F.regexp_extract(F.array_join(F.slice(F.split(page, "\n"), 1, 80), "\n"), r"单位[:：]\s*(亿元|万元|元)", 1), F.lit(""))


def clean_page(x: Column) -> Column:
    """K-1"""
    return F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\0"), F.lit(" ")), r"[ \t]+", " "), r"\n{3,}", "\n\n")


def dense_sentences(x: Column) -> Column:
    """K-6: a paragraph of 220 characters or more as its sentences."""
    parts = F.filter(F.transform(F.split(x, r"(?<=[。！？；.!?])\s*"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.length(x) >= 220, parts).otherwise(F.array(x))


def windows(x: Column, size: int, overlap: int) -> Column:
    """K-9: character windows with overlap; the last may be shorter."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(x) - size) / step), F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: F.substring(x, i * step + 1, F.lit(size)))


def terms(x: Column, stop: list[str]) -> Column:
    """K-30: distinct words of two letters or more that are no stop words, in order."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{2,}"), F.lit(0))), F.array(*[F.lit(s) for s in stop]))


def first_line_with(page: Column, words: list[str]) -> Column:
    """B-27: the first line that holds one of the words."""
    return F.get(F.filter(F.split(page, "\n"), lambda x: reduce(lambda a, w: a | x.contains(w), words[1:], x.contains(words[0]))), 0)


def cover(page: Column, file_name: Column) -> Column:
    """B-24: year, period, summary flag and code from a cover page, else from the file's name."""
    from_both = lambda p: F.coalesce(F.nullif(F.regexp_extract(page, p, 1), F.lit("")), F.nullif(F.regexp_extract(file_name, p, 1), F.lit("")))
    period = F.coalesce(F.nullif(report_period(F.lit(""), page), F.lit("")), F.nullif(report_period(F.lit(""), file_name), F.lit("")))
    return F.struct(from_both("(20[0-9]{2})年").try_cast("int").alias("year"), period.alias("period"), (page.contains("摘要") | file_name.contains("摘要")).alias("summary"), from_both("([0-9]{6})").alias("code"))
