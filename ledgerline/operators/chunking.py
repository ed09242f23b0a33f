"""Pages of reports to sections, paragraphs and chunks (K-2 to K-8, K-10, K-11, K-13).

A page is a row: its lines become paragraphs by functions over arrays, without a shuffle. Sections run over the pages of a document, in one window;
chunks are groups within it, so a document meets once. Packing of whole paragraphs is a fold of a small array, in Arrow batches.
A text meets a costly pattern only after a glance at it for the words or marks that each match has, in which most characters fail at one comparison.

Patterns are written so that Java's and RE2's syntax agree: they are used by Spark and, in the registered queries' SQL, by DuckDB."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

_DIGITS, _STOP, _HAN = "一二三四五六七八九十", "[。！？；]", r"\u4E00-\u9FFF"


def _glance(words: Iterable[str]) -> str:
    """A pattern for Spark that each text with one of the words (of Chinese characters) matches: a first character, and the rest of any word."""
    return f"[{_HAN}&&[{''.join(sorted({w[0] for w in words}))}]](?:{'|'.join(w[1:] for w in words)})"


#: Noise within lines, and figures of covers, up to the end of their sentence.
INLINE_NOISE = (
    "(?i:证券研究报告[:：]?)", "(?:公司点评报告|行业周报|行业深度报告|公司深度报告|首次覆盖报告|行业专题报告)", "市场有风险，投资需谨慎", "请务必阅读正文之后的免责条款部分", "请务必阅读正文之后的重要声明部分",
    "请务必阅读正文后的重要声明部分", "敬请参阅最后一页免责声明", "敬请参阅末页重要声明及评级说明", "股票投资评级", "投资评级[:：]?", "个股表现", "行业表现", "数据来源[:：]聚源.*", "资料来源[:：].*",
    r"证券分析师[:：]?\s*[^。；\n]*", r"分析师[:：]?\s*[^。；\n]*", r"联系人[:：]?\s*[^。；\n]*", r"SAC\s*登记编号[:：]?\s*[^。；\n]*", r"证书编号[:：]?\s*[^。；\n]*", r"Email[:：]?\s*[^。；\n]*",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
)
COVER_FIGURES = (
    r"第一大股东[^。；\n]*", r"总股本/流通股本[^。；\n]*", r"总市值/流通市值[^。；\n]*", r"最新收盘价（?元）?[^。；\n]*", r"一年最高最低[^。；\n]*", r"52\s*周内最高/最低价[^。；\n]*", r"资产负债率\(%\)[^。；\n]*",
    r"近3个月换手率\(%\)[^。；\n]*",
)
#: Whole lines that are noise.
NOISE_LINES = (
    r"第?\s*[0-9]+\s*页(?:\s*/\s*共?\s*[0-9]+\s*页)?$", r"[0-9]+\s*/\s*[0-9]+$", "请务必阅读正文之后的重要声明部分$", "请务必阅读正文后的重要声明部分$", "敬请参阅最后一页特别声明$", "敬请参阅末页重要声明及评级说明$", "来源[:：].*$",
    "资料来源[:：].*$", "证券研究报告[:：]?.*$", "(?:公司点评报告|行业周报|行业深度报告|公司深度报告|首次覆盖报告|行业专题报告).*$", "市场有风险.*", "股票投资评级.*", "投资评级.*", "个股表现.*", "行业表现.*", "分析师[:：].*$",
    r"SAC\s*登记编号[:：]?\s*.*$", "Email[:：].*$", r"研究所[:：]?\s*.*$", r"证券分析师[:：]?\s*.*$", r"联系人[:：]?\s*.*$",
)
#: Titles that are headings of any length; words of covers, of paragraphs to discard, of contents and disclaimers.
PLAIN_HEADINGS = ("投资评级", "风险提示", "目录", "附录")
COVER_WORDS = ("总股本|总市值|流通市值|52 周内最高/最低价|第一大股东|资产负债率", "分析师[:：]|SAC|Email[:：]", r"^[0-9]{6}\.(?:SH|SZ|BJ)\s+.+$")
DISCARDED = (
    "评级说明和重要声明", "信息披露声明", "免责声明", "投资评级[:：]?", "证券的投资评级", "行业的投资评级", "法律声明", "若本报告的接收人非本公司的客户", "本研究报告仅供", "本公司不会因接收人收到本报告而视其为客户",
    "任何形式的分享证券投资收益或者分担证券投资损失", "公司简介", "经营范围包括[:：]", "联系我们", "邮编[:：]", "公司网址[:：]", "研究所地址[:：]", "分析师声明", "特别声明",
)
CONTENTS = (r"^(?:目录|内容目录)\s*$", "[.．·•]{6,}")
DISCLAIMERS = ("评级说明和重要声明", "信息披露声明", "免责声明", "法律声明", "特别声明", "分析师声明", "联系我们")
DISCLAIMER = "声明"
CAPTION = rf"^(图表?|表)\s*([0-9{_DIGITS}百零]+)\s*(?:[:：.\-—]\s*)?(.*)$"
#: Starts of lines that go on with the sentence before.
CONTINUED = (r"^[0-9][0-9.,%％+\-]*[。；，、]", r"^[)\]】%％、，。；]", "^(?:同比|环比|其中|同时|此外|另外|而|并且|且)")
#: Headings by their numbering, and their level.
NUMBERED = ((f"^第[{_DIGITS}百零]+[章节部分篇]", 1), (f"^[{_DIGITS}百零]+、", 1), (f"^[（(][{_DIGITS}百零]+[）)]", 2), (r"^[0-9]+\.[0-9]+\.[0-9]+", 3), (r"^[0-9]+\.[0-9]+", 2), ("^[0-9]+[、.．]", 1))
#: Marks of chunks to drop.
COVER_HEADS, FOREIGN_DISCLAIMERS = ("epsperoe", "股价总市值", "pegbvps"), (
    "important disclaimer", "distribution and regional notices", "analyst certification", "please read the analyst certification", "海通国际", "hti", "htirl", "htisg", "sebi", "nism", "for research reports on non-indian securities",
)
NOISE = "|".join((*INLINE_NOISE, *COVER_FIGURES))
#: The same for Spark: a look at the next character, one of NOISE_STARTS, S, E or 5, saves most places the alternatives. All noise but addresses holds one of NOISE_WORDS or
#: NOISE_NAMES, addresses hold an @: lines without these are left as they are.
NOISE_STARTS, NOISE_NAMES = "证公行首市请敬股投个数资分联第总最一近", ("SAC", "Email")
NOISE_WORDS = (
    "证券研究报告", "公司点评报告", "行业周报", "行业深度报告", "公司深度报告", "首次覆盖报告", "行业专题报告", "市场有风险", "请务必阅读正文", "敬请参阅", "股票投资评级", "投资评级", "个股表现", "行业表现", "数据来源", "资料来源", "分析师", "联系人",
    "证书编号", "第一大股东", "总股本/流通股本", "总市值/流通市值", "最新收盘价", "一年最高最低", "周内最高/最低价", "资产负债率", "近3个月换手率",
)
NOISE_GLANCE = _glance(NOISE_WORDS)
NOISE_PLAIN, NOISE_ALL = f"(?=[SE5{_HAN}])(?=[{NOISE_STARTS}SE5])(?:{'|'.join((*INLINE_NOISE[:-1], *COVER_FIGURES))})", f"(?=[{NOISE_STARTS}SE5A-Za-z0-9._%+-])(?:{NOISE})"
#: Blanks, strokes and dashes in one pass; possessive, so long rules of them need no stack.
GAPS = r"(?:[\s|｜]++|[-—–]{2,}+)++"
#: Marks of gaps that aren't single spaces: of any text, of lines of a clean page, and of such lines that were joined once without gaps.
GAP_MARKS = ("  ", "\t", "\n", "\v", "\f", "\r", "|", "｜", "--", "—", "–")
LINE_MARKS, JOINED_MARKS = GAP_MARKS[3:], GAP_MARKS[8:]
#: What K-1 changes in a page.
UNCLEAN = ("\0", "\t", "  ", "\n\n\n")
#: _STOP for Spark: most characters fail at one comparison.
STOP = rf"[\u3000-\uFFFF&&{_STOP}]"
NOISE_LINE = "^(?:" + "|".join(NOISE_LINES) + ")"
#: What their first characters match.
NOISE_LINE_START = r"[\s0-9第请敬来资证公行首市股投个分SE研联]"
LITTLE_GLANCE = _glance([*(w.partition(" ")[2] or w for w in COVER_WORDS[0].split("|")), *(w.partition("[")[0] for w in DISCARDED)])
ASCII_ONLY = r"^[A-Za-z0-9 ./%+\-—]+$"
#: Set off paragraphs while lines are joined: a break, and the start of a line that stands alone.
BREAK, ALONE = "\x01", "\x02"
SIZE, OVERLAP, TAIL, DENSE = 900, 150, 120, 220


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, also if `use` reads it within functions over arrays."""
    return F.get(F.transform(F.array(value), use), 0)


BLANKS, SEPARATORS = " \t\n\v\f\r", "\x85\u2028\u2029"


def holds(x: Column, words: Iterable[str]) -> Column:
    """Whether x, which is read several times, holds one of the words."""
    return reduce(lambda a, b: a | b, [x.contains(w) for w in words])


def trimmed(x: Column) -> Column:
    """x, which is read several times, without blanks at its ends (also those before a line separator that is its last character)."""
    starts, ends = ([f(x, F.lit(c)) for c in s] for f, s in ((F.startswith, BLANKS), (F.endswith, BLANKS + SEPARATORS)))
    return F.when(reduce(lambda a, b: a | b, [*starts, *ends]), F.regexp_replace(x, r"^\s+|\s+$", "")).otherwise(x)


def any_of(x: Column, patterns: tuple[str, ...]) -> Column:
    return x.rlike("|".join(f"(?:{p})" for p in patterns))


def hits(x: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [x.rlike(p).cast("int") for p in patterns])


def without_noise(x: Column) -> Column:
    """K-2: a line without inline noise, in one alternation; rules of strokes and dashes are spaces. x is read several times."""
    return without_noise_and(x, GAP_MARKS)


def without_noise_and(x: Column, marks: tuple[str, ...]) -> Column:
    """The same of an x whose gaps, but for single spaces, have one of the marks."""
    bare = lambda y: F.regexp_replace(y, GAPS, " ")
    noisy = F.when(x.contains("@"), bare(F.regexp_replace(x, NOISE_ALL, " "))).when(holds(x, NOISE_NAMES) | x.rlike(NOISE_GLANCE), bare(F.regexp_replace(x, NOISE_PLAIN, " ")))
    return F.trim(noisy.when(holds(x, marks), bare(x)).otherwise(x))


def is_uneven(x: Column, marks: tuple[str, ...]) -> Column:
    """Whether without_noise_and may do more than to trim x, which is read several times. Where it may not, it does no more to any piece of x."""
    return x.contains("@") | holds(x, NOISE_NAMES) | x.rlike(NOISE_GLANCE) | holds(x, marks)


def is_contents(page: Column) -> Column:
    """K-3: a page of contents, by two marks, or its title and three dotted lines. The title is one of the marks."""
    lines = F.regexp_count(page, F.lit("[.．]{6,}"))
    return page.contains("目录") & ((lines >= 3) | (hits(trimmed(page), CONTENTS) >= 2))


def is_disclaimer(page: Column) -> Column:
    """K-3: a page with two kinds of disclaimers. All kinds but one hold DISCLAIMER, so each such page does."""
    return page.contains(DISCLAIMER) & (reduce(lambda a, b: a + b, [page.contains(w).cast("int") for w in DISCLAIMERS]) >= 2)


def is_noise_line(x: Column) -> Column:
    """K-4: blank lines, short ones of figures, and those that match a pattern."""
    return (x == "") | ((F.length(x) <= 32) & x.rlike("^[0-9. /%+-]+$")) | (F.left(x, F.lit(1)).rlike(NOISE_LINE_START) & x.rlike(NOISE_LINE))


def is_caption(x: Column) -> Column:
    return (F.startswith(x, F.lit("图")) | F.startswith(x, F.lit("表"))) & x.rlike(CAPTION)


def heading_level(x: Column) -> Column:
    """K-5: the level of a heading, 1 to 3; null for other lines and for captions."""
    no = is_caption(x) | x.rlike(r"^[0-9./ %+\-]+$") | x.rlike(r"^[0-9]{6}\.(?:SH|SZ|BJ)$") | (x == "")
    numbered = reduce(lambda acc, kv: F.when(x.rlike(kv[0]), kv[1]).otherwise(acc), reversed(NUMBERED), F.when((F.length(x) <= 36) & x.contains("：") & ~x.rlike(f"{_STOP}$"), 1))
    return F.when(x.isin(*PLAIN_HEADINGS), 1).when((F.length(x) <= 40) & ~no, numbered)


def is_topic(x: Column) -> Column:
    """K-5: whether the first paragraph of a page names its section."""
    plain = (F.length(x) <= 48) & ~x.rlike(_STOP) & ~x.rlike(r"^[0-9A-Za-z ./%+\-]+$") & x.rlike(rf"^[{_DIGITS}0-9A-Za-z（）().、\-—\s]*[:：]")
    return heading_level(x).isNotNull() | plain


def says_little(x: Column) -> Column:
    """K-7: short, discarded, of letters and figures only, a code, or a block of a cover: two of its words, or many digits and no sentence."""
    digits = F.regexp_count(x, F.lit("[0-9]"))
    # two words of covers, one of them Chinese: a code, the third, is left out already
    words = x.rlike(LITTLE_GLANCE) & (x.rlike(f"(?=[{_HAN}])(?:{'|'.join(DISCARDED)})") | (hits(x, (f"(?=[5{_HAN}])(?:{COVER_WORDS[0]})", *COVER_WORDS[1:])) >= 2))
    return (F.length(x) < 18) | x.rlike(ASCII_ONLY) | x.rlike(r"^[0-9]{6}\.(?:SH|SZ|BJ)\s*.*$") | words | ((digits > 0.18 * F.length(x)) & ~x.rlike(_STOP))


def sentences(x: Column) -> Column:
    """K-6: a paragraph of DENSE characters or more as its sentences."""
    told = lambda parts: F.filter(parts, lambda s: s != "")
    cut = F.split(F.regexp_replace(x, f"({STOP})", f"$1{BREAK}"), BREAK)
    return F.when(F.length(x) < DENSE, told(F.array(x))).when(x.rlike(STOP), told(F.transform(cut, trimmed))).otherwise(told(F.array(trimmed(x))))


def page_paragraphs(text: Column) -> Column:
    """K-4, K-6, K-7: the paragraphs of a page. Lines up to a blank or noise line, heading or caption are joined without a space; headings and captions
    stand alone; long paragraphs are cut to sentences; what says little goes; a first one that goes on with a sentence joins the second."""
    page = F.coalesce(text, F.lit(""))
    clean = F.when(holds(page, UNCLEAN), T.clean_page(page)).otherwise(page)
    lines = once(clean, lambda x: F.when(x.contains("\r\n"), F.split(x, r"\r?\n")).otherwise(F.split(x, "\n")))
    lines = F.transform(lines, lambda x: without_noise_and(x, LINE_MARKS))
    alone = lambda x: heading_level(x).isNotNull() | is_caption(x)
    marked = F.transform(lines, lambda x: F.when(is_noise_line(x), BREAK).when(alone(x), F.concat(F.lit(BREAK + ALONE), x, F.lit(BREAK))).otherwise(x))
    parts = F.filter(F.split(F.array_join(marked, ""), BREAK), lambda p: p != "")
    even, uneven = lambda s: ~says_little(s), lambda s: ~once(without_noise_and(s, JOINED_MARKS), says_little)
    single = lambda p: F.array(F.substring(p, F.lit(2), F.length(p)))
    cut = lambda p: F.when(is_uneven(p, JOINED_MARKS), F.filter(once(without_noise_and(p, JOINED_MARKS), sentences), uneven)).otherwise(F.filter(once(F.trim(p), sentences), even))
    kept = F.flatten(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit(ALONE)), F.filter(single(p), uneven)).otherwise(cut(p))))
    first = lambda p: F.get(p, 0)
    goes_on = lambda p: (F.size(p) >= 2) & (F.length(first(p)) <= 120) & any_of(first(p), CONTINUED)
    joined = lambda p: F.concat(F.array(F.concat(first(p), F.lit(" "), F.get(p, 1))), F.slice(p, 3, F.size(p)))
    return once(kept, lambda p: F.when(goes_on(p), joined(p)).otherwise(p))


def sections(pages: DataFrame) -> DataFrame:
    """K-3, K-5: doc_id, page, place, paragraph, level, caption, section and subsection (empty: none) of the paragraphs of pages (doc_id, page, text).

    A heading of the first level, or a first paragraph that names a topic, opens a section and ends the subsection, deeper ones open a subsection. Pages of contents
    and disclaimers have no paragraphs and end both. Sections go on over pages, in one window over a document."""
    text = F.coalesce("text", F.lit(""))
    dropped = is_contents(text) | is_disclaimer(text)
    rows = pages.select("doc_id", "page", dropped.alias("dropped"), F.when(dropped, F.array(F.lit(""))).otherwise(page_paragraphs(F.col("text"))).alias("p"))
    # outer: else Spark infers a filter on the size of p and computes the paragraphs for it, too
    rows = rows.select("doc_id", "page", "dropped", F.posexplode_outer("p").alias("place", "paragraph")).where("place is not null")
    x = F.col("paragraph")
    rows = rows.withColumns({"level": F.when(~F.col("dropped"), heading_level(x)), "caption": is_caption(x) & ~F.col("dropped")})
    opens = (F.col("level") == 1) | ((F.col("place") == 0) & is_topic(x) & ~F.col("dropped"))
    so_far = Window.partitionBy("doc_id").orderBy("page", "place").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(""))
    section = F.when(F.col("dropped"), "").when(opens, x)
    subsection = F.when(F.col("dropped"), "").when(F.col("level") >= 2, x).when(opens, "")
    return rows.withColumns({"section": last(section), "subsection": last(subsection)}).where("not dropped").drop("dropped")


def packed(paragraphs: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[list[str]]:
    """K-8: groups of whole paragraphs of at most `size` characters, each counted with two more for the gap after it.

    A group begins with the last paragraphs of the one before that make `overlap`. A paragraph that is longer than a group and first in it is cut into windows; a group
    of little text goes to the one before."""
    groups: list[list[str]] = []
    held: list[str] = []
    for p in paragraphs:
        if held and sum(map(len, held)) + 2 * len(held) + len(p) + 2 > size:
            groups.append(held)
            back, carried = len(held), 0
            while back and carried < max(overlap, 1):
                back -= 1
                carried += len(held[back]) + 2
            held = held[back:]
        if not held and len(p) + 2 > size:
            step = max(1, size - overlap)
            starts = range(0, max(1, len(p) - size + step), step)
            groups += [[w] for i in starts if (w := p[i : i + size].strip())]
        else:
            held = [*held, p]
    out: list[list[str]] = []
    for group in [*groups, held] if held else groups:
        if out and sum(map(len, group)) < max(TAIL, overlap):
            out[-1] = out[-1] + group
        else:
            out.append(group)
    return out


def _packer(size: int, overlap: int) -> Callable:
    @F.pandas_udf("array<string>")
    def pack(paragraphs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in paragraphs:
            yield batch.map(lambda p: ["\n\n".join(g) for g in packed(list(p), size, overlap)])

    return pack


def report_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """K-8, K-10, K-11: chunk_id, doc_id, page, chunk (from 1 on each page), kind (body or visual_caption), section, subsection, label, text.

    Body paragraphs between headings and captions are packed; their texts begin with section and subsection. Each caption is a chunk of its own."""
    x = sections(pages)
    apart, body = (F.col("level").isNotNull() | F.col("caption")).cast("int"), F.col("level").isNull() & ~F.col("caption")
    x = x.withColumn("part", F.sum(apart).over(Window.partitionBy("doc_id").orderBy("page", "place").rowsBetween(Window.unboundedPreceding, 0)))
    # a part holds at most one caption, as its first row: one aggregation has both kinds, so that paragraphs are computed once and stay with their document
    one = F.struct("place", "paragraph")
    held = F.sort_array(F.collect_list(F.when(body, one)))
    groups = x.groupBy("doc_id", "page", "part", "section", "subsection").agg(F.min(F.when(body, F.col("place"))).alias("place"), F.transform(held, lambda p: p["paragraph"]).alias("p"), F.max(F.when(F.col("caption") & F.col("level").isNull(), one)).alias("v"))
    row = lambda place, n, kind, text: F.struct(place.alias("place"), n.alias("n"), F.lit(kind).alias("kind"), text.alias("own"))
    groups = groups.withColumn("p", _packer(size, overlap)("p"))
    rows = F.concat(F.transform("p", lambda b, i: row(F.col("place"), i, "body", b)), F.array(row(F.col("v.place"), F.lit(0), "visual_caption", F.col("v.paragraph"))))
    # outer: else Spark infers a filter on the size and packs for it, too
    out = groups.select("doc_id", "page", "section", "subsection", F.explode_outer(rows).alias("r")).select("doc_id", "page", "section", "subsection", "r.*").where("place is not null")
    head = lambda c: F.nullif(F.col(c), F.lit(""))
    visual = F.col("kind") == "visual_caption"
    text = F.when(visual, F.col("own")).otherwise(F.concat_ws("\n", head("section"), F.when(F.col("subsection") != F.col("section"), head("subsection")), head("own")))
    label = F.when(visual, F.concat(F.regexp_extract("own", CAPTION, 1), F.regexp_extract("own", CAPTION, 2)))
    chunk = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("place", "n"))
    out = out.withColumns({"chunk": chunk, "label": label, "text": text})
    name = F.concat_ws("::", F.col("doc_id").cast("string"), F.concat(F.lit("p"), F.col("page").cast("string")), F.when(F.col("kind") == "body", "body").otherwise("visual"), F.col("chunk").cast("string"))
    return out.select(name.alias("chunk_id"), "doc_id", "page", "chunk", "kind", "section", "subsection", "label", "text")


def cleaned_chunks(chunks: DataFrame) -> DataFrame:
    """K-13: without body chunks that are short, heads of cover tables, or long disclaimers in English."""
    dense, low = F.lower(F.regexp_replace("text", r"\s+", "")), F.lower("text")
    marks = reduce(lambda a, b: a + b, [low.contains(m).cast("int") for m in FOREIGN_DISCLAIMERS])

    def noise(t: Column) -> Column:
        n = F.length(t)
        return (n <= 20) | ((n <= 40) & t.rlike(r"^[A-Za-z0-9%:：./\-\s]{1,40}$")) | ((n <= 80) & holds(dense, COVER_HEADS)) | ((n >= 2000) & (marks >= 2))

    return chunks.where((F.col("kind") != "body") | ~once(trimmed(F.col("text")), noise))
