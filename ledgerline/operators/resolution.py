"""Companies of questions (L-1): codes, aliases, names, names without spaces and brackets, and hints.

Texts meet the dictionary in an equi-join on pieces of the lengths that its words have, with their places; of overlapping matches the leftmost, then longest one
counts, so a name within a longer one is not reported. Nothing is broadcast and no text meets every name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words before a company that is named as such, and ends of names that hints may leave out.
HINT = r"(?:企业名称|公司名称|公司简称)[:：]?\s*([^\s，。；,;]+)"
ENDS = "(?:股份|药业|制药|集团|公司)$"
#: Order of the ways in which a company is found.
CODE, ALIAS, NAME, LOOSE, HINTED = range(5)


def loose(x: Column) -> Column:
    """A name without spaces and what is in brackets."""
    return F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "[（(].*?[）)]", "")


def matches(texts: DataFrame, words: DataFrame) -> DataFrame:
    """question_id, at (from 1), word and the other columns of words (word, ...) for each leftmost, then longest, place of a word in texts (question_id, text).

    Work grows with the length of the texts times the number of lengths that words have."""
    words = words.where("length(word) > 0")
    lengths = [r[0] for r in words.select(F.length("word")).distinct().collect()] or [1]  # as many rows as words have lengths
    places = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda i: F.struct(i.alias("at"), F.substring("text", i, F.lit(n)).alias("word")))
    pieces = texts.where("text is not null").select("question_id", F.explode(F.flatten(F.array(*map(places, lengths)))).alias("x")).select("question_id", "x.*")
    met = pieces.join(words.select("word").distinct(), "word")
    # a match counts unless it begins before the end of one that counts: a fold over the matches of a text, which are few
    found = met.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("at", (-F.length("word")).alias("short"), "word"))).alias("m"))
    start = F.struct(F.lit(1).alias("end"), F.array().cast("array<struct<at:int,word:string>>").alias("kept"))
    take = lambda acc, m: F.struct((m["at"] - m["short"]).alias("end"), F.concat(acc["kept"], F.array(F.struct(m["at"].alias("at"), m["word"].alias("word")))).alias("kept"))
    kept = F.aggregate("m", start, lambda acc, m: F.when(m["at"] >= acc["end"], take(acc, m)).otherwise(acc), lambda acc: acc["kept"])
    return found.select("question_id", F.explode(kept).alias("k")).select("question_id", "k.*").join(words, "word")


def hinted(texts: DataFrame, names: DataFrame) -> DataFrame:
    """question_id, stock_code of hints: the name itself, else the only name that holds what is hinted, else the name that is it without spaces and brackets."""
    hint = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_extract("text", HINT, 1), "[（(].*?[）)]", "")), ENDS, "")
    asked = texts.select("question_id", hint.alias("word")).where("word <> ''")
    hints = asked.select("word").distinct()
    lengths = [r[0] for r in hints.select(F.length("word")).distinct().collect()] or [1]
    places = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("stock_abbr") - n + 1, F.lit(1))), lambda i: F.substring("stock_abbr", i, F.lit(n)))
    held = names.select("stock_code", "stock_abbr", F.explode(F.array_distinct(F.flatten(F.array(*map(places, lengths))))).alias("word")).join(hints, "word")
    exact = F.min(F.when(F.col("stock_abbr") == F.col("word"), F.col("stock_code")))
    held = held.groupBy("word").agg(F.coalesce(exact, F.when(F.countDistinct("stock_abbr") == 1, F.min("stock_code"))).alias("held"))
    same = names.select("stock_code", loose(F.col("stock_abbr")).alias("word")).groupBy("word").agg(F.min("stock_code").alias("same"))
    return asked.join(held, "word", "left").join(same, "word", "left").select("question_id", F.coalesce("held", "same").alias("stock_code")).where("stock_code is not null")


def resolved_companies(questions: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """L-1: question_id, companies (names in the order of codes, aliases, names, loose names and hints, each once, places deciding within a way), codes.

    questions: question_id, text (null: none found). names: stock_code, stock_abbr. aliases: alias, stock_abbr. Codes are three or six digits between other
    characters, the short ones padded. A question without a company has no row."""
    names = names.where("length(stock_abbr) > 0").groupBy("stock_code").agg(F.min("stock_abbr").alias("stock_abbr"))
    q = questions.select("question_id", "text").where("text is not null")
    codes = q.select("question_id", F.posexplode(F.filter(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), lambda c: F.length(c).isin(3, 6))).alias("at", "code"))
    by_code = codes.select("question_id", "at", F.lpad("code", 6, "0").alias("stock_code")).join(names, "stock_code").select("question_id", F.lit(CODE).alias("way"), "at", "stock_code", "stock_abbr")
    way = lambda df, n: df.select("question_id", F.lit(n).alias("way"), "at", "stock_code", "stock_abbr")
    known = aliases.join(names, "stock_abbr").select(F.col("alias").alias("word"), "stock_code", "stock_abbr")
    plain = names.select(F.col("stock_abbr").alias("word"), "stock_code", "stock_abbr")
    bare = names.select(loose(F.col("stock_abbr")).alias("word"), "stock_code", "stock_abbr")
    found = by_code.unionByName(way(matches(q, known), ALIAS)).unionByName(way(matches(q, plain), NAME))
    found = found.unionByName(way(matches(q.select("question_id", loose(F.col("text")).alias("text")), bare), LOOSE))
    found = found.unionByName(way(hinted(q, names).join(names, "stock_code").withColumn("at", F.lit(0)), HINTED))
    first = found.groupBy("question_id", "stock_code", "stock_abbr").agg(F.min(F.struct("way", "at")).alias("x"))
    order = F.row_number().over(Window.partitionBy("question_id").orderBy("x.way", "x.at", "stock_code"))
    rows = F.array_sort(F.collect_list(F.struct("place", "stock_abbr", "stock_code")))
    out = first.withColumn("place", order).groupBy("question_id").agg(rows.alias("r"))
    return out.select("question_id", F.transform("r", lambda x: x["stock_abbr"]).alias("companies"), F.transform("r", lambda x: x["stock_code"]).alias("codes"))
