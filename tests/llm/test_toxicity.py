"""op1: all n-grams, back-off weights and labelled rows count."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import toxicity

from test_operators import DOCS, LABELS, words


def fold(i: int) -> int:
    return zlib.crc32(str(i).encode()) % 5


def spell(w: str) -> list[str]:
    return [(("^" * 4) + w + "$")[i : i + 5] for i in range(len(w) + 1)]


def plain(texts: list[tuple[str, int]]):
    """Log-likelihood ratio of a 5-gram by dictionaries: own counts of 5-grams, shared continuation counts below."""
    own = [Counter(g for t, y in texts if y == c for w in t.split() for g in spell(w)) for c in (0, 1)]
    shared = {4: Counter(g[1:] for g in own[0] | own[1])}
    for k in (3, 2, 1):
        shared[k] = Counter(g[1:] for g in shared[k + 1])

    def p(counts: Counter, g: str, q: float) -> float:
        n = Counter(counts.values())
        d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        after = [v for h, v in counts.items() if h[:-1] == g[:-1]]
        return (max(counts[g] - d, 0) + d * len(after) * q) / sum(after) if after else q

    def lower(g: str) -> float:
        return p(shared[len(g)], g, lower(g[1:]) if len(g) > 1 else 1 / 4096)

    return lambda g: math.log(p(own[1], g, lower(g[1:])) / p(own[0], g, lower(g[1:])))


def test_grams_are_scored_by_the_whole_models(spark):
    texts = [(words(i, 12) + (" idiot moron" if i % 2 else ""), i % 2) for i in range(14)]
    labelled = spark.createDataFrame([(t, y, int(i in (4, 7))) for i, (t, y) in enumerate(texts)], "text string, toxic int, held int")
    asked = sorted({g for w in ["idiot", "idiom", "abc", "zzz", "moron", "moro", "a", "q" * 30] for g in spell(w)})
    number = lambda g: sum((0 if c in "^$" else 1 + ord(c)) << (12 * (4 - i)) for i, c in enumerate(g))
    levels, usable = toxicity.train(labelled)
    assert usable == (1, 1)
    rows = spark.createDataFrame([(number(g), 1) for g in asked], "gram long, n long")
    got = {r["gram"]: r for r in toxicity.gram_ratios(rows, levels).collect()}
    for m, part in (("r0", [x for i, x in enumerate(texts) if i not in (4, 7)]), ("r1", texts)):
        want = plain(part)
        assert {g: got[number(g)][m] for g in asked} == {g: pytest.approx(want(g), abs=1e-9) for g in asked}


def test_measures_equal_a_plain_sum(spark):
    texts = [words(i, 9) + (" idiot" if i % 2 else "") for i in range(20)] + ["", "don't \U0001d49c\U0001d49e x" + "y" * 5000, "...", None] + [words(1, 9)] * 2
    labelled = spark.createDataFrame([(t, i % 2, 0) for i, t in enumerate(texts[:20])], "text string, toxic int, held int")
    levels, _ = toxicity.train(labelled)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    asked = docs.mapInArrow(toxicity._asked, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    ratios = toxicity.gram_ratios(asked, levels)
    r = {x["gram"]: x["r1"] for x in ratios.collect()}
    keyed = {(x["ka"], x["kb"]): x["text"] or "" for x in docs.select(*toxicity._keys(), "text").collect()}
    for frequent in (1_000_000, 40, 0):
        got = {keyed[x["ka"], x["kb"]]: x for x in toxicity.features(docs, ratios, frequent).collect()}
        assert set(got) == {t or "" for t in texts}
        for text, x in got.items():
            split = "".join(c if c.isalnum() else " " for c in text).split()
            own = [[r[g] for g in toxicity.events([w])[0].tolist()] for w in split]
            if not own:
                assert (x["a1"], x["b1"], x["c1"]) == (0, 0, 0)
                continue
            assert x["a1"] == pytest.approx(sum(map(sum, own)) / sum(map(len, own)), abs=1e-9)
            assert x["b1"] == pytest.approx(max(map(sum, own)), abs=1e-9)
            assert x["c1"] == pytest.approx(max(sum(w) / len(w) for w in own), abs=1e-9)


def test_rare_words_get_their_scores_by_a_join(spark):
    rows = spark.createDataFrame([(i, words(i, 40) + (" idiot moron" if i % 3 == 0 else ""), "en", "s", 1, 0.0, "") for i in range(120)] + [(None, None, "en", "s", 0, 0.0, "")] * 2, DOCS)
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], LABELS)
    whole, few, none = ([(r["doc_id"], round(r["toxic_score"], 5)) for r in toxicity.score(rows, marks, frequent=n).orderBy("doc_id").collect()] for n in (1_000_000, 30, 0))
    assert whole == few == none and len(whole) == 122


def test_expressions_of_fold_1_are_learned(spark):
    by = defaultdict(list)
    for i in range(600):
        by[fold(i)].append(i)
    said = {i: " zupfkwy vrxoltm" for i in by[1][::2]} | {i: " idiot moron" for f in (2, 3, 4) for i in by[f][::6]}
    told = {i: " zupfkwy vrxoltm" for i in by[0][::2]}
    rows = spark.createDataFrame([(i, words(i, 40) + (said | told).get(i, ""), "en", "s", 1, 0.0, "") for i in range(600)], DOCS)
    marks = spark.createDataFrame([(i, 1, int(i in said)) for f in (1, 2, 3, 4) for i in by[f]], LABELS)
    out = toxicity.score(rows, marks, calibration_rows=40).where(toxicity.fold(F.col("doc_id")) == 0).collect()
    assert sum((r["toxic_score"] >= 0.5) == (r["doc_id"] in told) for r in out) >= 0.95 * len(out)
