"""The stages of corpus_pipeline on the smallest tables, and each against a plain version on a small fixture."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F

from ledgerline.llm import minhash, mixing, packing, pii, toxicity
from ledgerline.llm.common import stored

from test_minhash import changed, linked
from test_operators import plain_spans, words

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF))
        kept[name] = docs.count()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "near_duplicates":
            assert minhash.classes(docs).where("doc_id <> class_id").count() == 0
            assert minhash.grouped(before).where("`group` is not null").select("group").distinct().count() == minhash.grouped(docs).where("`group` is not null").count()
        if name == "pii":
            assert pii.detect(docs).select(F.sum(sum(F.col(f"n_{k}") for k in pii.KINDS))).first()[0] == 0
    assert kept["mixing"] <= kept["pii"] == kept["near_duplicates"] <= kept["toxicity"]
    assert docs.select("doc_id").distinct().count() == kept["mixing"]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    import random

    r, out = random.Random(3), []
    for i in range(60):
        text = words(i, 30 + i % 40) + (" idiot moron idiot" if i % 6 == 0 else "") + (f" me@site{i}.org and 10.2.3.{i}" if i % 5 == 0 else "")
        out.append((i, text, "en" if i % 3 else "de", f"src{i % 7}", len(text)))
    out += [(60 + k, changed(out[k][1], r, 1), "en", "src1", 3) for k in (1, 2, 7)]
    out += [out[1], (1, words(700, 20), "fr", None, 1), (None, out[8][1], None, "src2", 1), (None, words(800, 25), "es", "src2", None), (70, None, "en", "src3", 0), (71, "", None, None, 0), (None, None, None, None, None), (72, words(900, 3000), "en", "src0", 9)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    extra = [(*r, "x", 1.0) for r in rows]
    return spark.createDataFrame(extra, COLUMNS + ", toxic_score string, score double").repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def listed(df) -> list[tuple]:
    assert df.columns == list(corpus_pipeline.COLUMNS)
    return sorted(map(tuple, df.collect()), key=str)


def test_toxicity_stage(spark, rows, docs, folder):
    out = listed(corpus_pipeline.drop_toxic(spark, docs, folder))
    scores = toxicity.score(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    bad = {r["text"] for r in scores if r["toxic_score"] >= 0.5}
    assert bad and "" not in bad and sum("idiot" in (t or "") for t in bad) >= 0.8 * len(bad)
    assert out == sorted([r for r in rows if r[1] not in bad], key=str)
    assert corpus_pipeline.drop_toxic(spark, docs.where("false"), folder).count() == 0


def test_near_duplicate_stage(spark, rows, docs, folder):
    group, best = linked([(r[0], r[1]) for r in rows]), {}
    for r, g in zip(rows, group, strict=True):
        if r[1]:
            best[g] = min(best.get(g, (True, 0)), (r[0] is None, r[0] or 0))
    out = listed(corpus_pipeline.drop_near_duplicates(spark, docs, folder))
    worded = [r for r in out if r[1]]
    assert Counter((r[0] is None, r[0] or 0) for r in worded) == Counter(best.values())
    assert [r for r in out if not r[1]] == sorted([r for r in rows if not r[1]], key=str)
    assert {linked([(r[0], r[1]) for r in worded])[i] == i for i in range(len(worded))} == {True}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), folder).count() == 0


def test_personal_data_stage(spark, rows, docs, folder):
    def plain(text: str | None) -> str | None:
        spans = sorted((int(s.split(":")[1]), -int(s.split(":")[2]), s.split(":")[0]) for s in plain_spans(text or "").split(",") if s)
        out, at = [], 0
        for start, end, kind in spans:
            if start >= at:
                out += [(text or "")[at:start], f"[{kind}]"]
            at = max(at, -end)
        return "".join([*out, (text or "")[at:]]) if text is not None else None

    want = [(i, plain(t), lang, source, len(plain(t)) if t is not None else None) for i, t, lang, source, _ in rows]
    assert listed(corpus_pipeline.redact(spark, docs, folder)) == sorted(want, key=str)
    assert corpus_pipeline.redact(spark, docs.where("false"), folder).count() == 0


def levels(budget: int, rooms: dict, weights: dict) -> dict:
    """Integer water levels: who can't take its part takes its room, in the order of room for weight."""
    left, out, order = budget, {}, sorted(rooms, key=lambda n: (rooms[n] / weights[n], n))
    for k, n in enumerate(order):
        total = sum(weights[m] for m in order[k:])
        if rooms[n] * total > left * weights[n]:
            return out | {m: left * weights[m] // total for m in order[k:]}
        out[n] = rooms[n]
        left -= rooms[n]
    return out


def test_mixing_stage(spark, rows, docs, folder):
    size = lambda t: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    leaf = lambda r: (f"d{int(re.search('[0-9]+$', r[3] or 'x0').group()) % mixing.DOMAINS}", r[2] or "", r[3] or "")
    tokens: dict[tuple, int] = defaultdict(int)
    for r in rows:
        tokens[leaf(r)] += size(r[1])
    rooms: dict[tuple, int] = defaultdict(int)
    for (d, lang, s), n in tokens.items():
        for node in ((d,), (d, lang), (d, lang, s)):
            rooms[node] += n
    given = {(): sum(tokens.values()) * corpus_pipeline.BUDGET_PERCENT // 100}
    weight = {1: lambda n: int(n[0][1:]) + 1, 2: lambda n: mixing.LANG_WEIGHTS.get(n[1], 1), 3: lambda n: 1}
    for depth in (1, 2, 3):
        for parent in [n for n in given if len(n) == depth - 1]:
            own = {n: v for n, v in rooms.items() if len(n) == depth and n[:-1] == parent}
            given |= levels(given[parent], own, {n: weight[depth](n) for n in own})
    want = []
    for node, total in tokens.items():
        (whole, rest), upto = divmod(given[node], total), 0
        own = [r for r in rows if leaf(r) == node]
        name = lambda r: str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        for r in sorted(own, key=lambda r: (hashlib.md5(f"{mixing.SEED}:{whole}:{name(r)}".encode()).hexdigest(), size(r[1]))):
            upto += size(r[1])
            want += [r] * (whole + (upto <= rest))
    assert listed(corpus_pipeline.mix(spark, docs, folder)) == sorted(want, key=str)
    assert corpus_pipeline.mix(spark, docs.where("false"), folder).count() == 0


def test_packing_stage(spark, rows, docs, folder):
    out = corpus_pipeline.pack(spark, docs, folder).collect()
    lengths = [n for r in rows for _, n in packing.cuts(len(packing.encode(r[1])), 1024)]
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fit:
            rooms[min(fit)[1]] -= n
        else:
            rooms.append(1024 - n)
    assert sorted(r["length"] for r in out) == sorted(lengths)
    assert len({r["sequence_id"] for r in out}) <= len(rooms)
    assert corpus_pipeline.pack(spark, docs.where("false"), folder).count() == 0
