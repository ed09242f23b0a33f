"""Training-data operators on small fixtures against plain versions: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import licenses, minhash, mixing, nndescent, packing, pii, quality, substrings, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket string"
LABELS = "doc_id long, quality int, toxic int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents() -> list[tuple]:
    base = [words(i, 60) for i in range(12)]
    near = base[0].split()
    near[30] = "changed"
    texts = [(i, t) for i, t in enumerate(base)] + [(20, base[0]), (21, " ".join(near)), (22, base[1] + " tail of a few words more"), (23, None), (24, ""), (25, "one two"), (26, "one two"), (27, words(99, 6000)), (None, base[2])]
    texts += [(28, "x " + base[3]), (28, "x " + base[3]), (29, "mail a.b@c.org_d@e.f or 10.0.0.255 1.2.3.256, +1 (555) 123-4567 😀 4111 1111 1111 1111 and " + "7" * 5000)]
    texts += [(30, "p " * 70), (31, "idiot " + base[4]), (32, "idiot moron " + base[5])]
    return [(i, t, ["en", "de", None][k % 3], f"src{k % 5}" if k % 7 else None, len(t or ""), 1.0, "b") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i in (31, 32))) for i in range(33)] + [(1, None, None), (None, 1, 1)], LABELS)


def test_toxicity(spark, docs, none, labels):
    toxic = [(i, words(i, 40) + (" idiot moron" if i % 3 == 0 else "")) for i in range(200)]
    many = spark.createDataFrame([(i, t, "en", "s", 1, 0.0, "") for i, t in toxic], DOCS)
    marks = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(200)], LABELS)
    out = toxicity.score(many.withColumn("toxic_score", F.lit(9)), marks).where(toxicity.fold(F.col("doc_id")) == 0).collect()
    assert all((r["toxic_score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in out) and len(out) > 20
    scored = toxicity.score(docs, labels)
    assert scored.count() == len(documents()) and scored.where("toxic_score is null or toxic_score not between 0 and 1").count() == 0
    assert toxicity.score(none, labels).count() == 0
    assert {r[0] for r in toxicity.score(docs, labels.where("false")).select("toxic_score").distinct().collect()} == {0.0}


def test_topk(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 6) / 64], "x") for i in range(90)] + [(90, None, "x"), (91, [], "x"), (92, [float("nan")], "x"), (93, [1.0, None], "x"), (None, [1.0], "x"), (94, [2.0**40, 1.0], "x"), (95, [0.5], "x")]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"))
    good = {i: [int(np.floor(64 * v)) for v in x] + [0] * (6 - len(x)) for i, x, _ in rows if i is not None and i not in (90, 92, 93)}
    out = topk.search(vectors, vectors.where("vec_id % 20 = 0 or vec_id = 94"), 7).collect()
    want = set()
    for q in [i for i in good if i % 20 == 0 or i == 94]:
        scores = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:7]
        want |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)}
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert topk.search(vectors.where("false"), vectors.where("false")).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.standard_normal((40, 64)), rng.standard_normal((50, 64))
    for level in topk.LEVELS:
        assert (topk.statistics(q, level) @ topk.statistics(c, level).T >= q @ c.T - 1e-3).all()


def test_packing(docs, none):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.vocabulary_files()[0])
    odd = [t for _, t, *_ in documents()] + ["a<|endoftext|>b", " \n\t  é漢字", "\r\n\r\n", "'s 'S 123 ½"]
    assert all(packing.encode(t) == [*exact.encode(t or "", add_special_tokens=False).ids, 2] for t in odd)
    rows = packing.pack(docs, with_ids=True).collect()
    assert len(rows) >= len(documents()) and all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"] for r in rows)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        end = 0
        for r in own:
            assert r["offset"] == end
            end += r["length"]
        assert end <= 1024
    long = sorted((r for r in rows if r["doc_id"] == 27), key=lambda r: r["piece"])
    assert [i for r in long for i in r["ids"]] == packing.encode(dict((d[0], d[1]) for d in documents())[27]) and all(r["length"] == 1024 for r in long[1:])
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("most", [100, 60, 17])
def test_packing_plan_is_best_fit(most):
    r = random.Random(most)
    lengths = [r.randint(1, most) for _ in range(3000)] + [100] * 5
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        fit = [(room, i) for i, room in enumerate(rooms) if room >= n]
        if fit:
            room, i = min(fit)
            rooms[i] = room - n
        else:
            rooms.append(100 - n)
    slots = packing.plan({n: lengths.count(n) for n in set(lengths)}, 100)
    fill: dict[int, list[tuple[int, int]]] = {}
    for length in set(lengths):
        own = sorted((int(rank), int(first), int(each), int(offset)) for n, rank, first, each, offset in slots if n == length)
        for (rank, first, each, offset), end in zip(own, [x[0] for x in own[1:]] + [lengths.count(length)], strict=True):
            for j in range(end - rank):
                fill.setdefault(first + j // each, []).append((offset + j % each * length, length))
    for at in fill.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= 100
    assert len(fill) <= len(rooms) and sum(map(len, fill.values())) == len(lengths)


def test_minhash(docs, none):
    out = minhash.classes(docs).collect()
    assert len(out) == len(documents())
    of = {}
    for r in out:
        of.setdefault(r["doc_id"], r["class_id"])
    assert of[20] == of[21] == of[0] == 0 and of[22] == 1 and of[28] == 3 and of[25] == of[26] == 25 and of[None] == 2
    assert all(of[i] == i for i in (5, 23, 24, 27, 29, 30))
    assert minhash.classes(none).count() == 0


def test_minhash_blocks_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LEFT_BLOCK", 3)
    monkeypatch.setattr(minhash, "RIGHT_BLOCK", 4)
    monkeypatch.setattr(minhash, "MEMBERS_A_GROUP", 2)
    r, rows = random.Random(5), []
    for g in range(3):
        base = words(1000 + g, 120).split()
        for _ in range(25):
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = words(r.randrange(10**6), 1)
            rows.append((len(rows), " ".join(t)))
    shingled = minhash.Shingled([t for _, t in rows])
    group = {i: i for i, _ in rows}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if minhash.probability_jaccard(shingled.of(i), shingled.of(j)) >= 0.8 and group[i] != group[j]:
            a, b = sorted((group[i], group[j]))
            group = {k: a if v == b else v for k, v in group.items()}
    got = {x["doc_id"]: x["class_id"] for x in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group


def test_probability_jaccard():
    ids = np.arange(6, dtype=np.uint64)
    x, y = np.array([1.0, 2, 3, 1]), np.array([2.0, 2, 1, 5])
    a, b = (ids[:4], x), (ids[2:], y)
    wx, wy = dict(zip(ids[:4].tolist(), x)), dict(zip(ids[2:].tolist(), y))
    want = sum(1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in range(6)) for d in (2, 3))
    assert minhash.probability_jaccard(a, b) == pytest.approx(want)
    sets = [np.arange(0, 900), np.arange(100, 1000)]
    keys = np.concatenate(sets).astype(np.uint64) * np.uint64(7919)
    sig = minhash.prob_min_hash(keys, np.ones(1800), np.array([0, 900, 1800]), 2000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(0.8, abs=0.05)


def plain_passages(rows):
    seen, out = {}, []
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 19) if i is not None else ():
            key = tuple(w[k : k + 20])
            seen[key] = min(seen.get(key, (i, k)), (i, k))
    for i, t in rows:
        w = (t or "").encode().split()
        keep = [True] * len(w)
        for k in range(len(w) - 19) if i is not None else ():
            if seen[tuple(w[k : k + 20])] < (i, k):
                keep[k : k + 20] = [False] * 20
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(b" ".join(itertools.compress(w, keep))).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2000, 2])
def test_substrings(docs, none, monkeypatch, hot):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 300)
    out = substrings.clean(docs, hot).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(tuple, out), key=str) == plain_passages([(i, t) for i, t, *_ in documents()])
    assert substrings.clean(none).count() == 0


def test_fm_index_finds_foreign_windows():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 3, 400).astype(np.uint64)
    index = substrings.FMIndex(text, np.array([250, 150]))
    query = np.concatenate((text[10:40], np.array([9], np.uint64), text[60:90], rng.integers(0, 3, 60).astype(np.uint64)))
    inside = {tuple(text[i : i + 20]) for i in [*range(231), *range(250, 381)]}
    which, at, _ = index.windows(query, np.array([len(query)]))
    assert sorted(at.tolist()) == [i for i in range(len(query) - 19) if tuple(query[i : i + 20]) in inside]


def test_nn_descent(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 12)) + rng.integers(0, 4, 700)[:, None]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(700 + i, x[0].tolist(), 1.0) for i in range(30)] + [(800, None, 1.0), (801, [0.0] * 12, 1.0), (802, [float("inf")] * 12, 1.0), (803, [1.0], 1.0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double")
    out = nndescent.Index(vectors).search(vectors.where("vec_id % 100 = 0")).collect()
    good = {i: np.pad(np.array(v), (0, 12 - len(v))) for i, v, _ in rows if i < 800 or i == 803}
    hits = 0
    queries = [q for q in good if q % 100 == 0]
    for q in queries:
        want = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:10]
        mine = sorted(((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q))
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(s == pytest.approx(float(np.sqrt(((good[q] - good[i]) ** 2).sum()))) for _, i, s in mine)
        hits += len({i for _, i in want} & {m[1] for m in mine})
    assert hits >= 0.9 * 10 * len(queries)


def test_licenses(spark, none):
    rows = [(1, "text\nReleased under the MIT Licence!\nmore"), (2, "Copyright (c) 2020 A. Uthor\n\n" + licenses.MIT.upper()), (3, None), (4, ""), (None, "Licensed under CC BY-NC 4.0."), (5, "licensed  under: cc by nc 4.0"), (6, "not released under the mit license"), (5, "x")]
    out = [(r["doc_id"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))).collect()]
    assert sorted(out, key=str) == sorted([(1, "MIT"), (2, "MIT"), (3, ""), (4, ""), (None, ""), (5, "CC-BY-NC-4.0"), (5, "CC-BY-NC-4.0"), (6, "")], key=str)
    assert licenses.scan(none).count() == 0


def test_quality(spark, docs, none, labels):
    rows = [(i, words(i, 30) if i % 5 else "%% ## " * 30) for i in range(300)]
    many = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(300)], LABELS)
    kept = quality.resample(many, marks).collect()
    assert len(kept) == 240 and sum(r["doc_id"] % 5 == 0 for r in kept) <= 5
    assert quality.resample(docs, labels).count() == round(len(documents()) * 24 / 33)
    assert quality.resample(none, labels).count() == 0 and quality.resample(docs, labels.where("false")).count() == len(documents())


def test_quality_selection_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quality, "LAST_BIN", 5)
    monkeypatch.setattr(quality, "BINS", 4)
    r = random.Random(6)
    rows = [(i, 0.0, float(r.randint(0, 20))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, log_weight double, key double")
    for k in (0, 1, 57, 199, 200):
        want = {i for i, _, _ in sorted(rows, key=lambda x: (-x[2], x[0]))[:k]}
        assert {x["doc_id"] for x in quality.largest(df, k).collect()} == want


def plain_spans(text: str) -> str:
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if k % 2 == 0 else int(c) * 2 - (9 if c > "4" else 0) for k, c in enumerate(reversed(d))) if kind == "card" else 0
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and total % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(docs, none, spark):
    out = pii.detect(docs).select("doc_id", pii.joined(F.col("base")).alias("base"), pii.joined(F.col("spans")).alias("spans")).collect()
    want = sorted([(i, plain_spans(t)) for i, t, *_ in documents()], key=str)
    assert sorted([(r["doc_id"], r["base"]) for r in out], key=str) == want
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in out)
    assert pii.detect(none).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(documents())
    row = clean.where("doc_id = 29").first()
    assert row["text"].startswith("mail [email][email] or [ip] 1.2.3.256, [phone] 😀 ") and row["n_chars"] == len(row["text"])
    assert clean.where("doc_id = 5").first()["text"] == docs.where("doc_id = 5").first()["text"]


def test_mixing(docs, none):
    rows = documents()
    tokens = [max(1, len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows]
    out = mixing.mix(docs.withColumn("tokens", F.lit("clash")), budget_percent=150, epochs=2)
    total = sum(tokens) * 150 // 100
    got = sum(r["tokens"] * r["copies"] for r in out.collect())
    assert got <= total and {r["copies"] for r in out.collect()} <= {1, 2}
    assert mixing.mix(docs, budget_percent=100, epochs=1).count() == len(rows)  # all room is given out
    assert mixing.mix(none).count() == 0


def test_mixing_passes_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s", 10), ("a", "y", "s", 1000), ("b", "x", "s", 1000)], "domain string, lang string, source string, tokens long")
    one = F.lit(1).cast("long")
    got = {(r["domain"], r["lang"]): r["budget"] for r in mixing.budgets(leaves, 400, dict.fromkeys(mixing.LEVELS, one), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}
