"""Runs against a plain scan of all periods; planted texts, digests and odd input."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import periodic, queries

DOCS = "doc_id long, text string, start long, runs string"


def plain(words: list[bytes]) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def shortened(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    return b" ".join(w for k, w in enumerate(words) if k not in gone).decode()


def text(r: random.Random, size: int) -> str:
    out: list[str] = []
    while len(out) < size:
        kind = r.random()
        if kind < 0.2:
            out += (["a"] * r.randint(1, 60) + [r.choice("ab")]) * r.randint(1, 5)
        elif kind < 0.5:
            out += [r.choice("abcdefgh") for _ in range(r.randint(1, 40))]
        else:
            unit = [r.choice("abcdefghijk"[: r.randint(1, 11)]) for _ in range(r.randint(1, 60))]
            out += (unit * r.randint(2, 9))[: r.randint(1, 400)]
    return r.choice([" ", "\n", "\t \r"]).join(out)


def test_transforms_return():
    for rows, n in ((3, 4), (5, 64), (2, 512)):
        a = np.random.default_rng(n).integers(0, periodic.PRIME, (rows, n)).astype(np.uint64)
        assert (periodic.inverse(periodic.transform(a.copy()), rows) == a).all()


def test_zero_distances_are_those_of_equal_blocks():
    x = np.random.default_rng(1).integers(0, 2, 300)
    for size in (8, 16):
        starts = np.arange(0, 300 - size, size)
        found = {*zip(*(a.tolist() for a in periodic.zero_distances(x, starts, size, 1)), strict=True)}
        assert found == {(s, d) for s in starts.tolist() for d in range(1, 2 * size) if s + d + size <= 300 and (x[s : s + size] == x[s + d : s + d + size]).all()}


@pytest.mark.parametrize("seed", range(8))
def test_runs_are_those_of_a_plain_scan(seed):
    r = random.Random(seed)
    texts = [text(r, r.randint(0, 500)) for _ in range(8)]
    for t, (words, runs) in zip(texts, periodic.runs_of_texts(texts), strict=True):
        assert words == t.encode().split()
        assert [tuple(x) for x in runs.tolist()] == plain(words)
        assert periodic.collapsed(words, runs) == shortened(words, plain(words))


@pytest.mark.parametrize("unit", ["a ", "a " * 700 + "b ", "a b " * 300 + "c "])
def test_long_uniform_stretches(unit):
    t = unit * (1_200_000 // len(unit))
    ((words, runs),) = periodic.runs_of_texts([t])
    own = len(unit.split())
    assert [0, len(words), own] in runs.tolist() and len(runs) == (1 if own == 1 else 1 + len(words) // own)


def test_detect(spark):
    rows = [(1, None), (2, ""), (3, "w " * 23), (4, "w " * 24), (4, "w " * 24), (None, "x y " * 30), (5, "  é\x1cé " * 30), (6, "q" * 1_100_000), (7, " ".join(str(i % 40_000) for i in range(130_000)))]
    docs = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], DOCS)
    out = sorted(((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.detect(docs).collect()), key=str)
    want = sorted(((i or 0, len(w := (t or "").encode().split()), p := plain(w) if i != 7 else [(0, 130_000, 40_000)], shortened(w, p)) for i, t in rows), key=str)
    assert out == want
    assert periodic.detect(docs.limit(0)).count() == 0


def test_query_against_plain_version(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, text(r, r.randint(0, 200)) if i % 2 else " ".join(str(r.randint(0, 9**6)) for _ in range(r.randint(0, 300)))) for i in range(120)] + [(500, None), (501, "")]
    spark.createDataFrame([(i, t, 7, "s") for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    planted = 0
    for i, t in rows:
        w = (t or "").encode().split()
        g, rest = divmod(zlib.crc32(str(i).encode()), 10)
        if rest == 0 and w:
            planted += 1
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(len(w))]
        runs, x = plain(w), got[i]
        best = min(runs, key=lambda s: (-s[1] / s[2], s[0], s[2])) if runs else None
        assert x["n_runs"] == len(runs)
        assert (x["start"], x["length"], x["period"], x["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert x["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert x["collapsed_sha256"] == hashlib.sha256(shortened(w, runs).encode()).hexdigest()
    assert planted > 5 and sum(x["n_runs"] for x in got.values()) > 60


def test_rows_without_ids_are_not_planted(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g h"), (None, None)], "doc_id long, text string")
    assert {r["text"] for r in periodic.planted(docs).collect()} == {"a b c d e f g h", None}
    assert periodic.planted(docs.where(F.lit(False))).count() == 0
