"""op4: rows without ids, repeated ids and crowded buckets."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from ledgerline.llm import minhash

from test_operators import words


def linked(rows: list[tuple[int | None, str | None]]) -> list[int]:
    """Number of the class of each row, by all pairs."""
    shingled = minhash.Shingled([t or "" for _, t in rows])
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        (a, _), (b, _) = shingled.of(i), shingled.of(j)
        if len(a) and len(b) and minhash.probability_jaccard(shingled.of(i), shingled.of(j)) >= 0.8:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    return group


def changed(text: str, r: random.Random, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = words(r.randrange(10**6), 1)
    return " ".join(w)


@pytest.mark.parametrize("hot", [2048, 3])
def test_crowded_buckets_null_and_repeated_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "LEFT_BLOCK", 3)
    monkeypatch.setattr(minhash, "RIGHT_BLOCK", 4)
    r, rows = random.Random(8), []
    shared = words(77, 150)
    for g in range(12):  # many components around one frequent passage: alike by about 0.7, within a group by over 0.8
        own = words(500 + g, 60)
        for k in range(4):
            rows.append((None if k == 1 else len(rows), f"{shared} {changed(own, r, k % 3)}"))
    rows += [(5, words(900, 80)), (5, words(901, 80)), (5, changed(words(900, 80), r, 1)), (None, words(902, 50)), (None, changed(words(902, 50), r, 1))]
    rows += [(7, None), (8, ""), (None, None), (9, "..."), (9, "...")]
    want = linked(rows)
    names = {}
    for (i, t), g in zip(rows, want, strict=True):
        if i is not None and (t or "").strip("."):
            names[g] = min(names.get(g, i), i)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"], x["class_id"]) for x in minhash.classes(df, hot).collect()), key=str)
    assert got == sorted(((i, names.get(g) if (t or "").strip(".") else i) for (i, t), g in zip(rows, want, strict=True)), key=str)


def test_one_row_of_each_class_stays(spark):
    base = words(3, 100)
    r = random.Random(1)
    rows = [(4, base, "a", {"k": 1}), (4, base, "a", {"k": 1}), (4, changed(base, r, 1), "b", None), (None, base.upper(), "c", None), (9, words(4, 60), "d", None), (9, words(5, 60), "e", None), (None, words(6, 60), "f", None), (None, words(6, 60), "f", None), (1, "", "g", None), (1, None, "h", None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, row string, extra map<string,int>")
    out = minhash.firsts(df)
    kept = sorted(((x["doc_id"], x["row"]) for x in out.collect()), key=str)
    assert out.columns == df.columns
    assert [k for k in kept if k[1] in "abc"] in ([(4, "a")], [(4, "b")])
    assert [k for k in kept if k[1] not in "abc"] == sorted([(9, "d"), (9, "e"), (None, "f"), (1, "g"), (1, "h")], key=str)
    assert minhash.firsts(df.where("false")).count() == 0


def test_few_links_are_joined_in_one_step(spark, monkeypatch):
    ids = [int(x) for x in np.random.default_rng(2).permutation(60)]
    edges = spark.createDataFrame([*zip(ids[:29], ids[1:30], strict=True), *zip(ids[30:58], ids[31:59], strict=True)], "u long, v long")
    comps = spark.createDataFrame([(i, i) for i in ids], "id long, comp long")
    writes, stored = [], minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df: writes.append(1) or stored(df))
    for tail, most in ((minhash.TAIL, 2), (0, 100)):
        writes.clear()
        at = dict(map(tuple, minhash.contract(comps, edges, tail).collect()))
        assert len(at) == 60 and len({at[i] for i in ids[:30]}) == len({at[i] for i in ids[30:59]}) == 1 and len(set(at.values())) == 3
        assert len(writes) <= most
    assert dict(map(tuple, minhash.contract(comps, edges.where("false")).collect())) == {i: i for i in ids}


def test_a_block_compares_only_what_can_be_alike(monkeypatch):
    r, shared = random.Random(3), words(77, 150)
    texts = [f"{shared} {words(500 + g, 60)}" for g in range(40)]  # alike by about 0.5 each
    texts += [changed(texts[g], r, 1 + g % 4) for g in range(6)] + [f"{shared} {words(9, 8)} {shared} {words(k, 9)}" for k in (9, 10)]
    rows = [(1, 0, i, i, t, [-i - 1] * minhash.BANDS, True) for i, t in enumerate(texts)]
    pdf = pd.DataFrame(rows, columns=["bucket", "band", "id", "comp", "text", "bands", "rest"]).assign(lblock=0, rblock=0)
    both = pd.concat([pdf.assign(left=True), pdf.assign(left=False)], ignore_index=True)
    compared, similar = [], minhash.Shingled.similar
    monkeypatch.setattr(minhash.Shingled, "similar", lambda self, i, others: compared.append(len(others)) or similar(self, i, others))
    links = pd.concat(minhash._block_links(iter([both])))
    want = linked(list(enumerate(texts)))
    group = list(range(len(texts)))
    for a, b in zip(links["a"], links["b"], strict=True):
        group = [group[a] if g == group[b] else g for g in group]
    assert all((want[i] == want[j]) == (group[i] == group[j]) for i, j in itertools.combinations(range(len(texts)), 2))
    assert len(set(want)) < len(texts) and sum(compared) < 60  # of 1,128 pairs
