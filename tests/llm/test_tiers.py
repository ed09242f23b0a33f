"""Tiered packing: every token in one place, no padding, steps of equal size."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerline.llm import packing, queries, tiers

DOCS = "doc_id long, text string, rank long, length string, task string"


def check_plan(histogram: dict[int, int], own: tuple[int, ...]) -> None:
    plan = tiers.Plan(histogram, own)
    rests, sequences = defaultdict(list), defaultdict(list)
    for length, rank, number, at, size, each, tier, first, offset in plan.slots.tolist():
        for i in range(number * each):
            rests[length, rank + i // each].append((at + i % each * size, size))
            sequences[tier, first + i].append((offset, size))
    assert {*rests} == {(n, i) for n, number in histogram.items() for i in range(number)}
    for whole, stretches in [*rests.items(), *sequences.items()]:
        at = 0
        for start, size in sorted(stretches):
            assert start == at
            at += size
        assert at == whole[0]
    assert Counter(t for t, _ in sequences) == plan.sequences
    assert sum(n for t, n in plan.sequences.items() if t not in own) <= max(own).bit_length()


@pytest.mark.parametrize("seed", range(12))
def test_plans_tile_rests_and_sequences(seed):
    r = random.Random(seed)
    own = r.choice([(256, 512, 1024, 2048), (8, 64), (16,)])
    check_plan({r.randint(1, max(own)): r.randint(1, 40) for _ in range(r.randint(0, 60))}, own)


def test_plan_stays_small():
    many = tiers.Plan({n: 10**9 + n * 7919 % 10**6 for n in range(1, 2049)})
    few = tiers.Plan({n: 10**3 + n * 7919 % 10**3 for n in range(1, 2049)})
    assert len(many.slots) < 10 * len(few.slots)  # for a million times as many rests


def verify(rows: list, texts: dict, ids_of, longest: int, step: int) -> None:
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        pieces[x["doc_id"]].append(x)
        sequences[x["sequence_id"]].append(x)
    assert {*pieces} == {*texts}
    for i, own in pieces.items():
        copies, ids = len(texts[i]), ids_of(texts[i][0])
        count = Counter()
        for x in own:
            assert x["doc_tokens"] == len(ids)
            assert x["ids_crc32"] == zlib.crc32(np.array(ids[x["start"] : x["start"] + x["length"]], "<u4").tobytes())
            count.update(range(x["start"], x["start"] + x["length"]))
        assert count == Counter({k: copies for k in range(len(ids))})
    groups = Counter()
    for own in sequences.values():
        at = 0
        for x in sorted(own, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at == own[0]["tier"] <= longest and not at & (at - 1)
        assert len({(x["tier"], x["step_group"]) for x in own}) == 1
        groups[own[0]["step_group"]] += at
    assert sorted(groups) == list(range(len(groups))) and all(n == step for g, n in groups.items() if g < len(groups) - 1)


def test_pack(spark):
    r = random.Random(3)
    rows = [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(r.choice([1, 5, 40, 300, 900])))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "again and again"), (302, "again and again"), (None, "no id"), (303, "x1 " * 400_000), (304, "an <|endoftext|> inside")]
    docs = spark.createDataFrame([(i, t, 1, "l", "t") for i, t in rows], DOCS).repartition(5)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for own, step in ((tiers.TIERS, tiers.STEP), ((64, 128), 256)):
        out = tiers.pack(docs, own, step=step).collect()
        verify(out, texts, lambda t: [*packing.encode(t)[:-1], tiers.END], max(own), step)
    assert tiers.pack(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tiers.pack(docs, (100, 200))


def test_join_that_shuffles_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word {i} " * (i % 50 + 1), 1, "l", "t") for i in range(200)], DOCS).repartition(4)
    key = lambda df: Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"]) for x in df.collect())
    one = key(tiers.pack(docs))
    monkeypatch.setattr(tiers, "OFFSETS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert sum(key(tiers.pack(docs)).values()) == sum(one.values())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query(spark, tmp_path):
    rows = [(i, f"some text number {i} " * (i % 90)) for i in range(150)]
    spark.createDataFrame([(i, t, 1, "l", "t") for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_tiered_packing(spark, str(tmp_path)).collect()
    verify(out, {i: [t] for i, t in rows}, lambda t: [*packing.encode(t)[:-1], 1], 2048, tiers.STEP)
