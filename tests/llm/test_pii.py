"""op9: candidates, features, trees and added spans against plain versions."""

from __future__ import annotations

import math
import random
import time

import pytest
import regex

from ledgerline.llm import pii

from test_operators import words

ODD = ["", "a@b", "x [at] y [dot] com, z(at)q.de", "tel 030 1234-5678 / 99", "token = \"" + "0a1b" * 10 + "\" end", "1.2.3.4 and 12345678", "q" * 40 + " " + "a1" * 300, "é@ü.de 😀 +49 (30) 12 34 56 78 9", "api_key: Zm9vYmFyMTIzNDU2Nzg5MA== x", "a.b@c.d@e.f " * 3, "5" * 30]


def test_matches_are_those_of_a_plain_scan(spark):
    texts = ODD + ["1.1.1.1 " * 700]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    patterns = {**pii.PATTERNS, **pii.GENERATORS}
    for r in pii.with_matches(df, df["text"], patterns).collect():
        for k, p in patterns.items():
            want, last = [], 0
            for m in regex.finditer(p, r["text"]):
                tail = r["text"][m.end() :]
                want.append((m.start(), m.end(), m.group(), r["text"][last : m.start()][-pii.AROUND :]))
                last = m.end()
            assert [(s["start"], s["end"], s["value"], s["before"]) for s in r[k]] == want, (k, r["text"][:60])


def test_boosting_on_cells_equals_boosting_on_rows():
    r = random.Random(4)
    rows = [(c := r.choice([0, 1, 5, 9, 64, 65, 2048, 4095]), int(r.random() < (0.9 if c & 1 else 0.2))) for _ in range(600)]
    cells: dict[int, list[int]] = {}
    for c, y in rows:
        cells.setdefault(c, [0, 0])[y] += 1
    trees = pii.boosted({c: tuple(v) for c, v in cells.items()}, trees=5)
    score = [0.0] * len(rows)
    for t in trees:
        grad = [(y - 1 / (1 + math.exp(-s)), (p := 1 / (1 + math.exp(-s))) * (1 - p)) for (_, y), s in zip(rows, score, strict=True)]

        def leaf(members: list[int], grad: list = grad) -> tuple[float, float]:
            g, h = sum(grad[i][0] for i in members), sum(grad[i][1] for i in members) + 1.0
            return g * g / h, pii.RATE * max(-4.0, min(4.0, g / h))

        split = lambda members, b: [[i for i in members if rows[i][0] >> b & 1 == side] for side in (0, 1)]
        gains = [sum(leaf(part)[0] for part in split(range(len(rows)), b)) for b in range(12)]
        assert gains[t[0]] == pytest.approx(max(gains))
        for side, members in enumerate(split(range(len(rows)), t[0])):
            inner = [sum(leaf(part)[0] for part in split(members, b)) for b in range(12)]
            assert inner[t[1 + side]] == pytest.approx(max(inner))
            for k, part in enumerate(split(members, t[1 + side])):
                assert t[3][2 * side + k] == pytest.approx(leaf(part)[1])
                for i in part:
                    score[i] += t[3][2 * side + k]
    assert [pii.tree_score(c, trees) for c, _ in rows] == pytest.approx(score)


def test_thresholds_come_from_held_out_cells():
    fit = [(False, 1, 0, 0, 50), (False, 2, 0, 50, 0), (False, 4, 5, 0, 45)]
    assert set(pii.accepted([*fit, (True, 1, 0, 0, 10), (True, 4, 0, 0, 10)])) == {1, 4}
    assert set(pii.accepted([*fit, (True, 1, 0, 0, 10), (True, 4, 5, 0, 5)])) == {1}
    assert set(pii.accepted([*fit, (True, 1, 0, 0, 10), (True, 4, 0, 30, 5)])) == {1}
    assert set(pii.accepted([*fit, (True, 1, 0, 5, 10), (True, 4, 0, 5, 10)])) == {1, 4}
    assert pii.accepted(fit) == {} == pii.accepted([*fit, (True, 1, 9, 0, 1)])


def planted(n: int) -> list[tuple[int, str]]:
    r, rows = random.Random(2), []
    for i in range(n):
        key = "".join(r.choice("0123456789abcdef") for _ in range(40))
        order = "".join(r.choice("123456789") for _ in range(16))
        said = f'token = "{key}"' if i % 3 else f'"{key}"'
        mail = ("e-mail: " if i % 4 else "") + f"ann{i} [at] site{i}.org"
        rows.append((i, f"{words(i, 20)} {said} {words(i + 1, 5)} order no {order} {words(i + 2, 5)} {mail}, {words(i + 3, 9)}"))
    return rows


def test_spans_are_added_where_no_word_stands(spark):
    rows = planted(200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: [(pii.ADDED[s["kind"]], s["start"], s["end"]) for s in r["spans"]] for r in pii.detect(df).collect()}
    for i, t in rows:
        secret, mail = regex.search("[0-9a-f]{40}", t), regex.search(r"\S+ \[at\] [^,]+", t)
        assert ("secret", secret.start(), secret.end()) in found[i]
        assert ("email", mail.start(), mail.end()) in found[i]
    number = [regex.search("order no ([0-9]{16})", t) for _, t in rows]
    added = sum(any(s[1] < m.end(1) and m.start(1) < s[2] and s[0] != "card" for s in found[i]) for (i, _), m in zip(rows, number, strict=True))
    assert added == 0


def test_redaction_takes_added_spans_and_keeps_other_columns(spark):
    rows = [(i, t, "x", {"a": 1}, i) for i, t in planted(60)] + [(None, None, "x", None, 5), (None, "", "x", None, 6), (3, "token", None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held string, own map<string,int>, spans_email long")
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert out.where("doc_id < 60 and doc_id <> 3 and (text not like '%[secret]%' or text not like '%[email]%')").count() == 0
    assert pii.redact(df.where("false")).count() == 0


def test_many_spans_in_one_text(spark):
    """Overlapping kinds, runs of candidates that overlap through others, code points beyond the first plane; against a plain scan."""
    r = random.Random(4)
    bits = ["call +1 555 {:07d}", "mail a{}@b.org", "10.0.{}.7", "+4111 1111 1111 1111", "4111-1111-1111-1111 5500 0000 0000 0004", "token: 'a1b2c3d4e5f6a7b8{:04d}'", "😀 é", "x1y2z3a4b5c6d7e8f9@host.example.org"]
    rows = [(i, " ".join(r.choice(bits).format(r.randint(1, 250)) for _ in range(n))) for i, n in enumerate([0, 1, 3, 10, 40, 200, 200, 3_000])]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    spans = {x["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in x["spans"]] for x in pii.detect(docs).collect()}
    redacted = {x["doc_id"]: x["text"] for x in pii.redact(docs).collect()}
    for i, t in rows:
        out, at, kept = [], 0, []
        for start, end, kind in sorted(spans[i], key=lambda s: (s[0], -s[1], s[2])):
            if start >= at:
                out += [t[at:start], f"[{pii.ADDED[kind]}]"]
            at = max(at, end)
        assert redacted[i] == "".join(out) + t[at:]
        for start, end, _ in [s for s in spans[i] if s[2] == pii.ADDED.index("secret")]:
            assert not any(a < end and start < b for a, b in kept)
            kept.append((start, end))
    assert sum(len(s) for s in spans.values()) > 2_000


def test_overlaps_take_linear_time(spark):
    text = " ".join(f"call +1 555 {i:07d} mail a{i}@b.org" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    assert len(pii.detect(docs).first()["spans"]) == 20_000
    assert time.time() - began < 20
