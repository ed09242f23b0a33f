"""op7: real license files, all scripts, lines that are passed over."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import licenses


def test_whole_texts_with_and_without_titles(spark):
    rows = []
    for name, forms in licenses.KNOWN.items():
        for title, text in forms:
            rows.append((len(rows), f"{title}\n\nCopyright (c) 2021, Some One <a@b.c>\nAll rights reserved.\n\n  {text.replace(', ', ',  ')}\n", name))
            rows.append((len(rows), f"Copyright © Some One\n{text}", name))
    got = {r["doc_id"]: r["licenses"].split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()}
    assert all(name in got[i] for i, _, name in rows), [(name, got[i]) for i, _, name in rows if name not in got[i]]


def test_copyright_lines_of_any_length_are_left_out(spark):
    text = licenses.KNOWN["MIT"][0][1]
    owners = ", ".join(f"Owner {i}" for i in range(50_000))
    rows = [(1, f"Copyright (c) 2021 {owners}\n{text}"), (2, f"Copyright {owners} 2021\n{text}"), (3, f"{owners}\n{text}"), (4, text)]
    got = {r["doc_id"]: r["digest"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] == got[4] != got[3]


def test_letters_of_all_scripts_count(spark):
    rows = [(1, "Лицензия: свободная"), (2, "许可证"), (3, "лицензия свободная!"), (4, ""), (5, "Copyright (c) 2020 A. B.")]
    d = {r["doc_id"]: r["digest"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert d[1] == d[3] and len({d[1], d[2], d[4]}) == 3 and d[5] == d[4]


def test_lines_without_a_known_word_are_passed_over_only_if_they_cannot_match(spark):
    table = licenses.known(spark, spark.createDataFrame([("A", "Use at will"), ("B", "No")], "license string, text string"))
    assert {r["license"]: r["words"] for r in table.collect()} == {"A": ["will"], "B": []}
    assert licenses.cover([["will"], []]) is None and licenses.cover([["a", "b"], ["b"], ["c"]]) == ["b", "c"] and licenses.cover([]) == []
    docs = spark.createDataFrame([(1, "x\nNO!\ny"), (2, "use AT will.\nz"), (3, "nothing")], "doc_id long, text string")
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs, table).collect()} == {1: "B", 2: "A", 3: ""}
    assert {r["doc_id"]: r["licenses"] for r in licenses.scan(docs, table.where("license = 'A'")).collect()} == {1: "", 2: "A", 3: ""}


@pytest.mark.skipif(not os.path.isfile("/usr/share/common-licenses/Apache-2.0"), reason="no license files here")
def test_whole_files(spark, tmp_path):
    for name in ("Apache-2.0", "GPL-3", "MPL-2.0", "BSD"):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8") as f:
            (tmp_path / f"{name}.txt").write_text(f.read(), encoding="utf-8")
    table = licenses.known_files(spark, str(tmp_path))
    texts = [(i, (tmp_path / f"{n}.txt").read_text(encoding="utf-8").upper().replace("LICENSE", "LICENCE") + "\n", n) for i, n in enumerate(("Apache-2.0", "GPL-3", "MPL-2.0", "BSD"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string, name string")
    got = licenses.scan(docs, table).join(docs, "doc_id").where(F.col("licenses") != F.col("name")).collect()
    assert not got
