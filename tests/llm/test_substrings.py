"""op5: a frequent passage in many contexts, and minimizers that are cut into windows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import substrings

from test_operators import plain_passages, words


@pytest.mark.parametrize("hot", [2000, 5])
def test_one_passage_in_many_contexts(spark, hot):
    passage = words(1, 50)
    rows = [(i, f"{words(1000 + i, i % 31)} {passage} {words(5000 + i, i % 17)}") for i in range(400)] + [(400, passage + " " + passage), (401, None), (None, passage), (402, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = substrings.clean(docs, hot).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(tuple, out), key=str) == plain_passages(rows)


def test_texts_are_read_once_for_segments_and_windows(spark):
    """Twice for segments, once for what is left of them (hot or not), once for the result."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    passage = words(1, 50)
    rows = [(i, f"{words(1000 + i, i % 31)} {passage} {words(5000 + i, i % 17)}") for i in range(60)] + [(60 + i, f"{words(9, 40)} {i}") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).mapInPandas(seen, "doc_id long, text string")
    out = substrings.clean(docs, 5).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    assert sorted(map(tuple, out), key=str) == plain_passages(rows)
    assert read.value <= 4 * len(rows)
