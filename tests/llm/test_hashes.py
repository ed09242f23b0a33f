"""Word hashes tell words of any length apart."""

from __future__ import annotations

import numpy as np
import pytest

from ledgerline.llm import minhash, quality, substrings
from ledgerline.llm.common import PIECE, word_hashes

ALL = np.array([b != 32 for b in range(256)], np.uint8)


@pytest.mark.parametrize("power", range(21))
def test_swapped_bytes_change_the_hash(power):
    gap = 1 << power
    for tail in (b"", b"yz", b"y" * (PIECE - 1)):
        one, two = b"a" + b"x" * (gap - 1) + b"b" + tail, b"b" + b"x" * (gap - 1) + b"a" + tail
        first, h = word_hashes(one + b" " + two + b" " + one, ALL)
        assert first.tolist() == [0, len(one) + 1, 2 * len(one) + 2]
        assert h[0] == h[2] != h[1]


def test_pieces_are_neither_swapped_nor_dropped():
    a, b = b"a" * PIECE, b"b" * PIECE
    words = [a, b, a + b, b + a, a + a, a + a + a, a + b + a, b + a + a, a + b"a"]
    assert len(set(word_hashes(b" ".join(words), ALL)[1].tolist())) == len(words)


def test_long_words_that_differ_do_not_repeat(spark):
    shared = " ".join(f"w{i}" for i in range(19))
    one, two = ("a" + "x" * 4095 + "b"), ("b" + "x" * 4095 + "a")
    docs = spark.createDataFrame([(1, f"{shared} {one}"), (2, f"{shared} {two}"), (3, f"{shared} {one}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.clean(docs).collect()} == {1: 0, 2: 0, 3: 20}
    assert minhash.words_of([one])[0][0] != minhash.words_of([two])[0][0]
    assert (quality.features([one])[0] != quality.features([two])[0]).any()
