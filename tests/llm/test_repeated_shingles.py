"""Consistent weighted sampling of shingles that a text repeats very often."""

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import common, neardup


def cycled(prose, own):
    """20,000 words that cycle through eight, and a copy with 300 others."""
    base = [f"w{i % 8}" for i in range(20_000)]
    other = list(base)
    for n, i in enumerate(range(50, 20_000, 66)):
        if n < 300:
            other[i] = f"x{n}"
    return [" ".join(base), " ".join(other)]


def one_shingle(prose, own):
    """One shingle 2,000 times, and ``own`` words of each side's own."""
    return ["na " * 2004 + prose(1, own), "na " * 2004 + prose(2, own)]


@pytest.mark.parametrize("texts", [cycled, one_shingle])
def test_samples_agree_for_great_frequencies(prose, texts):
    g, at = neardup.shingles(*common.text_buffer(pa.array(texts(prose, 200), pa.large_string())))
    weight = np.ones(1 << neardup.BUCKET_BITS, np.float32)
    sim = neardup.similarity(g[at[0] : at[1]], g[at[1] : at[2]], weight)
    draws = neardup.Sampler(weight, 2000).draw(*neardup.counted(g, at))
    assert sim > 0.8 and abs((draws[0] == draws[1]).mean() - sim) < 0.05


def test_repetitive_copies_are_one_class(rows, prose):
    docs = rows(list(enumerate(cycled(prose, 0) + [prose(i, 50) for i in range(5)])), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == {0: 0, 1: 0} | {i: i for i in range(2, 7)}
