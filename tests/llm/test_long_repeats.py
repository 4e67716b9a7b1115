"""Repeats judged by strings longer than the registered query's, against brute force."""

import random

import pytest

from parlance.llm import suffix_dedup


def covered(texts: list[bytes], length: int) -> list[int]:
    seen, out = set(), []
    for text in texts:
        gone = set()
        for i in range(len(text) - length + 1):
            if text[i : i + length] in seen:
                gone.update(range(i, i + length))
            seen.add(text[i : i + length])
        out.append(len(gone))
    return out


@pytest.mark.parametrize("length", [150, 200, 300])
def test_lengths_beyond_the_default(spark, length):
    draw = random.Random(length)
    first = "".join(draw.choice("abcdefgh ") for _ in range(3000))
    near = first[:1400] + "#" + first[1401:2000] + first[2100:]
    texts = [first, near, first[500:1100] + near[-900:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(df, length=length).collect()}
    assert [got[i] for i in range(3)] == covered([t.encode() for t in texts], length)


def test_lengths_out_of_range_raise(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for length in (0, 1 << 23):
        with pytest.raises(ValueError):
            suffix_dedup.remove_repeats(df, length=length)
