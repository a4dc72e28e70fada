"""Texts of more than a million characters, with a copy each, through the operators on repeats."""

import random

import pytest

from tallyloom.llm import chunk_dedup, jaccard_join, suffix_dedup


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(180_000))
    assert len(text) > 1_000_000
    return text, spark.createDataFrame([(1, text), (2, "short and else"), (3, text)], "doc_id long, text string")


def test_jaccard_join(long):
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(long[1]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_chunk_dedup(long):
    got = {r.doc_id: r.text for r in chunk_dedup.substring_dedup(long[1]).collect()}
    assert got[1] == long[0] and got[2] == "short and else" and len(got[3]) < 200


def test_suffix_dedup(long):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(long[1]).collect()}
    n = len(long[0].encode())
    assert got == {1: (n, 0), 2: (14, 0), 3: (n, n)}
