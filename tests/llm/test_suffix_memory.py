"""Suffix-array dedup: what a task needs in memory, and the same answers whatever is worked on at a time."""

import tracemalloc

import numpy as np
import pytest

from tallyloom.llm import suffix_dedup, suffixes

WIDTH = suffix_dedup.WIDTH


def text(n, seed=3):
    """Letters with many repeats, long and short."""
    rng = np.random.default_rng(seed)
    pool = rng.integers(97, 101, (40, 120)).astype(np.uint8)
    return np.concatenate([pool[k, : rng.integers(60, 120)] for k in rng.integers(0, 40, n // 60 + 1)])[:n]


def peak(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_equal_windows_take_a_few_arrays_of_the_text():
    """75 bytes for each byte of text before."""
    d = text(1 << 20)
    assert peak(lambda: suffixes.equal_windows(d, np.arange(len(d)) <= len(d) - WIDTH, WIDTH)) < 36 * len(d)


@pytest.mark.parametrize("block", [1, 3, 64, 1000])
def test_blocks_of_any_size_give_the_same_windows(monkeypatch, block):
    for d in (text(1500), np.zeros(300, np.uint8), text(130)):
        valid = np.arange(len(d)) <= len(d) - WIDTH
        valid[5:9] = False
        want = suffixes.equal_windows(d, valid, WIDTH).tolist()
        with monkeypatch.context() as m:
            m.setattr(suffixes, "BLOCK", block)
            got, raw = suffixes.equal_windows(d, valid, WIDTH).tolist(), d.tobytes()
            order = suffixes.suffix_order(d, WIDTH).tolist()
        assert got == want and len(set(got)) == len({raw[p : p + WIDTH] for p in np.flatnonzero(valid).tolist()})
        cut = [raw[p : p + WIDTH].ljust(WIDTH, b"\0") for p in order]
        assert cut == sorted(cut) and sorted(order) == list(range(len(d)))


def bucket(n, seed=5):
    """Runs of n documents as they meet in a bucket: text, count, document, key."""
    rng, rows = np.random.default_rng(seed), []
    for doc in range(n):
        d = text(1200, seed + doc % 7)
        d[rng.integers(0, len(d))] = 65
        start, count = suffix_dedup.runs(np.arange(len(d)) <= len(d) - WIDTH, key := suffix_dedup.window_keys(d))
        rows += [(d[s : s + c + WIDTH - 1].tobytes(), c, n - doc, key[s]) for s, c in zip(start.tolist(), count.tolist(), strict=True)]
    raw, count, doc, key = zip(*rows, strict=True)
    return b"".join(raw), np.array(count), np.array(doc), np.array(key, np.uint64)


@pytest.mark.parametrize("size", [1, 500, 5000, 1 << 20])
def test_slices_of_any_size_give_the_runs_of_smaller_documents(monkeypatch, size):
    raw, count, doc, key = bucket(30)
    ends = np.cumsum(count + WIDTH - 1)
    windows = [(k, i, raw[b - c - WIDTH + 1 :][i : i + WIDTH]) for k, (b, c) in enumerate(zip(ends.tolist(), count.tolist(), strict=True)) for i in range(c)]
    least = {}
    for k, _, w in windows:
        least[w] = min(least.get(w, doc[k]), doc[k])
    want = {(k, i) for k, i, w in windows if least[w] < doc[k]}
    monkeypatch.setattr(suffix_dedup, "SLICE", size)
    got = [(k, i) for r, step, n in zip(*map(np.ndarray.tolist, suffix_dedup.earlier_runs(raw, count, doc, key)), strict=True) for k, i in ((r, step + j) for j in range(n))]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(windows)


def test_no_runs():
    none = np.empty(0, np.int64)
    assert [len(x) for x in suffix_dedup.earlier_runs(b"", none, none, none.astype(np.uint64))] == [0, 0, 0]


def test_a_bucket_takes_the_memory_of_a_slice(monkeypatch):
    raw, count, doc, key = bucket(600)
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 12)
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 30)
    whole = peak(lambda: suffix_dedup.earlier_runs(raw, count, doc, key))
    monkeypatch.setattr(suffix_dedup, "SLICE", len(raw) // 50)
    assert peak(lambda: suffix_dedup.earlier_runs(raw, count, doc, key)) < whole / 2
