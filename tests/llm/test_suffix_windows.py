"""Windows of the suffix-array dedup: numbers without gaps, keys by blocks, both ways of sorting."""

import numpy as np
import pytest

from tallyloom.llm import suffix_dedup, suffixes


def texts():
    rng = np.random.default_rng(4)
    for letters, n in ((2, 400), (4, 3000), (26, 3000), (1, 300)):
        d = rng.integers(97, 97 + letters, n).astype(np.uint8)
        d[n // 2 : n // 2 + 120] = d[:120]
        d[-70:] = d[20:90]
        yield d
    yield np.zeros(200, np.uint8)


@pytest.mark.parametrize("width", [8, 12, 50])
def test_equal_windows_have_one_number_and_numbers_have_no_gaps(width):
    for d in texts():
        valid = np.arange(len(d)) <= len(d) - width
        valid[:3] = False
        got, raw = suffixes.equal_windows(d, valid, width), d.tobytes()
        want = [raw[p : p + width] for p in np.flatnonzero(valid).tolist()]
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))
        assert sorted(set(got.tolist())) == list(range(len(set(want))))


def test_windows_of_no_place():
    assert len(suffixes.equal_windows(np.zeros(60, np.uint8), np.zeros(60, bool), 50)) == 0


def test_suffixes_are_in_order_to_the_depth():
    for d in texts():
        raw, order = d.tobytes(), suffixes.suffix_order(d, 50)
        cut = [raw[p : p + 50].ljust(50, b"\0") for p in order.tolist()]
        assert cut == sorted(cut) and sorted(order.tolist()) == list(range(len(d)))


def test_keys_are_the_same_in_blocks_of_any_size(monkeypatch):
    for d in texts():
        want = suffix_dedup.keys_of(d)[: len(d) - 49]
        for n in (1, 7, 64, 1000):
            monkeypatch.setattr(suffix_dedup, "BLOCK", n)
            assert (suffix_dedup.window_keys(d)[: len(d) - 49] == want).all()
        for n in (0, 1, 9, 49):
            assert len(suffix_dedup.window_keys(d[:n])) == n
