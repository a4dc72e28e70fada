"""Filter interaction audit against a brute-force version over every order."""

import re
from collections import defaultdict
from itertools import permutations

import pytest

from tallyloom.llm import filter_audit

ROWS = [
    (1, "plain words of a short text", "s", "x"), (2, "plain words of a short text", "s", "x"), (2, "plain words of a short text", "s", "x"),
    (3, None, None, "x"), (4, "", "s", "x"), (5, "ABC DEF " * 120, "t", "x"), (6, " ".join(f"w{i}" for i in range(250)), "t", "x"),
    (7, " ".join(f"w{i}" for i in range(250)) + " 100% & more", "t", "x"), (8, "a b\x0bc " * 90, "t", None), (None, "plain words of a short text", "s", "x"),
    (None, None, None, None), (0, "late copy", "s", "x"), (9, "late copy", "t", "x"), (10, "é" * 60_000 + " $", "s", "x"), (11, "same same " * 400_000, "s", "x"),
]
LABELS = [(1, 1, 0), (2, None, 1), (2, 1, 0), (5, 0, 1), (6, 1, None), (None, 1, 1), (99, 1, 1), (9, 1, 1), (9, 1, 1)]


def brute(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    cells = []
    for i, text, source, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text))}
        failed["E"] = i is not None and any(j is not None and j < i and (t or "") == text for j, t, *_ in rows)
        cells.append((source or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out, shapley = {}, defaultdict(int)
    for part in {c[0] for c in cells}:
        for order in permutations("ABCDE"):
            left = [c for c in cells if c[0] == part]
            gone = []
            for k, f in enumerate(order):
                here, left = [c for c in left if f in c[1]], [c for c in left if f not in c[1]]
                out[part, "".join(order), k + 1] = [len(left), len(here), sum(f in c[1] for c in gone), sum(c[1] == {f} for c in cells if c[0] == part), sum(c[2] for c in here), sum(c[3] for c in here)]
                shapley[part, f] += len(here)
                gone += here
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, mask string"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_against_brute_force(frames):
    docs, labels = frames
    got = filter_audit.filter_interactions(docs.repartition(3), labels, filter_audit.text_failures(), "E").collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[4:] for r in got} == brute(ROWS, LABELS) and len(got) == 3 * 600


def test_empty_tables(frames):
    docs, labels = frames
    run = lambda d, x: filter_audit.filter_interactions(d, x, filter_audit.text_failures(), "E")
    assert run(docs.filter("false"), labels).count() == 0
    assert {tuple(r)[8:10] for r in run(docs, labels.filter("false")).collect()} == {(0, 0)}


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 3, 10, 4, 1), ("p", 0, 5, 5, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(cells, "XY").collect()}
    assert got == {("XY", 1): (5, 10, 0, 10), ("XY", 2): (5, 0, 10, 10), ("YX", 1): (5, 10, 0, 10), ("YX", 2): (5, 0, 10, 10)}
    with pytest.raises(ValueError):
        filter_audit.audit(cells, "XX")
