"""What may enter, stay in and leave a corpus, on small frames."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text
from tallyloom.operators import corpus


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_eligible_by_normalised_key(spark):
    found = frame(spark, [(1, "https://x.org/A/B"), (2, "a/b/"), (3, "c/d"), (4, None), (5, "E/F")], "id int, url string")
    bar = [frame(spark, [("A/b",), (None,)], "url string"), frame(spark, [("https://q/e/f",)], "url string")]
    assert {r.id for r in corpus.eligible(found, bar, "url", text.repo_key).collect()} == {3, 4}
    assert {r.id for r in corpus.eligible(found, bar[1:], "url", text.repo_key, frame(spark, [("a/B",), ("e/f",)], "url string")).collect()} == {1, 2}


def test_placement(spark):
    rows = [("own", True, True, True, "x", "x", "n"), ("lost", True, True, False, "x", "x", "n"), ("same", True, False, True, "x", "y", "n"), ("edited", False, None, None, "x", "y", "n"), ("unknown", False, None, None, "x", None, "x"), ("current", False, None, None, "n", "n", "n"), ("old", False, None, None, "o", "o", "n"), ("none", None, None, None, None, "o", "n")]
    df = frame(spark, rows, "k string, owned boolean, differs boolean, restorable boolean, present string, recorded string, new string")
    got = {r.k: r.a for r in df.select("k", corpus.placement(*(F.col(c) for c in df.columns[1:])).alias("a")).collect()}
    assert got == {"own": "restored", "lost": "authored", "same": "authored", "edited": "authored", "unknown": "authored", "current": "current", "old": "written", "none": "written"}


def test_stale_groups_and_their_protection(spark):
    g = lambda *x: frame(spark, [(k,) for k in x], "group int")
    files = frame(spark, [(1, "hand"), (2, "fixture"), (2, "rev"), (3, "hand"), (4, "hand")], "group int, name string")
    run = lambda force: {r.group: r.action for r in corpus.stale(g(1, 2, 3, 4, 5, 5), g(3), g(4), files, frame(spark, [(2, "rev")], "group int, name string"), ["fixture"], force).collect()}
    assert run(False) == {1: "protect", 2: "remove", 5: "remove"} and run(True) == {1: "remove", 2: "remove", 5: "remove"}


def test_stamps(spark):
    one = frame(spark, [(1, "a"), (1, "b"), (2, "c")], "group int, role string")
    stamp = corpus.prune_stamp(one, "v", "r").first()
    assert stamp == corpus.prune_stamp(one.union(one).orderBy(F.desc("role")), "v", "r").first() and stamp.groups == 2
    assert stamp.roles != corpus.prune_stamp(frame(spark, [(1, "a"), (2, "b"), (2, "c")], "group int, role string"), "v", "r").first().roles
    corpus.refuse_pruned(None, "t")
    corpus.refuse_pruned(corpus.prune_stamp(one, "v", "r").filter("false"), "t")
    with pytest.raises(ValueError, match="t needs every role"):
        corpus.refuse_pruned(corpus.prune_stamp(one, "v", "r"), "t")


def test_observed_keys_alone_change(spark):
    old = frame(spark, [(1, "ok"), (2, "ok"), (3, "bad")], "k int, v string")
    new = frame(spark, [(2, "ok"), (2, "bad"), (4, "blank")], "k int, v string")
    rank = F.when(F.col("v") == "bad", 2).when(F.col("v") == "blank", 1).otherwise(0)
    assert {(r.k, r.v) for r in corpus.observed(old, new, ["k"], rank, ["v"]).collect()} == {(1, "ok"), (2, "bad"), (3, "bad"), (4, "blank")}


def test_rows_until_enough_are_accepted(spark):
    df = frame(spark, [("a", 1, True), ("a", 2, False), ("a", 3, True), ("a", 4, True), ("b", 1, False), ("b", 2, None)], "k string, n int, ok boolean")
    assert {(r.k, r.n) for r in corpus.until_accepted(df, ["k"], ["n"], F.col("ok"), 2).collect()} == {("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2)}


def test_features_that_move(spark):
    rows = [("f", s, d) for s, d in ((1, 1), (2, -1), (3, 1), (3, 0))] + [("g", s, 1 if s < 3 else 0) for s in range(1, 5)] + [("h", s, 1 if s < 4 else 0) for s in range(1, 101)]
    got = {r.f: (r.pairs, r.moved, r.scopes) for r in corpus.moving(frame(spark, rows, "f string, s int, d int"), "s", "f", "d").collect()}
    assert got == {"f": (4, 3, 3)}


def test_rebuilt_content(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "q"), ("c", "é"), ("d", None), ("e", "12")]
    then = corpus.content(frame(spark, rows, "k string, t string"), ["k"], "t")
    assert {r.k: (r.rows, r.bytes) for r in then.collect()} == {"a": (2, 2), "b": (1, 1), "c": (1, 2), "d": (1, 0), "e": (1, 2)}
    now = corpus.content(frame(spark, [("a", "y"), ("a", "x"), ("b", "q"), ("b", "q"), ("c", "ab"), ("e", "123"), ("f", "")], "k string, t string"), ["k"], "t")
    assert {r.k: r.verdict for r in corpus.rebuilt(then, now, ["k"]).collect()} == {"a": "same", "b": "rows", "c": "digest", "d": "missing", "e": "bytes", "f": "new"}


def test_gate_of_mutations(spark):
    rows = [
        ("fine", "a  b", "a b", "one two", "two one", ["t"], ["t"], True),
        ("copy", "a", "a", "one\n two", "one  two", [], [], True),
        ("field", "a", None, "one", "two", ["x", "y"], ["y", "z"], True),
        ("word", "a", "a", "one", "await x", [], [], None),
        ("said", "a", "a", "one", "f('await x'); // await", [], [], True),
    ]
    df = frame(spark, rows, "id string, base_f string, made_f string, base string, made string, base_texts array<string>, made_texts array<string>, compiled boolean")
    got = {r.id: r.violations for r in corpus.gate(df, {"await": r"\bawait\b"}, ["f"], ["compiled"]).collect()}
    assert got == {"fine": [], "copy": ["no change"], "field": ["f changed", "texts +z -x"], "word": ["forbidden await", "not compiled"], "said": []}
