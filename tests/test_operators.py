"""Operators on small frames with known answers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import joins, ordered, resample, rules, stats
from tallyloom.sources import files, sinks


def one(df):
    return [tuple(r) for r in df.collect()]


def test_cliffs_delta_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(a), float(v)) for g in "abc" for a, v in zip(rng.integers(0, 2, 40), rng.integers(0, 8, 40))]
    got = {r.g: r.delta for r in stats.cliffs_delta(spark.createDataFrame(rows, "g string, arm int, v double"), ["g"], "arm", "v").collect()}
    for g in "abc":
        l, r = ([v for k, a, v in rows if k == g and a == arm] for arm in (0, 1))
        assert got[g] == pytest.approx(np.mean([np.sign(y - x) for x in l for y in r]))


def test_cliffs_delta_without_an_arm_is_null(spark):
    assert one(stats.cliffs_delta(spark.createDataFrame([("a", 0, 1.0)], "g string, arm int, v double"), ["g"], "arm", "v").select("delta")) == [(None,)]


def test_effect_bands(spark):
    rows = [(0.146,), (-0.147,), (0.33,), (0.331,), (0.474,), (None,)]
    assert [r[0] for r in one(spark.createDataFrame(rows, "d double").select(stats.effect_band(F.col("d"))))] == ["negligible", "small", "small", "medium", "large", None]


def test_warmup_uses_all_rows_when_nothing_follows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(3)] + [("b", i, float(i)) for i in range(12)], "k string, i int, v double")
    got = {r.k: (r.n_raw, r.n_used, r.warmup_dropped, r.median) for r in ordered.trimmed_median(df, ["k"], ["i"], "v", 10).collect()}
    assert got == {"a": (3, 3, 0, 1.0), "b": (12, 2, 10, 10.5)}


def test_drift_slope_equals_least_squares_and_zero_when_constant(spark):
    rng = np.random.default_rng(5)
    rows = [("g", int(r), float(x), float(2 * x + r + e)) for r in (0, 1, 2) for x, e in zip(rng.random(9), rng.random(9))] + [("h", 0, 0.5, 1.0), ("h", 1, 0.7, 2.0)]
    got = {r.g: r.slope for r in stats.drift_slope(spark.createDataFrame(rows, "g string, r int, x double, y double"), "g", "r", "x", "y").collect()}
    a = np.array([[x, r == 0, r == 1, r == 2] for g, r, x, _ in rows if g == "g"], float)
    assert got["g"] == pytest.approx(np.linalg.lstsq(a, np.array([y for g, *_, y in rows if g == "g"]), rcond=None)[0][0])
    assert got["h"] == 0


def test_auc_and_average_precision_with_ties(spark):
    rng = np.random.default_rng(6)
    rows = [("k", int(s), int(y)) for s, y in zip(rng.integers(0, 6, 60), rng.integers(0, 2, 60))]
    r = stats.ranking_metrics(spark.createDataFrame(rows, "k string, s int, y int"), ["k"], "s", "y").first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    assert r.auc == pytest.approx(np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]))


def test_bh_against_definition(spark):
    p = [0.01, 0.04, 0.03, 0.03, 0.5]
    got = sorted((r.p, round(r.q, 6)) for r in stats.bh_qvalues(spark.createDataFrame([("k", x) for x in p], "k string, p double"), ["k"], "p").collect())
    assert got == [(0.01, 0.05), (0.03, 0.05), (0.03, 0.05), (0.04, 0.05), (0.5, 0.5)]


def test_interval_join_has_no_nested_loop_and_keeps_edges(spark):
    p = spark.createDataFrame([("a", t) for t in (0, 9, 10, 20, 21)] + [("b", 10)], "k string, t long")
    w = spark.createDataFrame([("a", 1, 10, 20), ("a", 2, 30, 25)], "k string, w int, s long, e long")
    j = joins.interval_join(p, w, "k", "t", "s", "e", 7)
    assert sorted(r.t for r in j.collect()) == [10, 20]
    assert "NestedLoop" not in j._jdf.queryExecution().toString()


def test_full_compare(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", None), (3, "z", 3)], "k int, a string, b int")
    b = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (4, "w", 4)], "k int, a string, b int")
    assert {r.k: (r.status, r.fields) for r in joins.full_compare(a, b, ["k"], ["a", "b"]).collect()} == {1: ("same", []), 2: ("changed", ["b"]), 3: ("missing", []), 4: ("added", [])}


def test_upsert_fresh_wins_ties(spark):
    t, f = spark.createDataFrame([(1, "old", 5), (2, "old", 9)], "k int, v string, t int"), spark.createDataFrame([(1, "new", 5), (2, "new", 8), (3, "new", 1)], "k int, v string, t int")
    assert sorted(one(joins.upsert(t, f, ["k"], [F.desc("t")]))) == [(1, "new", 5), (2, "old", 9), (3, "new", 1)]


def test_precedence_and_work_list(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted((r.k, r.v) for r in joins.precedence_merge([a, b], ["k"]).collect()) == [(1, "a"), (2, "b")]
    assert one(joins.work_list(b, a, ["k"])) == [(2, "b")]


def test_hysteresis(spark):
    v = [50, 90, 70, 60, 20, 50, 90, 85, 10]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, i int, v double")
    assert [r.paused for r in ordered.hysteresis(df, ["k"], ["i"], "v", 80, 20).orderBy("i").collect()] == [0, 1, 1, 1, 0, 0, 1, 1, 0]


def test_revisions_handle_nulls(spark):
    df = spark.createDataFrame([("a", i, d) for i, d in enumerate(["x", "x", None, None, "y"])], "k string, i int, d string")
    assert [(r.status, r.rev) for r in ordered.revisions(df, ["k"], ["i"], "d").orderBy("i").collect()] == [("new", "rev_001"), ("unchanged", "rev_001"), ("new", "rev_002"), ("unchanged", "rev_002"), ("new", "rev_003")]


def test_verdicts(spark):
    df = spark.createDataFrame([(1, True, None), (2, None, True), (3, True, True)], "k int, h boolean, s boolean")
    v = rules.group_verdict(rules.firings(df, "k", {"H": F.col("h"), "S": F.col("s")}), rules.hard_set(["H", "S"], ["S"]), ["S"])
    assert {r.k: (r.excluded_by, r.flagged_by, r.eligible) for r in v.collect()} == {1: (["H"], [], False), 2: ([], ["S"], True), 3: (["H"], ["S"], False)}
    assert rules.hard_set(["H", "S"], ["S"], strict=True) == ["H", "S"]


def test_gate_ladder(spark):
    df = spark.createDataFrame([(50.0, 90), (99.0, 90), (50.0, 25), (50.0, 5), (50.0, None)], "t double, b int")
    assert [r[0] for r in one(df.select(rules.gate(F.col("t"), F.col("b"), 10, 30, 80.0)))] == ["proceed", "cool", "pause", "pause", "abort"]


def test_text_functions(spark):
    df = spark.createDataFrame([("https://x.org/Own/Repo.git/", "the c++ x", "v=1.20.3 w= ok")], "u string, t string, h string")
    r = df.select(T.repo_key(F.col("u")), T.detect(F.col("t"), ["c++", "th", "x"]), T.version_at_least(F.col("h"), r"(\d+)\.(\d+)\.(\d+)", (1, 3, 0)), T.header_field(F.col("h"), "w"), T.header_field(F.col("h"), "v")).first()
    assert tuple(r) == ("own_repo", ["c++", "x"], True, None, "1.20.3")


def test_spdx_needs_every_phrase(spark):
    p = {"MIT": ("permission is hereby granted", "mit license"), "Apache-2.0": ("apache license", "version 2.0")}
    rows = [("The MIT License. Permission is hereby granted",), ("MIT License",), ("Apache License, Version 2.0; MIT License, permission is hereby granted",)]
    assert [r[0] for r in one(spark.createDataFrame(rows, "t string").select(T.spdx(F.col("t"), p)))] == ["MIT", None, None]


def test_binomial_and_interval():
    assert resample.binomial_tail(5, 5, 0.5) == pytest.approx(1 / 32)
    for n, p in ((1, 0.5), (7, 0.2), (40, 0.01), (60, 0.9), (200, 0.5)):
        exact = [math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(n + 1)]
        for k in range(n + 2):
            assert resample.binomial_tail(k, n, p) == pytest.approx(float(sum(exact[k:])), rel=1e-10, abs=1e-300)
    assert resample.binomial_tail(500_000, 1_000_000, 0.5) == pytest.approx(0.5003989, abs=1e-6)
    low, high = resample.clopper_pearson(3_000_000, 10_000_000)
    assert low == pytest.approx(0.3 - 1.96 * math.sqrt(0.21e-7), abs=1e-6) and high == pytest.approx(0.3 + 1.96 * math.sqrt(0.21e-7), abs=1e-6)
    assert resample.clopper_pearson(0, 10) == (0.0, pytest.approx(0.308497, abs=1e-5))
    low, high = resample.clopper_pearson(86, 110)
    assert (round(low, 3), round(high, 3)) == (0.693, 0.855)


def test_bootstrap_brackets_the_share(spark):
    df = spark.createDataFrame([(g, int(i % 3 == 0)) for g in range(50) for i in range(9)], "g int, y int")
    r = resample.percentile_interval(resample.group_bootstrap(df, "g", F.sum("y"), F.count("*"), 100, 1), "share").first()
    assert r.low <= 1 / 3 <= r.high and r.used == 100


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "0007").mkdir()
    (tmp_path / "0007" / "rev_002_ab12cd34.dart").write_text("x")
    (tmp_path / "0007" / "notes.txt").write_text("x")
    assert [tuple(r)[:3] for r in files.revision_files(spark, str(tmp_path)).collect()] == [("0007", 2, "ab12cd34")]
    log = tmp_path / "log"
    log.mkdir()
    (log / "a.log").write_text("perf=30 ok=true vm=\nspan=5\nspan=0\nspan=7\n")
    r = files.capture_headers(spark, str(log), {"perf": "int", "vm": "int", "ok": "boolean"}).first()
    assert (r.perf, r.vm, r.ok) == (30, None, True)
    assert sorted((r.idx, r.us) for r in files.readings(spark, str(log), r"span=(\d+)").collect()) == [(0, 5), (1, 7)]
    ids = tmp_path / "ids.txt"
    ids.write_text("7, 12 # torn\n\n# none\n0003\n")
    assert sorted((r.id, r.reason) for r in files.id_list(spark, str(ids), 4).collect()) == [("0003", None), ("0007", "torn"), ("0012", "torn")]


def test_journal_drops_a_torn_tail_and_voids_earlier_damage(spark, tmp_path):
    (tmp_path / "a").write_text('{"k": 1}\n{"k": 2}\n{"k": ')
    (tmp_path / "b").write_text('{"k": 1}\n{"k"\n{"k": 3}\n')
    assert sorted(r.k for r in files.journal(spark, str(tmp_path), "k int").collect()) == [1, 2]


def test_image_band(spark):
    import struct
    import zlib

    rows = b"".join(b"\x00" + bytes([9 * y, 0, 0] * 2) for y in range(4))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    got = files.image_bands(spark.createDataFrame([("p", bytearray(png))], "path string, content binary"), 0.5, 1.0)
    assert sorted((r.rgb >> 16, r.n) for r in got.collect()) == [(18, 2), (27, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 0.5)], "k int, v double")
    sinks.csv(df, str(tmp_path / "c"))
    assert sorted((r.k, r.v) for r in spark.read.csv(str(tmp_path / "c"), header=True, schema="k int, v double").collect()) == [(1, None), (2, None), (3, 0.5)]
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    with pytest.raises(ValueError, match="no rows"):
        sinks.require_rows(df.filter("k > 9"), "k > 9")


def test_streams_equal_the_batch_form(spark, tmp_path):
    from tallyloom.streaming import telemetry

    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(int(i % 3), i, float(v)) for i, v in enumerate(rng.integers(0, 100, 60))], "k long, i long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = telemetry.pause_state(stream, "k", "i", "v", 80, 20).writeStream.format("memory").queryName("paused").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {(r.k, r.i): r.paused for r in ordered.hysteresis(df, ["k"], ["i"], "v", 80, 20).collect()}
    assert {(r.k, r.i): r.paused for r in spark.sql("SELECT * FROM paused").collect()} == batch
