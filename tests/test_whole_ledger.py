"""Ledger and id queries over whole tables against brute force."""

from collections import defaultdict

from tallyloom.plans import catalogue


def put(spark, tmp_path, name, rows, kinds):
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / f"{name}.parquet"))


def test_free_ids_lie_behind_a_long_taken_range(spark, tmp_path):
    put(spark, tmp_path, "customer", [(k,) for k in range(1, 251) if k != 103], "c_custkey long")
    assert [r.free_id for r in catalogue.QUERIES["lowest_free_ids"](spark, str(tmp_path)).collect()] == [f"{k:06}" for k in (103, *range(251, 260))]


def test_only_what_is_gone_has_vanished(spark, tmp_path):
    put(spark, tmp_path, "documents", [(k,) for k in range(20)], "doc_id long")
    put(spark, tmp_path, "labels", [(k,) for k in (1, 2, 7, 30)], "doc_id long")
    assert [tuple(r) for r in catalogue.QUERIES["vanished"](spark, str(tmp_path)).collect()] == [(3, 1, 17)]


def test_every_event_is_in_a_side(spark, tmp_path):
    rows = [(k, k * k % 23, "abc"[k % 3]) for k in range(80)] + [(81, 15, "d")]
    put(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string")
    best = defaultdict(dict)
    for k, user, kind in rows:
        best[user % 20][kind] = max(best[user % 20].get(kind, (-1, -1)), (k % 2, k))
    want = {g: ",".join(f"{b}={v[1]}" for b, v in sorted(m.items())) for g, m in best.items()}
    assert {r.gid: r.bindings for r in catalogue.QUERIES["nested_map_merge"](spark, str(tmp_path)).collect()} == want
