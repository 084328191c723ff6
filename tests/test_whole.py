"""Queries over whole tables, on small tables where a cut would show."""

from datetime import datetime, timedelta

import __spark_entry__ as entry

T0 = datetime(2026, 1, 5)


def run(spark, at, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{table}.parquet")
    return entry.queries()[name](spark, str(at)).collect()


def test_rollup_keeps_rows_without_a_size(spark, tmp_path):
    from canopy.operators import metrics

    rows = [(T0, "p", *[3] * 11, 9, 10, 20), (T0, "p", *[4] * 11, None, 30, 0), (T0, "q", *[5] * 11, None, 0, None)]
    schema = "ts timestamp_ntz, project_id string, " + ", ".join(f"{c} long" for c in [*metrics.COUNTERS, "data_size_bytes", "p50_latency_us", "p99_latency_us"])
    got = {r.project_id: (r.writes, r.reads, r.p50_latency_us, r.p99_latency_us) for r in run(spark, tmp_path, "metrics_rollup", "database_metrics", rows, schema)}
    assert got == {"p": (7, 7, 20.0, 20.0), "q": (5, 5, 0.0, 0.0)}


def test_windows_hold_all_databases_of_a_project(spark, tmp_path):
    rows = [(1, T0, "p", "a", 5, 100, 7), (2, T0, "p", "b", 8, 50, 2), (3, T0, "p", "b", 6, 60, 3), (4, T0 + timedelta(hours=6), "p", "a", 0, 1, 1)]
    got = run(spark, tmp_path, "window_accumulate", "database_metrics", rows, "id long, ts timestamp_ntz, project_id string, database_id string, writes long, data_size_bytes long, ccu long")
    assert [(r.writes, r.last_data_size_bytes, r.max_ccu) for r in got] == [(11, 60, 7)]


def test_whole_texts_are_keys(spark, tmp_path):
    texts = ["k" * 768, "k" * 769, "a good beginning/", "a good beginning.", ".hidden", "é" * 385, "", None, "a\u2028."]
    got = {r.doc_id: r.valid for r in run(spark, tmp_path, "key_validation", "documents", list(enumerate(texts)), "doc_id long, text string")}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 8: False}


def test_every_value_and_key_has_its_place(spark, tmp_path):
    rows = [(i, "click", float(-i)) for i in range(12_000)]
    got = sorted(run(spark, tmp_path, "mixed_type_order", "events", rows, "event_id long, event_type string, value double"), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 12_001))
    of = {0: (0,), 1: (2,), 2: (4,), 3: (3,), 4: (5,)}
    want = sorted(range(12_000), key=lambda i: (of[i % 5], -i if i % 5 == 3 else 0, i))
    assert [int(r.key) for r in got] == want
    keys = run(spark, tmp_path, "order_by_key_int_first", "customer", [(i,) for i in range(1, 3000)], "c_custkey long")
    name = {0: "k{}", 1: "0{}", 2: "-{}"}
    made = [name[i % 4].format(i) if i % 4 < 3 else str(i * 1000003) for i in range(1, 3000)]
    number = lambda k: k[0] not in "0k" and abs(int(k)) < 2**31
    want = sorted(made, key=lambda k: (not number(k), int(k) if number(k) else 0, k))
    assert [r.key for r in sorted(keys, key=lambda r: r.place)] == want


def test_page_is_over_all_events(spark, tmp_path):
    rows = [(i, T0 - timedelta(seconds=i), i, "click") for i in range(200)]
    got = run(spark, tmp_path, "events_page", "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    assert [r.event_id for r in got] == list(range(100, 150))
