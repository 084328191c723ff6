import json
import random

import pytest
from pyspark.sql import functions as F

from canopy.functions import ids
from canopy.operators import changefeed, control, metrics, mutations
from canopy.sources import rest, wal
from tests.replay import replay

W = "client string, request_id string, seq long, db string, op string, path string, value string"


def test_dedup_taint_and_disconnect(spark):
    rows = [("c", "r1", 1, "d", "s", "a", "1"), ("c", "r1", 5, "d", "s", "a", "1"), ("c", None, 2, "d", "s", "b", "2"), ("c", "", 3, "d", "s", "b", "2"), (None, "r1", 4, "d", "s", "b", "2")]
    assert sorted(r.seq for r in mutations.dedup(spark.createDataFrame(rows, W)).collect()) == [1, 2, 3, 4]
    p = spark.createDataFrame([("c", 5, ["x", "r"]), ("c", 1, ["r"]), ("c", 6, []), ("e", 7, ["r"]), ("c", 8, None)], "client string, seq long, pending array<string>")
    nack = spark.createDataFrame([("c", "r", 3)], "client string, request_id string, seq long")
    assert sorted(r.seq for r in mutations.untainted(p, nack).collect()) == [1, 6, 7, 8]
    reg = spark.createDataFrame([("c", 1, "s", "/on", "false"), ("c", 2, "s", "/at", '{".sv":"timestamp"}'), ("c", 3, "c", "/on", None), ("c", 9, "d", "/x", None), ("q", 1, "d", "/y", None)], "client string, seq long, op string, path string, value string")
    left = spark.createDataFrame([("c", 5, 77), ("c", 12, 99)], "client string, seq long, ts_ms long")
    assert sorted(tuple(r) for r in mutations.on_disconnect(reg, left).fillna("-").collect()) == [("c", 5, 1, "s", "at", "77"), ("c", 12, 1, "d", "x", "-")]


def test_transactions_and_conditions(spark):
    leaf = spark.createDataFrame([("d", "a/x", "1"), ("d", "a/y", '"s"'), ("d", "n", "5")], "db string, path string, value string")
    schema = "tx_id string, db string, seq long, op string, path string, value string, hash string"
    from canopy.operators.tree import canonical, sdk_hash_of
    import hashlib

    native = hashlib.sha256(canonical({"x": 1, "y": "s"}).encode()).hexdigest()
    ops = [
        ("value", "d", 1, "c", "/a", '{"y":"s","x":1.0}', None),
        ("native", "d", 1, "c", "a", None, native),
        ("sdk", "d", 1, "c", "a", None, sdk_hash_of({"x": 1, "y": "s"})),
        ("absent", "d", 1, "c", "/none", None, None),
        ("wrong", "d", 1, "c", "/n", "6", None),
        ("wrong", "d", 2, "s", "/n", "7", None),
        ("there", "d", 1, "c", "/n", None, None),
        ("bad", "d", 1, "s", "/a$", "1", None),
        ("good", "d", 1, "s", "/q", "1", None),
    ]
    v = mutations.transactions(spark.createDataFrame(ops, schema), leaf)
    assert {r.tx_id: r.reason for r in v.collect()} == {"value": None, "native": None, "sdk": None, "absent": None, "wrong": "condition_failed", "there": "condition_failed", "bad": "invalid_path", "good": None}
    assert [r.path for r in mutations.committed_ops(spark.createDataFrame(ops, schema), v).collect()] == ["/q"]


def test_values_rates_views_overlay(spark):
    v = spark.createDataFrame([("/a", "s", '{"b":1}'), ("/a", "u", "5"), ("/a", "s", "{"), ("/" + "x/" * 40, "s", "1"), (None, "s", "1")], "path string, op string, value string")
    assert [r.error for r in mutations.valid_writes(v).collect()] == [None, "invalid_data", "invalid_data", "invalid_path", "invalid_path"]
    k = spark.createDataFrame([('{".value":1,".priority":2}',), ('{".value":1,"x":2}',), ('{"a":{"b$":1}}',), ("[1]",), (None,)], "v string")
    assert [r[0] for r in k.select(mutations.valid_value_keys("v")).collect()] == [True, False, False, True, None]
    m = 1 << 20
    w = spark.createDataFrame([("a", 0, 500 * m), ("a", 1, 20 * m), ("a", 16, 70 * m), ("b", 0, 600 * m), ("a", 17, 10 * m)], "k string, t long, n long")
    assert sorted((r.k, r.t, r.allowed) for r in mutations.rate_limited(w, "k", "t", "n").collect()) == [("a", 0, True), ("a", 1, False), ("a", 16, True), ("a", 17, False), ("b", 0, False)]
    mu = spark.createDataFrame([("d", "/a/b", "s", "1"), ("d", "/", "d", None), ("e", "/a", "u", '{"x":1}')], "db string, path string, op string, value string")
    vi = spark.createDataFrame([("d", "/a"), ("d", "/a/b/c"), ("e", "/"), ("e", "/ab")], "db string, view_path string")
    ev = mutations.view_events(mutations.match_views(mu, vi))
    assert sorted((r.db, r.v_path, r.relation, r.ev, r.rel_path, r.data) for r in ev.collect()) == [
        ("d", "a", "above", "put", "/", "null"), ("d", "a", "below", "put", "/b", "1"), ("d", "a/b/c", "above", "put", "/", "null"), ("d", "a/b/c", "above", "put", "/", "null"), ("e", "", "below", "patch", "/", '{"a/x":1}')]
    t = spark.createDataFrame([("d", "a/x", "1"), ("d", "a/y", "2"), ("d", "b", "3")], "db string, path string, value string")
    u = spark.createDataFrame([("d", "a/x", None), ("d", "b/c", "9")], "db string, path string, value string")
    assert sorted((r.path, r.value) for r in mutations.overlay(t, u).collect()) == [("a/y", "2"), ("b/c", "9")]


def test_log_files(spark, tmp_path):
    (tmp_path / "000003.wal").write_text('{"o":"s","p":"/a","v":{"x":1}}\n{"o":"d","p":"/a/x"}\n')
    (tmp_path / "000004.wal").write_text('{"o":"u","p":"/","v":{"b":2}}\n{"o":"s","p":"/t')
    log = wal.read_log(spark, str(tmp_path))
    assert sorted(tuple(r) for r in wal.check(log, 3).select("sequence", "line_no", "op", "path").collect()) == [(3, 1, "s", "/a"), (3, 2, "d", "/a/x"), (4, 1, "u", "/")]
    assert wal.read_log(spark, str(tmp_path), after=3).count() == 2
    with pytest.raises(wal.LogError):
        wal.check(log, 1)
    (tmp_path / "000005.wal").write_text('{"o":"s","p":"/z","v":1}\n')
    with pytest.raises(wal.LogError):
        wal.check(wal.read_log(spark, str(tmp_path)))
    out = spark.createDataFrame([(7, 1, "s", '/q"x', '{"a":1}'), (7, 2, "d", "/q", None)], "sequence long, line_no int, op string, path string, value string")
    wal.append_log(out, str(tmp_path / "new"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "new")).collect()]
    assert sorted(map(str, lines)) == sorted(map(str, [{"o": "s", "p": '/q"x', "v": {"a": 1}}, {"o": "d", "p": "/q"}]))


def test_compaction_is_replay(spark):
    from tests.test_changefeed import SCHEMA, random_feed, rows_of

    feed = random_feed(random.Random(11), 120)
    df = spark.createDataFrame([(*r, 0) for r in feed], SCHEMA)
    snap = changefeed.state_at(df, 9)
    assert rows_of(wal.compact(spark, snap, df.filter("sequence > 9"))) == replay(feed)
    assert rows_of(wal.compact(spark, None, df)) == replay(feed)


def test_rest_and_ids(spark):
    r = spark.createDataFrame([("1", "get", "/a.json", None, 5, None), ("2", "POST", "/a.json", "1", 5, None), ("3", "PATCH", "/a/b.json", "{}", 5, None), ("4", "DELETE", "/a.json", None, 5, "tag"), ("5", "PUT", "/a", "1", 5, None), ("6", "HEAD", "/a.json", "1", 5, None)], "request_id string, method string, path string, body string, ts_ms long, if_match string")
    got = {x.request_id: x for x in rest.to_operations(r).collect()}
    assert {k: x.op for k, x in got.items()} == {"1": "o", "2": "s", "3": "u", "4": "s"} and got["2"].path == "a/" + got["2"].name and got["4"].value == "null"
    e = spark.createDataFrame([("put", '/a"b', '{"x":1}')], "e string, p string, d string").select(rest.parse_sse(rest.sse(F.col("e"), F.col("p"), F.col("d"))).alias("x")).first().x
    assert (e.event, e.path, e.data) == ("put", '/a"b', '{"x":1}')
    f = spark.createDataFrame([("p", "/a", "1"), ("m", "/a", '{"x/y":1}'), ("m", "/a", '{"x":1}'), ("zz", "/", "1")], "action string, path string, body string")
    assert [x.op for x in rest.sdk_operations(f).collect()] == ["s", "tx", "u"]
    h = spark.createDataFrame([("",), ("a",), ("foobar",), (None,)], "t string").select(ids.fnv1a32("t").alias("f"), ids.xxh64_hex("t").alias("x")).collect()
    assert [x.f for x in h] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968, None] and h[0].x == "ef46db3751d8e999"


def test_metrics_and_control(spark):
    df = spark.createDataFrame([("k", v) for v in [5, 1, 9, 7, 3, None, 9]] + [("z", None)], "k string, v int")
    r = metrics.exact_percentiles(df, ["k"], "v").collect()
    assert [(x.n, x.p50, x.p90, x.p99) for x in r] == [(6, 5, 9, 9)]
    assert metrics.exact_percentiles(df, ["k"], "v", (50,), "round").first().p50 == 7
    ev = spark.createDataFrame([("a", 0), ("a", 299), ("a", 300), ("a", 599), ("b", 5), ("a", None)], "k string, t long")
    assert sorted((x.k, x.t) for x in metrics.with_cooldown(ev, ["k"], "t").collect()) == [("a", 0), ("a", 300), ("b", 5)]
    assert metrics.time_range(None, 10**6, 0) == (10**6 - 86_400, 10**6)
    for bad in ((5, 5), (0, 31 * 86_400)):
        with pytest.raises(ValueError):
            metrics.time_range(*bad, 0)
    s = spark.createDataFrame([("s1", "active", 90), ("s2", "active", 95), ("s3", "draining", 99)], "id string, status string, last_heartbeat long")
    h = control.healthy(s, F.lit(100), 9)
    assert [x.id for x in h.collect()] == ["s2"]
    d = spark.createDataFrame([("d1", "s1"), ("d2", "s2"), ("d3", None)], "id string, server_id string")
    assert {x.id: x.server_id for x in control.assign(d, h, F.xxhash64("id")).collect()} == {"d1": "s2", "d2": "s2", "d3": "s2"}
    assert {x.server_id for x in control.assign(d, h.limit(0), F.xxhash64("id")).collect()} == {None}
    assert control.page(d, "id", limit=0).count() == 3 and control.page(d, "id", limit=1, offset=1).first().id == "d2"
    up = spark.createDataFrame([("d1", None), ("d9", "s9")], "id string, server_id string")
    assert {x.id: x.server_id for x in control.upsert(d, up, ["id"], ("server_id",)).collect()} == {"d1": "s1", "d2": "s2", "d3": None, "d9": "s9"}


def test_view_events_above_and_below(spark):
    mu = spark.createDataFrame([(1, "d", "/a", "s", '{"b":{"c":1},"z":2}'), (2, "d", "/a", "u", '{"b/x":3,"z":4}'), (3, "d", "/a", "u", '{"z":4}'), (4, "d", "/a/b/q", "u", '{"r":1,"/s/t/":null}'), (5, "d", "/a/b", "u", "7"), (6, "d", "/", "u", '{"a":{"b":[5]}}'), (7, "d", "/a/b/k", "s", "{")], "n int, db string, path string, op string, value string")
    ev = mutations.view_events(mutations.match_views(mu, spark.createDataFrame([("d", "/a/b")], "db string, view_path string")))
    assert sorted((r.n, r.ev, r.rel_path, r.data) for r in ev.collect()) == [(1, "put", "/", '{"c":1}'), (2, "patch", "/", '{"x":3}'), (4, "patch", "/", '{"q/r":1,"q/s/t":null}'), (6, "put", "/", "[5]")]


def test_increments_in_payloads(spark):
    inc = lambda d: json.dumps({".sv": {"increment": d}})
    writes = [
        ("d", 1, "s", "/n", inc(2)),  # 5 + 2
        ("d", 2, "u", "/", f'{{"n":{inc(0.5)},"/m/x/":{inc(1)}}}'),  # 7.5; nothing there
        ("d", 3, "s", "/m", '{"x":10,"y":"t"}'),
        ("d", 4, "s", "/m", f'{{"x":{inc(3)},"k":[{inc(1)}]}}'),  # the write replaces /m, so x counts from 0
        ("d", 5, "u", "/m", f'{{"x":{inc(4)}}}'),
        ("d", 6, "d", "/n", None),
        ("d", 7, "s", "/n", inc(1)),
        ("d", 8, "s", "/n/deep", "1"),
        ("d", 9, "s", "/n", inc(6)),  # a container counts 0
        ("d", 10, "s", "/b", inc("x")),
        ("e", 1, "s", "/n", inc(1)),
        ("e", 2, "s", "/t", '"plain"'),
    ]
    w = spark.createDataFrame(writes, "db string, seq long, op string, path string, value string")
    leaf = spark.createDataFrame([("d", "n", "5"), ("e", "n", '"text"')], "db string, path string, value string")
    got = {(r.db, r.seq): r.value if r.error is None else r.error for r in mutations.resolve_increments(w, leaf).collect()}
    assert got == {
        ("d", 1): "7", ("d", 2): '{"n":7.5,"/m/x/":1}', ("d", 3): '{"x":10,"y":"t"}', ("d", 4): '{"x":3,"k":[1]}', ("d", 5): '{"x":7}', ("d", 6): None,
        ("d", 7): "1", ("d", 8): "1", ("d", 9): "6", ("d", 10): "invalid_data", ("e", 1): "1", ("e", 2): '"plain"'}


def test_transactions_see_those_before(spark):
    schema = "tx_id string, db string, tx_seq long, seq long, op string, path string, value string, hash string"
    ops = [
        ("a", "d", 1, 1, "c", "/n", "1", None), ("a", "d", 1, 2, "s", "/n", "2", None),
        ("b", "d", 2, 1, "c", "/n", "2", None), ("b", "d", 2, 2, "u", "/n", '{"x":{"y":1},"z":null}', None),
        ("c", "d", 3, 1, "c", "/n", "2", None), ("c", "d", 3, 2, "s", "/n", "9", None),
        ("e", "d", 4, 1, "c", "/n/x/y", "1.0", None), ("e", "d", 4, 2, "d", "/n/x", None, None),
        ("f", "d", 5, 1, "c", "/n", None, None), ("f", "d", 5, 2, "s", "/o/p", "1", None),
        ("g", "d", 6, 1, "c", "/o", '{"p":1,"q":[true]}', None),
        ("h", "d", 7, 1, "s", "/$", "1", None),
        ("i", "q", 1, 1, "c", "/k/v", None, None), ("i", "q", 1, 2, "s", "/k/v", "1", None),
        ("j", "q", 2, 1, "c", "/k/v", None, None), ("j", "q", 2, 2, "s", "/k/v", "2", None),
    ]
    leaf = spark.createDataFrame([("d", "n", "1"), ("d", "o/q/0", "true")], "db string, path string, value string")
    got = {r.tx_id: r.reason for r in mutations.transactions_in_order(spark.createDataFrame(ops, schema), leaf).collect()}
    assert got == {"a": None, "b": None, "c": "condition_failed", "e": None, "f": None, "g": None, "h": "invalid_path", "i": None, "j": "condition_failed"}
    assert mutations.transactions_in_order(spark.createDataFrame([], schema), leaf).count() == 0


def test_conditional_writes_and_size_cap(spark):
    from canopy.operators.tree import sdk_hash_of

    leaf = spark.createDataFrame([("d", "a", "1")], "db string, path string, value string")
    w = [(1, "d", 1, "s", "/a", "2", sdk_hash_of(1), True), (2, "d", 2, "s", "/a", "3", sdk_hash_of(1), True), (3, "d", 3, "s", "/b", "1", "", True), (4, "d", 4, "s", "/b", "2", "", True), (5, "d", 5, "s", "/b", "null", sdk_hash_of(1), True), (6, "d", 6, "s", "/b", "5", None, False)]
    got = mutations.conditional_writes(spark.createDataFrame(w, "id long, db string, seq long, op string, path string, value string, h string, hp boolean"), leaf)
    assert {r.id: r.committed for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}
    full = spark.createDataFrame([("/a", "s", "1", 1 << 40), ("/a", "d", None, 1 << 41), ("/a", "s", "null", 1 << 41), ("/a", "s", "1", None)], "path string, op string, value string, size long")
    assert [r.error for r in mutations.valid_writes(full, "size").collect()] == ["database_full", None, None, None]


def test_on_disconnect_caps(spark):
    reg = [("c", i, "s", f"/p{i}", "1") for i in range(1, 151)] + [("c", 151, "c", "/p7", None), ("c", 152, "s", "/late", "2")]
    reg += [("big", 1, "s", "/x", "9" * (1 << 19)), ("big", 2, "s", "/y", "9" * (1 << 20)), ("big", 3, "s", "/z", "9" * (1 << 19)), ("big", 4, "s", "/w", "1")]
    gone = spark.createDataFrame([("c", 200, 1), ("big", 9, 1), ("c", 300, 1)], "client string, seq long, ts_ms long")
    got = {}
    for r in mutations.on_disconnect(spark.createDataFrame(reg, "client string, seq long, op string, path string, value string"), gone).collect():
        got.setdefault((r.client, r.seq), []).append((r.idx, r.path))
    assert [p for _, p in sorted(got[("c", 200)])] == [f"p{i}" for i in range(1, 101) if i != 7] + ["late"]
    assert sorted(got[("big", 9)]) == [(1, "x"), (2, "z")] and ("c", 300) not in got


def test_log_written_is_read_back(spark, tmp_path):
    rows = [(7, 1, "s", '/q"x', '{"a":1}'), (7, 2, "d", "/q", None), (12, 1, "u", "/", '{"k":"ü"}')]
    wal.append_log(spark.createDataFrame(rows, "sequence long, line_no int, op string, path string, value string"), str(tmp_path / "log"))
    (tmp_path / "log" / "000013.wal").write_text('{"o":"s","p":"/z","v":1}\n')
    got = wal.read_log(spark, str(tmp_path / "log")).select("sequence", "line_no", "op", "path", "value")
    assert sorted(map(tuple, got.collect())) == [*rows, (13, 1, "s", "/z", "1")]


def test_answers(spark):
    df = spark.createDataFrame([('{"b":[1,{}],"a":{"x":null}}',), ("[]",), ("{",), (None,)], "v string")
    assert [r[0] for r in df.select(rest.formatted(F.col("v"), "pretty")).collect()] == ['{\n  "a": {\n    "x": null\n  },\n  "b": [\n    1,\n    {}\n  ]\n}', "[]", None, None]
    assert df.select(rest.formatted(F.col("v"), callback="f")).first()[0] == 'f({"b":[1,{}],"a":{"x":null}});' and df.select(rest.formatted(F.col("v"), "silent")).first()[0] == ""
    assert rest.headers({"download": 'a"b.json'}) == {"Content-Type": "application/json; charset=utf-8", "Content-Disposition": 'attachment; filename="ab.json"'}


def test_one_bad_deep_value_ends_no_job(spark):
    from canopy.operators import tree

    deep = '{"a":' * 3000 + "1" + "}" * 3000
    df = spark.createDataFrame([(deep,), ("{" * 9000,)], "v string")
    r = df.select(tree.render_json("v"), tree.native_hash("v"), tree.sdk_hash("v"), tree.value_size(F.col("v")), tree.value_depth(F.col("v")), mutations.valid_value_keys("v")).collect()
    assert r[0][0] == deep and r[0][3:] == (12 + 3000 * 6, 3000, True) and None not in r[0] and list(r[1]) == [None] * 6


def test_recent_requests_are_remembered(spark):
    rows = [("c", "a", 1), ("c", "b", 2), ("c", "a", 3), ("c", "d", 4), ("c", "a", 5), ("c", None, 6), ("c", "", 7), (None, "a", 8), (None, "a", 9), ("q", "a", 1)]
    w = spark.createDataFrame(rows, "client string, request_id string, seq long")
    assert sorted((r.client or "-", r.seq) for r in mutations.dedup_recent(w, 2).collect()) == [("-", 8), ("-", 9), ("c", 1), ("c", 2), ("c", 4), ("c", 5), ("c", 6), ("c", 7), ("q", 1)]


def test_reads_are_bounded_and_samples_ingested(spark, tmp_path, monkeypatch):
    from canopy.operators import query

    c = spark.createDataFrame([("a", "1"), ("b", '{"x":[]}'), ("c", None)], "key string, value string")
    assert query.TreeQuery().result(c).first().value == '{"a":1}' and query.TreeQuery().result(c.limit(0)).first().value is None
    monkeypatch.setattr(query, "READ_BYTES", 5)
    with pytest.raises(Exception, match="a read of more than"):
        query.TreeQuery().result(c).collect()
    (tmp_path / "s.json").write_text('[{"type":"db_metrics","ts":5,"project":"p","database":"d","writes":3},{"type":"db_metrics","project":""},{"type":"core"}]')
    assert [(r.project, r.writes) for r in metrics.ingest(wal.read_samples(spark, str(tmp_path / "s.json"))).collect()] == [("p", 3)]
    up = spark.createDataFrame([("s1", "active", 10), ("s2", "active", 99), (None, "active", 0)], "id string, status string, last_heartbeat long")
    d = spark.createDataFrame([("d1", "s1", "active"), ("d2", "s2", "active"), ("d3", None, "idle")], "id string, server_id string, status string")
    assert {r.id: (r.server_id, r.status) for r in control.sweep(d, up, F.lit(100), 9).collect()} == {"d1": (None, "inactive"), "d2": ("s2", "active"), "d3": (None, "idle")}


def test_answer_options():
    assert rest.answer_options({"print": "pretty", "timeout": "3min", "callback": "f"}) == {"callback": "f", "print": "pretty", "timeout": 180, "shallow": False}
    for bad in ({"print": "loud"}, {"timeout": "0s"}, {"timeout": "16min"}, {"timeout": "5"}):
        with pytest.raises(ValueError):
            rest.answer_options(bad)
