import json
import random

from canopy.operators.query import TreeQuery
from canopy.streaming import views

QUERIES = {
    "first": TreeQuery().order_by_value().limit_to_first(3),
    "last": TreeQuery().order_by_value().limit_to_last(2),
    "range": TreeQuery().order_by_child("s").start_at(3).end_at(8).limit_to_first(3),
    "all": TreeQuery().order_by_key().start_at("2"),
}


def window(q, state):
    placed = sorted(((views.child_order(q, k, v), k) for k, v in state.items()), key=lambda x: x[0])
    keys = [k for p, k in placed if views.in_range(q, p, k)]
    return keys[: q.first] if q.first is not None else keys[max(0, len(keys) - q.last) :] if q.last is not None else keys


def test_events_rebuild_every_window(spark, tmp_path):
    rng = random.Random(4)
    rows, seq = [], 0
    for _ in range(300):
        seq += 1
        qid, key = rng.choice(list(QUERIES)), str(rng.randrange(7))
        value = None if rng.random() < 0.25 else {"s": rng.randrange(12)} if qid == "range" else rng.randrange(12)
        rows.append(("d", "/v", qid, seq, key, None if value is None else json.dumps(value), "x"))
    schema = "db string, view_path string, query_id string, seq long, key string, value string, ord string"
    for part in (rows[:150], rows[150:]):
        rng.shuffle(part)  # order inside a batch does not matter
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = views.run_available(views.live_views(stream, QUERIES), str(tmp_path / "run")).collect()
    by_seq = {}
    for e in sorted(got, key=lambda e: (e.seq, e.ord)):
        by_seq.setdefault(e.seq, []).append(e)
    state, seen = {q: {} for q in QUERIES}, {q: {} for q in QUERIES}
    for _, _, qid, s, key, value, _ in sorted(rows, key=lambda r: r[3]):
        before = dict(state[qid])
        if value is None:
            state[qid].pop(key, None)
        else:
            state[qid][key] = json.loads(value)
        for e in by_seq.get(s, []):
            changes = {e.rel_path[1:]: json.loads(e.data)} if e.ev == "put" else json.loads(e.data)
            for k, v in changes.items():
                seen[qid].pop(k, None) if v is None else seen[qid].__setitem__(k, v)
        want = {k: state[qid][k] for k in window(QUERIES[qid], state[qid])}
        assert seen[qid] == want, (s, qid, before, by_seq.get(s))


def test_volatile_and_empty(spark):
    df = spark.createDataFrame([("a", "2026-01-05 00:00:00.010", 1, 1), ("a", "2026-01-05 00:00:00.040", 2, 2), ("a", "2026-01-05 00:00:00.040", 3, 3), ("a", "2026-01-05 00:00:00.060", 4, None)], "k string, t string, s long, v int")
    df = df.withColumn("t", df.t.cast("timestamp_ntz"))
    got = sorted((r.value, r.coalesced) for r in views.volatile_flush(df, ["k"], "t", 50, "v", "s").fillna(-1).collect())
    assert got == [(-1, 1), (3, 3)]
    assert views.volatile_flush(df.limit(0), ["k"], "t", 50, "v", "s").count() == 0


def test_deep_writes_subscriptions_and_replaced_collections(spark, tmp_path):
    q = {"top": TreeQuery().order_by_child("s/n").limit_to_first(2)}
    mu = [
        (1, "s", "/v", '{"a":{"s":{"n":1}},"b":{"s":{"n":2}},"c":{"s":{"n":3}}}'),
        (3, "s", "/v/a/s/n", "9"),  # a falls behind the edge: c follows
        (4, "u", "/v", '{"b/s/n":null,"c/t":true}'),
        (5, "s", "/v/z/t", "1"),  # null orders first
        (6, "d", "/v/b", None),
        (7, "d", "/", None),
        (9, "s", "/v/k", "1"),
    ]
    views_ = spark.createDataFrame([("d", "/v", "top")], "db string, view_path string, query_id string")
    rows = views.view_changes(spark.createDataFrame([("d", *m) for m in mu], "db string, seq long, op string, path string, value string"), views_)
    sub = spark.createDataFrame([("d", "v", "top", s, 0, None, None, None, k) for s, k in ((2, "sub"), (8, "unsub"), (10, "sub"))], rows.select("db", "view_path", "query_id", "seq", "part", "key", "value", "rel", "kind").schema)
    rows.unionByName(sub).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = views.run_available(views.live_views(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), q), str(tmp_path / "run"))
    events = [(e.seq, e.ev, e.rel_path, json.loads(e.data)) for e in sorted(got.collect(), key=lambda e: (e.seq, e.ord))]
    a, b, c = {"s": {"n": 1}}, {"s": {"n": 2}}, {"s": {"n": 3}}
    assert events[:3] == [(1, "put", "/", {"a": a, "b": b}), (2, "put", "/", {"a": a, "b": b}), (3, "patch", "/", {"a": None, "c": c})]
    window, seen = {}, []
    for s, ev, rel, data in events:
        for k, v in ({rel[1:]: data} if rel != "/" else data or {}).items():
            window.pop(k, None) if v is None else window.__setitem__(k, v)
        if rel == "/" and ev == "put":
            window = dict(data or {})
        seen.append((s, dict(window)))
    last = dict(seen)
    assert last[3] == {"b": b, "c": c}
    assert last[4] == {"c": {"s": {"n": 3}, "t": True}, "a": {"s": {"n": 9}}}
    assert last[5] == {"z": {"t": 1}, "c": {"s": {"n": 3}, "t": True}}
    assert last[7] == {} and last[9] == {"k": 1} == last[10]
