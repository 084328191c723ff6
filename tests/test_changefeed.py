import json
import random

import pytest

from canopy.operators import changefeed as cf
from tests.replay import replay

SCHEMA = "project_id string, database_id string, sequence long, line_no int, op string, path string, value string, batch int"


def rows_of(df):
    return {(r.project_id, r.database_id, r.path): (json.loads(r.value), (r.sequence, r.line_no)) for r in df.collect()}


def random_feed(rng, n):
    def value(depth=0):
        k = rng.random()
        if depth > 2 or k < 0.45:
            return rng.choice([None, 1, 2.5, "x", True, False, {}, [], "ü"])
        if k < 0.8:
            return {rng.choice("abc"): value(depth + 1) for _ in range(rng.randrange(3))}
        return [value(depth + 1) for _ in range(rng.randrange(3))]

    out = []
    for i in range(n):
        path = "/".join(rng.choice("abc01") for _ in range(rng.choice([0, 1, 1, 2, 2, 3])))
        path = rng.choice(["", "/"]) + path + rng.choice(["", "/"])
        op = rng.choice("sssuud")
        if op == "d":
            v = None
        elif op == "s":
            v = None if rng.random() < 0.1 else json.dumps(value())
        else:
            v = json.dumps({"/".join(rng.choice("abc") for _ in range(rng.choice([1, 1, 2]))): value(1) for _ in range(rng.randrange(1, 3))})
        row = ("p", rng.choice("de"), i // 5, i % 5, op, path, v)
        out.append(row)
        if v and v[0] in "{[" and rng.random() < 0.3:
            out.append((*row[:6], v[: len(v) // 2] if rng.random() < 0.5 else v.replace(":", ": ")))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_state_at_is_the_sequential_replay(spark, seed):
    feed = [r for i in range(40) for r in ((f"{r[0]}{i}", *r[1:]) for r in random_feed(random.Random(seed * 1000 + i), 25))]
    df = spark.createDataFrame([(*r, 0) for r in feed], SCHEMA)
    got = rows_of(cf.state_at(df))
    assert got == replay(feed)


def test_stream_in_batches_and_again(spark, tmp_path):
    feed = random_feed(random.Random(7), 150)
    for i in range(4):
        spark.createDataFrame([(*r, i) for r in feed[i::4]], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at = str(tmp_path / "run")
    got = rows_of(cf.current_leaves(spark, str(tmp_path / "in"), at=at, files_per_batch=1))
    assert got == replay(feed)
    more = random_feed(random.Random(8), 30)
    spark.createDataFrame([(*r, 9) for r in more], SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    assert rows_of(cf.current_leaves(spark, str(tmp_path / "in"), at=at)) == replay(feed + more)


def test_nulls_empty_ties_and_extra_columns(spark):
    feed = [
        ("p", "d", 1, 1, "s", "/a", '{"b":1,"c":[null,{"x":true}],"e":{}}'),
        ("p", "d", 1, 1, "s", "a/", '{"b": 1, "c": [null, {"x": true}]}'),
        ("p", "d", 1, 2, "s", "/z", "NaN"),
        ("p", "d", 1, 3, "u", "/a", "null"),
        ("p", "d", 1, 4, "u", "/a", "[1]"),
        ("p", "d", 1, 5, "d", "/a/b/c", None),
        ("p", None, 1, 1, "s", "/a", "1"),
        ("p", "d", None, 1, "d", "/", None),
        ("p", "d", 2, 1, "d", None, None),
        ("p", "d", 2, 2, None, "/", None),
        ("p", "d", 3, 1, "s", "/long", json.dumps("y" * 200_000)),
    ]
    df = spark.createDataFrame([(*r, 0) for r in feed], SCHEMA).withColumnRenamed("batch", "payload")
    got = rows_of(cf.state_at(df))
    assert got == replay(feed)
    assert set(got) == {("p", "d", "/a/b"), ("p", "d", "/a/c/1/x"), ("p", "d", "/long")}
    assert cf.state_at(df.limit(0)).count() == 0
    assert cf.state_at(df, 0).count() == 0


def test_scalar_is_replaced_for_good(spark):
    feed = [
        ("p", "d", 1, 1, "s", "/a", "5"),
        ("p", "d", 1, 2, "d", "/a/b", None),
        ("p", "d", 1, 3, "s", "/q", "5"),
        ("p", "d", 1, 4, "s", "/q/r", "6"),
        ("p", "d", 1, 5, "d", "/q/r", None),
    ]
    got = rows_of(cf.state_at(spark.createDataFrame([(*r, 0) for r in feed], SCHEMA)))
    assert got == {("p", "d", "/a"): (5, (1, 1))} == replay(feed)


def test_table_is_the_replay(spark, sf):
    t = spark.read.parquet(f"{sf}/wal_entries.parquet")
    got = rows_of(cf.current_leaves(spark, f"{sf}/wal_entries.parquet"))
    assert got == replay([tuple(r) for r in t.select(*cf.FEED).collect()])


@pytest.mark.parametrize("seed", range(3))
def test_one_hot_database_is_cut_into_parts(spark, seed):
    """Parts begin below marks with payloads, tombstones and scalars; keys that hold slashes name places twice."""
    rng = random.Random(100 + seed)
    feed = [("p", "d", *r[2:]) for r in random_feed(rng, 400)]
    feed += [("p", "d", 900, i, "s", "a", json.dumps({k: {x: i for x in "abc"} for k in "abc01"})) for i in range(2)]
    feed += [("p", "d", 901, i, "s", f"a/{rng.choice('abc')}/{rng.choice('abcd')}/{i}", "1") for i in range(60)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        assert rows_of(cf.state_at(spark.createDataFrame([(*r, 0) for r in feed], SCHEMA))) == replay(feed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_deep_values_odd_keys_and_slashes(spark):
    deep = '{"a":' * 3000 + "[7]" + "}" * 3000
    feed = [
        ("p", "d", 1, 1, "s", "/deep", deep),
        ("p", "d", 1, 2, "s", "/odd", json.dumps({"x\0y": 1, "x\1": 2, "x": {"z": 3}, "a/b": 4, "a": {"b": {"c": 5}}})),
        ("p", "d", 1, 3, "d", "/odd/x", None),
        ("p\1", "d\0", 1, 1, "s", "", "1e999"),
    ]
    got = {(r.project_id, r.path): r.value for r in cf.state_at(spark.createDataFrame([(*r, 0) for r in feed], SCHEMA)).collect()}
    assert got == {("p", "/deep" + "/a" * 3000 + "/0"): "7", ("p", "/odd/x\0y"): "1", ("p", "/odd/x\1"): "2", ("p", "/odd/a/b/c"): "5", ("p\1", "/"): "1e999"}
