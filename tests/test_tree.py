import json

import pytest
from pyspark.sql import functions as F

from canopy import model
from canopy.operators import tree


def leaf(spark, items):
    return spark.createDataFrame([("d", p, v, 1) for p, v in items], "db string, path string, value string, key int")


@pytest.mark.parametrize(
    ("stored", "read"),
    [
        ({"0": 1, "3": 1}, [1, None, None, 1]),
        ({"0": 1, "4": 1}, {"0": 1, "4": 1}),
        ({"0": 1, "1": 1, "5": 1}, [1, 1, None, None, None, 1]),
        ({"0": 1, "1": 1, "6": 1}, {"0": 1, "1": 1, "6": 1}),
        ({"00": 1, "1": 1}, {"00": 1, "1": 1}),
        ({"a": [1, None, 2]}, {"a": [1, None, 2]}),
        ({"a": [], "b": {}, "c": None, "d": [{}]}, None),
        ([None, {"x": [[], [1]]}], [None, {"x": [None, [1]]}]),
        (5, 5),
    ],
)
def test_array_rule(spark, stored, read):
    df = spark.createDataFrame([(json.dumps(stored),)], "v string")
    got = df.select(tree.render_json("v").alias("r")).first().r
    assert (None if got is None else json.loads(got)) == read


def test_read_shallow_assemble(spark):
    t = leaf(spark, [("a/x", "1"), ("a/y/0", '"s"'), ("b", "true"), ("ab", "2"), ("-OiABC/z", "null"), (None, "1")])
    assert sorted(r.path for r in tree.subtree(t, "/a/").collect()) == ["x", "y/0"]
    assert {r.key: json.loads(r.value) for r in tree.shallow(t).filter("key <> '-OiABC'").collect()} == {"a": {".sz": 32}, "b": True, "ab": 2}
    assert {r.key: r.value for r in tree.shallow_truncated(t, "a").collect()} == {"x": True, "y": True}
    built = {r.path: json.loads(r.value) for r in tree.assemble(t.filter("path not like '-%'")).collect()}
    assert built == {"a": {"x": 1, "y": ["s"]}, "b": True, "ab": 2}
    assert {(r.parent, r.is_array) for r in tree.array_shape(t.filter("path is not null")).collect()} >= {("a/y", True), ("", False)}
    assert {r.key for r in tree.structural_fields(leaf(spark, [("q/-OiA/n", "1"), ("q/-OiA/m", "1")])).collect()} == {"n", "m", "q"}
    assert tree.assemble(t.limit(0)).count() == tree.shallow(t.limit(0)).count() == 0


def test_flatten_nulls_long_and_broken(spark):
    rows = [(1, '{"a":{"b":[1,null,{}]},"c":null}'), (2, None), (3, "{"), (4, "7"), (5, json.dumps({"t": "x" * 300_000})), (6, '{"a":{"b":[1,null,{}]},"c":null}')]
    got = tree.flatten_json(spark.createDataFrame(rows, "id long, j string"), ["id"], "j").collect()
    assert sorted((r.id, r.path, r.value[:5]) for r in got) == [(1, "a/b/0", "1"), (4, "", "7"), (5, "t", '"xxxx'), (6, "a/b/0", "1")]


def test_hash_vectors(spark):
    assert [tree.canonical(x) for x in (1.0, 1e21, 1e-7, 0.000001, -0.0, 123456789012345680000, 1.5e300, 100)] == ["1", "1e+21", "1e-7", "0.000001", "0", "123456789012345680000", "1.5e+300", "100"]
    assert tree.canonical({"b": [True, None], "a": "é\n"}) == '{"a":"é\\n","b":[true,null]}'
    assert tree._leaf_text(0.0) == "number:" + "0" * 16 and tree._leaf_text(1) == "number:3ff0000000000000"
    assert tree.sdk_hash_of(None) == tree.sdk_hash_of({}) == "" and tree.sdk_hash_of({"a": 1}) == tree.sdk_hash_of({"a": 1.0})
    assert tree.sdk_hash_of({".value": 1, ".priority": 2}) != tree.sdk_hash_of(1)
    df = spark.createDataFrame([("f" * 64,), ("abc=",), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(tree.hash_kind(F.col("h"))).collect()] == ["native", "sdk", "none", "none"]
    two = spark.createDataFrame([('{"a":1,"b":2}',), ('{ "b":2.0, "a":1 }',), (None,), ("{",)], "j string").select(tree.native_hash("j").alias("h")).collect()
    assert two[0].h == two[1].h and two[2].h is None and two[3].h is None


def test_paths_and_keys(spark):
    p = spark.createDataFrame([("/a/b/",), ("",), ("/",), ("a//b",), ("x",)], "p string")
    got = [tuple(r) for r in p.select(model.normalized(F.col("p")), model.parent(F.col("p")), model.last_segment(F.col("p")), F.size(model.segments(F.col("p"))), model.valid_path(F.col("p"))).collect()]
    assert got == [("/a/b", "a", "b", 2, True), ("/", None, None, 0, True), ("/", None, None, 0, True), ("/a//b", "a/", "b", 3, False), ("/x", "", "x", 1, True)]
    k = spark.createDataFrame([(x,) for x in ["a", "", ".p", "a.b", "a$", "k" * 769, "ключ", "a\tb", None]], "k string")
    assert [r[0] for r in k.select(model.valid_key(F.col("k"))).collect()] == [True, False, True, False, False, False, True, False, False]
    n = spark.createDataFrame([(x,) for x in ["0", "-0", "01", "+5", "2147483648", "-2147483648", "x", None, "99999999999999999999"]], "k string")
    assert [r[0] for r in n.select(model.int_key(F.col("k"))).collect()] == [0, None, None, 5, None, -(2**31), None, None, None]
    d = spark.createDataFrame([(x,) for x in ["my-db", "-a", "a--b", "A", "a" * 41]], "k string")
    assert [r[0] for r in d.select(model.valid_database(F.col("k"))).collect()] == [True, False, False, False, False]
    r = spark.createDataFrame([("a/b", "a"), ("a", "a"), ("ab", "a"), ("x", "")], "p string, a string")
    assert [x[0] for x in r.select(model.relative_to(F.col("p"), F.col("a"))).collect()] == ["b", "", None, "x"]
