import json
import random

import pytest

from canopy.operators import query as Q
from canopy.operators.query import TreeQuery
from canopy.streaming.views import child_order, in_range

VALUES = [None, True, False, 0, -3, 7, 7, 2.5, 1e300, 2**53 + 1, "", "a", "Z", "é", "10", {"a": 1}, [1], {"a": "x"}, {"a": None, ".priority": 3}, {".priority": "p", "a": 2}, {"a": {"b": 5}}]
KEYS = ["0", "1", "10", "9", "-1", "-0", "01", "+5", "2147483647", "2147483648", "-2147483648", "a", "Z", "é", "a-b", "_x", "-Oi", "99", "5", "k", "k2"]
QUERIES = [
    TreeQuery(),
    TreeQuery().order_by_key(),
    TreeQuery().order_by_key().start_at("1").end_before("a"),
    TreeQuery().order_by_key().start_after("10").limit_to_first(4),
    TreeQuery().order_by_key().equal_to("9"),
    TreeQuery().order_by_key().start_at(5),
    TreeQuery().order_by_key().equal_to(5),
    TreeQuery().order_by_value(),
    TreeQuery().order_by_value().start_at(False),
    TreeQuery().order_by_value().end_at(7),
    TreeQuery().order_by_value().end_before(7, "9"),
    TreeQuery().order_by_value().start_at(7, "9").limit_to_last(3),
    TreeQuery().order_by_value().start_after("").limit_to_first(2),
    TreeQuery().order_by_value().equal_to(None),
    TreeQuery().order_by_value().equal_to({}),
    TreeQuery().order_by_value().equal_to(7, "5"),
    TreeQuery().order_by_child("a").start_at(1),
    TreeQuery().order_by_child("a/b").limit_to_last(2),
    TreeQuery().order_by_priority().start_at(1),
    TreeQuery().limit_to_last(0),
]


@pytest.fixture(scope="module")
def children(spark):
    rng = random.Random(1)
    rows = list(zip(KEYS, rng.sample(VALUES, len(KEYS))))
    df = spark.createDataFrame([(k, None if v is None else json.dumps(v), 1) for k, v in rows], "key string, value string, rank int")
    return rows, df.cache()


@pytest.mark.parametrize("q", QUERIES, ids=lambda q: q.identifier() + q.order)
def test_queries_are_brute_force(children, q):
    rows, df = children
    placed = sorted(((child_order(q, k, v), k) for k, v in rows), key=lambda x: x[0])
    want = [k for p, k in placed if in_range(q, p, k)]
    if q.first is not None:
        want = want[: q.first]
    elif q.last is not None:
        want = want[max(0, len(want) - q.last) :]
    assert [r.key for r in q.apply(df, value="value").collect()] == want
    assert q.apply(df.limit(0), value="value").count() == 0


def test_limits_identifiers_and_rest():
    with pytest.raises(ValueError):
        TreeQuery().limit_to_first(10_001)
    assert TreeQuery().identifier() == "default"
    a = TreeQuery().order_by_child("a").start_at(1).limit_to_first(2)
    assert a.identifier() == TreeQuery().limit_to_first(2).start_at(1).order_by_child("/a/").identifier()
    assert '".a"' in a.identifier()
    r = Q.from_rest({"orderBy": '"score"', "startAt": "25", "limitToFirst": "2"})
    assert r == TreeQuery().order_by_child("score").start_at(25).limit_to_first(2)
    assert Q.from_rest({"orderBy": '"$value"'}).order == "value" and Q.from_rest({"orderBy": '"$nothing"'}).order == "key"
    with pytest.raises(ValueError):
        Q.from_rest({"shallow": "true", "limitToFirst": "1"})
    assert TreeQuery().start_at(1).start_after(2).lower.value == 1
    f = a.rules_fields()
    assert f["orderByChild"] == "a" and f["startAt"] == 1 and f["limitToFirst"] == 2 and f["orderByKey"] is False


def test_typed_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, "x"), (10, 5, "y")], "key int, score int, __x string")
    got = [r.key for r in TreeQuery().order_by_child("score").end_at(5).apply(df).collect()]
    assert got == [2, 1, 10]
    assert TreeQuery().order_by_child("none").equal_to(None).apply(df).count() == 3
