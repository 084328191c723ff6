import json

import pytest
from pyspark.sql import functions as F

from canopy.rules import syntax
from canopy.rules.engine import Rules, can_read, can_write, revoked, writes_at

TREE = [("d", "users/u1/name", '"ann"'), ("d", "users/u1/age", "30"), ("d", "open", "true"), ("d", "admins/u2", "true"), ("d", "n", "5"), ("d", "z", "0")]
REQ = "id long, db string, path string, auth struct<uid: string, provider: string, token: map<string, string>>, now double, op string, value string"


def evaluate(spark, expressions, auth=("u1", "custom", {"lvl": "7"}), db="p/d"):
    """Truth of each expression as a .read rule of its own path."""
    rules = {f"e{i}": {".read": e} for i, e in enumerate(expressions)}
    reqs = spark.createDataFrame([(i, db, f"/e{i}", auth, 1000.0, "o", None) for i in range(len(expressions))], REQ)
    leaf = spark.createDataFrame([(db, p, v) for _, p, v in TREE], "db string, path string, value string")
    got = {r.id: r.allowed for r in can_read(reqs, leaf, Rules({"rules": rules})).collect()}
    return [got[i] for i in range(len(expressions))]


def test_expressions(spark):
    cases = {
        "auth != null && auth.uid === 'u1'": True,
        "auth.token.lvl === 7": True,
        "auth.token.lvl > '10'": False,
        "auth.hasOwnProperty('uid')": True,
        "1 + 1 == '2'": True,
        "'a' + 1 === 'a1'": True,
        "1 + true === 2": True,
        "5 / 0 === 0 && 7 % 0 === 0 && -7 % 3 === -1 && 7.9 % 2 === 1": True,
        "!'' && !0 && !null && !false": True,
        "'abc' - 1": True,  # NaN is true
        "('x' - 1) < 5 || ('x' - 1) >= 5": False,
        "null == 0": False,
        "null === null": True,
        "true === 1": False,
        "'b' > 'a' && 'Z' < 'a'": True,
        "true ? false : true": False,
        "'hello'.contains('ell') && 'hello'.beginsWith('he') && 'hello'.endsWith('lo')": True,
        "'hello'.matches(/^h.l+o$/)": True,
        "'HELLO'.matches(/hello/i)": True,
        "'aXbX'.replace('X','-') === 'a-b-' && ' t\\t'.trim() === 't' && 'ab'.toUpperCase() === 'AB'": True,
        "'ab'.replace('', '-') === '-a-b-'": True,
        "'\\ud83d\\udd25'.length === 2 || '🔥'.length === 2": True,
        "['a','b'].includes('b') && ['a'].length === 1": True,
        "root.child('users/' + auth.uid).exists()": True,
        "root.child('users').child(auth.uid).child('age').val() >= 18": True,
        "root.child('users/u1').hasChildren(['name','age']) && !root.child('users/u1').hasChild('x')": True,
        "root.child('users/u1').hasChildren()": True,
        "root.child('users/u1/name').isString() && root.child('n').isNumber() && root.child('open').isBoolean()": True,
        "root.child('users/u1/name').parent().child('age').val() === 30": True,
        "root.child('z').exists() && !root.child('none').exists()": True,
        "unknown": False,
        "'x'.nothing()": False,
        "f(1)": False,
        "now === 1000": True,
        "env.databaseId === 'd' && env.projectId === 'p'": True,
        "data.exists()": False,
        "3 // no comment here\n": None,
    }
    good = {e: w for e, w in cases.items() if w is not None}
    for i in range(0, len(good), 8):
        part = list(good)[i : i + 8]
        assert dict(zip(part, evaluate(spark, part), strict=True)) == {e: good[e] for e in part}


def test_syntax_errors():
    for bad in ("1 +", "(1", "a b", "'x", "#", "1 2", "."):
        with pytest.raises(syntax.RuleError):
            syntax.parse(bad)
    assert json.loads(syntax.strip_comments('{"a": "x // y", /* c */ "b": 1 // d\n}')) == {"a": "x // y", "b": 1}
    with pytest.raises(syntax.RuleError):
        Rules({"rules": {"$a": {}, "$b": {}}})


def test_cascade_wildcards_and_validate(spark):
    rules = Rules(
        """{"rules": { // users
          "users": {"$uid": {".read": "auth.uid === $uid", ".write": "auth.uid === $uid && newData.child('age').val() > data.child('age').val()",
                    ".validate": "newData.hasChildren(['name'])", "age": {".validate": "newData.isNumber()"}},
                    "public": {".read": true}},
          "admin": {".write": "root.child('admins/' + auth.uid).val() === true"}}}"""
    )
    leaf = spark.createDataFrame(TREE, "db string, path string, value string")
    a1, a2 = ("u1", None, None), ("u2", None, None)
    reqs = [
        (1, "d", "/users/u1", a1, 1.0, "o", None),
        (2, "d", "/users/u1/name", a1, 1.0, "o", None),
        (3, "d", "/users/u1", a2, 1.0, "o", None),
        (4, "d", "/users/public/x", None, 1.0, "o", None),
        (5, "d", "/", a1, 1.0, "o", None),
    ]
    got = {r.id: r.allowed for r in can_read(spark.createDataFrame(reqs, REQ), leaf, rules).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False}
    writes = [
        (1, "d", "/users/u1", a1, 1.0, "s", '{"name":"x","age":31}'),
        (2, "d", "/users/u1", a1, 1.0, "s", '{"name":"x","age":29}'),
        (3, "d", "/users/u1", a1, 1.0, "s", '{"age":31}'),
        (4, "d", "/users/u1/age", a1, 1.0, "s", "40"),
        (5, "d", "/users/u1/age", a1, 1.0, "s", '"40"'),
        (6, "d", "/admin/x", a2, 1.0, "d", None),
        (7, "d", "/admin/x", a1, 1.0, "d", None),
        (8, "d", "/users/u1", None, 1.0, "s", '{"name":"x","age":31}'),
    ]
    got = {r.id: r.allowed for r in can_write(spark.createDataFrame(writes, REQ), leaf, rules).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False}
    assert can_read(spark.createDataFrame([], REQ), leaf, rules).count() == 0


def test_no_rules_allow(spark):
    leaf = spark.createDataFrame(TREE, "db string, path string, value string")
    reqs = spark.createDataFrame([(1, "d", "/a", None, 1.0, "s", "1")], REQ)
    for rules in (None, Rules({}), Rules({"rules": {}})):
        assert [r.allowed for r in can_read(reqs, leaf, rules).collect()] == [True] == [r.allowed for r in can_write(reqs, leaf, rules).collect()]
    assert revoked(reqs, leaf, Rules({"rules": {".write": True}})).count() == 1 and revoked(reqs, leaf, None).count() == 0


def test_updates_see_the_tree_and_fall_back_to_their_keys(spark):
    rules = Rules({"rules": {
        "users": {"$u": {".write": "newData.hasChildren(['name','age']) && newData.child('age').isNumber()", ".validate": "newData.child('name').exists()", "age": {".validate": "newData.val() < 200"}}},
        "free": {"a": {".write": True}, "b": {".write": "newData.val() === 1"}, "c": {"d": {".write": True}}},
        "count": {".write": "newData.parent().child('n').val() === 5 && root.child('n').val() === 5"}}})
    leaf = spark.createDataFrame(TREE, "db string, path string, value string")
    writes = [
        (1, "/users/u1", "u", '{"age":5}', True),  # the stored name counts
        (2, "/users/u1", "u", '{"name":null}', False),
        (3, "/users/u9", "u", '{"age":5}', False),
        (4, "/users/u1", "u", '{"age":500}', False),
        (5, "/users/u1", "s", '{"age":5}', False),
        (6, "/free", "u", '{"a":9,"b":1}', True),
        (7, "/free", "u", '{"a":9,"b":2}', False),
        (8, "/free", "u", '{"c/d":{"x":1}}', True),
        (9, "/free", "u", '{"c":1}', False),
        (10, "/free", "u", "5", False),
        (11, "/users", "u", '{"u1/age":7}', True),
        (12, "/count", "s", "1", True),
        (13, "/free/a", "d", None, True),
        (14, "/users/u1", "u", "{", False),
    ]
    reqs = spark.createDataFrame([(i, "d", p, None, 1.0, op, v) for i, p, op, v, _ in writes], REQ)
    assert {r.id: r.allowed for r in can_write(reqs, leaf, rules).collect()} == {w[0]: w[4] for w in writes}


def test_writes_at(spark):
    rows = [(1, "s", "/", '{"v":{"a":1,"b":[2]}}'), (2, "s", "/v/a/x", "1"), (3, "u", "/v", '{"a/b":1,"a/c":2,"q":null}'), (4, "u", "/", '{"v/a/b":{"x":1},"v/a":{"k":3},"w":1}'), (5, "d", "/v", None), (6, "d", "/v/a", None), (7, "s", "/w", "1")]
    got = {}
    for r in writes_at(spark.createDataFrame(rows, "id int, op string, path string, value string"), F.lit("/v/")).collect():
        got.setdefault(r.id, {})[r.name] = json.loads(r.child_value)
    assert got == {1: {"a": 1, "b": [2]}, 2: {"a": {"x": 1}}, 3: {"a": {"b": 1, "c": 2}, "q": None}, 4: {"a": {"k": 3, "b": {"x": 1}}}, 6: {"a": None}}
