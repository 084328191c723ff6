"""Deciding requests by a rules tree: cascades of .read and .write, .validate on what is written.

Requests have id (unique), db, path, auth (struct<uid, provider, token: map<string,string>> or
null; token values are JSON), now (ms) and, for writes, op and value. The tree is a leaf
table (db, path, value). Rules are JSON with comments. Without rules (None, or a text that
holds none) everything is allowed; an admin (``is_admin``) passes; a null or broken value denies.

All places of the tree that the rules of a request table ask for are answered together. The
places asked for are counted and reduced to distinct ones before they meet the tree; the answers
of those that a thousandth of all lookups ask for (fewer than ``HOT``) are broadcast, so no
task of the join with the rest gets more than that of one place.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy import model
from canopy.functions.jsontext import INVALID, children, dump, has_leaf, parse
from canopy.model import CONTAINER, NULL
from canopy.operators.tree import flatten_json
from canopy.rules import syntax
from canopy.session import written
from canopy.rules.compiler import Compiler, Val, literal, null, of_number, of_string, of_struct

#: Strings over this many bytes read as null in a rule.
VAL_BYTES = 100 << 10
#: A place that more than one in so many lookups ask for is answered by broadcast; fewer than this can be.
HOT = 1000
NODE = T.StructType([T.StructField("rank", T.IntegerType()), T.StructField("num", T.DoubleType()), T.StructField("str", T.StringType())])


class Rules:
    """A parsed rules text: (segments, literal siblings per segment, kind, expression) of each rule."""

    def __init__(self, text: str | dict, environment: str = "env"):
        self.environment = environment  # the variable that holds databaseId and projectId
        tree = json.loads(syntax.strip_comments(text)) if isinstance(text, str) else text
        self.rules: list[tuple[list[str], list[list[str]], str, tuple]] = []
        self.sources: list[str] = []
        self._walk(tree.get("rules", tree), [], [])

    def _walk(self, node, path, siblings):
        names = [k for k in node if not k.startswith(".")]
        if len([k for k in names if k.startswith("$")]) > 1:
            raise syntax.RuleError("one wildcard per node")
        for kind in (".read", ".write", ".validate"):
            if kind in node:
                e = node[kind]
                text = str(e).lower() if isinstance(e, bool) else e
                self.rules.append((path, siblings, kind[1:], syntax.parse(text)))
                self.sources.append(text)
        for k in names:
            self._walk(node[k], [*path, k], [*siblings, [x for x in names if not x.startswith("$")]])

    def simple(self, i: int) -> bool:
        """Whether a rule reads nothing of the tree, as volatile writes need."""
        return "data." not in self.sources[i] and "root." not in self.sources[i]


def _applies(path: list[str], siblings: list[list[str]], segs: Column, exactly: bool) -> Column:
    ok = F.size(segs) == len(path) if exactly else F.size(segs) >= len(path)
    for i, (name, others) in enumerate(zip(path, siblings, strict=True)):
        s = F.get(segs, F.lit(i))
        ok = ok & (~s.isin(others) if others else F.lit(True)) if name.startswith("$") else ok & (s == name)
    return F.coalesce(ok, F.lit(False))


def _snap(source: str, path: Column) -> Val:
    return Val(F.lit(CONTAINER), F.lit(0.0), F.lit(""), snap=(source, path))


def _auth() -> Val:
    a = F.col("auth")

    def member(name):
        if name == "token":
            return Val(F.when(a["token"].isNull(), NULL).otherwise(CONTAINER), F.lit(0.0), F.lit(""), members=lambda k: of_struct(model.sort_key(F.try_element_at(a["token"], F.lit(k)))))
        return of_string(a[name]) if name in ("uid", "provider") else null()

    return Val(F.when(a.isNull(), NULL).otherwise(CONTAINER), F.lit(0.0), F.lit(""), members=member)


def _names(path: list[str], segs: Column, query: dict | None, environment: str = "env") -> dict[str, Val]:
    here = F.array_join(F.slice(segs, 1, len(path)), "/")
    out = {"auth": _auth(), "data": _snap("data", here), "newData": _snap("new", here), "root": _snap("data", F.lit("")), "now": of_number(F.col("now"))}
    out["query"] = Val(F.lit(CONTAINER), F.lit(0.0), F.lit(""), members=lambda k: literal((query or {}).get(k)))
    ids = {"databaseId": F.substring_index("db", "/", -1), "projectId": F.substring_index("db", "/", 1)}
    out[environment] = Val(F.lit(CONTAINER), F.lit(0.0), F.lit(""), members=lambda k: of_string(ids[k]) if k in ids else null())
    for i, name in enumerate(path):
        if name.startswith("$"):
            out[name] = of_string(F.get(segs, F.lit(i)))
    return out


_BOX = (CONTAINER, 0.0, "")


def nodes(leaf: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """db, path, node (rank, num, str) of every leaf and container, or of those ``asked`` for (db, path; distinct)."""
    only = lambda df: df if asked is None else df.join(asked, ["db", "path"], "left_semi")
    own = only(leaf.select("db", model.trimmed(F.col("path")).alias("path"), "value")).select("db", "path", model.sort_key(F.col("value")).alias("node"))
    box = F.struct(F.lit(CONTAINER).alias("rank"), F.lit(0.0).alias("num"), F.lit("").alias("str"))
    above = only(leaf.select("db", F.explode(model.prefixes(F.col("path"), strict=True)).alias("path"))).distinct().withColumn("node", box)
    return own.unionByName(above)


def _node_at(v, rel: str) -> tuple[int, float, str]:
    for k in filter(None, rel.split("/")):
        v = dict(children(v)).get(k) if isinstance(v, (dict, list)) else None
    if isinstance(v, (dict, list)):
        return _BOX if has_leaf(v) else (NULL, 0.0, "")
    if v is None:
        return NULL, 0.0, ""
    if isinstance(v, bool):
        return (2 if v else 1), 0.0, ""
    return (3, float(v), "") if isinstance(v, (int, float)) else (4, 0.0, v)


def _written(op: str, path: str, value) -> list[tuple[str, object]]:
    """(path, value) of each subtree a write replaces, without outer slashes."""
    path, v = path.strip("/"), None if op == "d" or value is None else parse(value)
    if v is INVALID:
        v = None
    if op != "u":
        return [(path, v)]
    return [(f"{path}/{k.strip('/')}".strip("/"), v[k]) for k in sorted(v)] if isinstance(v, dict) else []


@F.pandas_udf(T.ArrayType(T.StructType([*NODE.fields, T.StructField("own", T.BooleanType())])))
def _new_nodes(op: pd.Series, w_path: pd.Series, value: pd.Series, paths: pd.Series) -> pd.Series:
    """The nodes at some paths as a write would leave them; ``own`` is false where the tree decides.

    Inside what is written the payload decides; above it there is a container if anything
    written stays; elsewhere, and above what only removes, the tree does. A payload is read once.
    """

    def node(written, p):
        if p is None:
            return NULL, 0.0, "", False
        box = False
        for at, v in written:
            if p == at or at == "" or p.startswith(at + "/"):
                return *_node_at(v, p[len(at) :]), True
            box = box or ((p == "" or at.startswith(p + "/")) and (has_leaf(v) if isinstance(v, (dict, list)) else v is not None))
        return (*_BOX, True) if box else (NULL, 0.0, "", False)

    def one(o, w, text, ps):
        written = [] if w is None else _written(o, w, text)
        return [dict(zip(("rank", "num", "str", "own"), node(written, p), strict=True)) for p in ps]

    return pd.Series([one(*row) for row in zip(op, w_path, value, paths)], dtype=object)


def _answer(rows: DataFrame, keys: list[str], leaf: DataFrame, lookups) -> DataFrame:
    """``rows`` (one per ``keys``) with a column ``__n{i}`` per lookup."""
    if not lookups:
        return rows
    places = F.array(*[model.trimmed(path) for _, path in lookups])
    pairs = rows.select(*keys, "db", F.posexplode(places).alias("__i", "__p")).filter("__p is not null")
    on = ["db", "__p"]
    asked = written(pairs.groupBy("db", F.col("__p").alias("path")).agg(F.count("*").alias("n")), "asked")
    total = asked.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(asked.filter(F.col("n") * HOT > F.lit(total)).select("db", "path"))  # fewer than HOT rows
    often = F.broadcast(nodes(leaf, hot).withColumnRenamed("path", "__p"))
    answers = nodes(leaf, asked.select("db", "path")).withColumnRenamed("path", "__p")
    told = pairs.join(often, on).unionByName(pairs.join(hot.withColumnRenamed("path", "__p"), on, "left_anti").join(answers, on))
    told = told.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == i, F.col("node"))).alias(f"__t{i}") for i in range(len(lookups))])
    out = rows.join(told, keys, "left")
    new = [i for i, (source, _) in enumerate(lookups) if source == "new"]
    if new:
        out = out.withColumn("__w", _new_nodes(F.col("op"), F.col("w_path"), F.col("value"), F.array(*[model.trimmed(lookups[i][1]) for i in new])))
    for i in range(len(lookups)):
        node = F.col(f"__t{i}")
        if i in new:
            made = F.get("__w", F.lit(new.index(i)))
            node = F.when(made["own"], F.struct(made["rank"].alias("rank"), made["num"].alias("num"), made["str"].alias("str"))).otherwise(node)
        out = out.withColumn(f"__n{i}", F.when(F.octet_length(node.getField("str")) <= VAL_BYTES, node))
    return out


def _decide(requests: DataFrame, leaf: DataFrame, rules: Rules, kind: str, query: dict | None, volatile: bool, keys: list[str]) -> tuple[DataFrame, Column]:
    segs = model.segments(F.col("path"))
    compiler = Compiler({})
    verdict = F.lit(False)
    for i, (path, siblings, k, tree) in enumerate(rules.rules):
        if k == kind and (not volatile or rules.simple(i)):
            compiler.names = _names(path, segs, query, rules.environment)
            verdict = verdict | (_applies(path, siblings, segs, False) & compiler.boolean(tree))
    return _answer(requests, keys, leaf, compiler.lookups), verdict


def can_read(requests: DataFrame, leaf: DataFrame, rules: Rules | None, query: dict | None = None) -> DataFrame:
    """``requests`` with ``allowed``: any rule on the way to the path grants."""
    if rules is None or not rules.rules:
        return requests.withColumn("allowed", F.lit(True))
    answered, verdict = _decide(requests, leaf, rules, "read", query, False, ["id"])
    return answered.select(*requests.columns, (_admin(requests) | verdict).alias("allowed"))


def revoked(subscriptions: DataFrame, leaf: DataFrame, rules: Rules | None) -> DataFrame:
    """Subscriptions (requests) that may not read their path any more, as after a change of rules or auth."""
    return can_read(subscriptions, leaf, rules).filter(~F.col("allowed")).drop("allowed")


def _admin(requests: DataFrame) -> Column:
    return F.coalesce(F.col("is_admin"), F.lit(False)) if "is_admin" in requests.columns else F.lit(False)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])))
def _update_keys(value: pd.Series) -> pd.Series:
    """The keys of an UPDATE with their values as JSON text; null for what is no object."""
    return value.map(lambda t: [{"key": k, "value": dump(x)} for k, x in sorted(v.items())] if isinstance(v := parse(t), dict) else None)


def can_write(requests: DataFrame, leaf: DataFrame, rules: Rules | None, volatile: bool = False) -> DataFrame:
    """``requests`` (with op and value) with ``allowed``: a .write grants on the way, and every .validate
    on the path and on each node written below it passes. Deletes (and SETs of null) skip .validate. An UPDATE that
    is denied as a whole is allowed if each of its keys is, as a SET of its own."""
    if rules is None or not rules.rules:
        return requests.withColumn("allowed", F.lit(True))
    cols = [c for c in ("id", "db", "path", "auth", "now", "op", "value") if c in requests.columns]
    whole = requests.select(*cols, F.lit(-1).alias("__k"))
    keyed = requests.filter("op = 'u'").select(*cols, F.posexplode(_update_keys("value")).alias("__k", "__e"))
    single = keyed.select(*[c for c in cols if c not in ("path", "op", "value")], model.joined(F.col("path"), F.col("__e.key")).alias("path"), F.lit("s").alias("op"), F.col("__e.value").alias("value"), "__k")
    judged = _can_write(whole.unionByName(single), leaf, rules, volatile)
    verdict = judged.groupBy("id").agg(F.max(F.when(F.col("__k") < 0, F.col("ok"))).alias("__whole"), F.min(F.when(F.col("__k") >= 0, F.col("ok"))).alias("__each"))
    shape = F.schema_of_variant(F.try_parse_json("value"))
    sound = (F.col("op") == "d") | (F.col("value").isNull() & (F.col("op") == "s")) | F.when(F.col("op") == "u", F.startswith(shape, F.lit("OBJECT"))).otherwise(shape.isNotNull())
    allowed = F.coalesce(sound, F.lit(False)) & (F.coalesce("__whole", F.lit(False)) | F.coalesce("__each", F.lit(False)))
    return requests.join(verdict, "id", "left").select(*requests.columns, (_admin(requests) | allowed).alias("allowed"))


def _can_write(writes: DataFrame, leaf: DataFrame, rules: Rules, volatile: bool) -> DataFrame:
    """id, __k, ok of each write (one per id and ``__k``)."""
    key = ["id", "__k"]
    answered, verdict = _decide(writes.withColumn("w_path", F.col("path")), leaf, rules, "write", None, volatile, key)
    granted = answered.select(*key, verdict.alias("__w"))
    # a key of an update is validated even if it takes something away
    something = F.col("value").isNotNull() & (F.trim("value") != "null")
    put = writes.filter((F.col("op") != "d") & (something | (F.col("__k") >= 0))).withColumn("w_path", F.col("path"))
    below = flatten_json(put, key, "value").select(*key, F.explode(model.prefixes(F.col("path"))).alias("rel"))
    below = below.unionByName(put.select(*key, F.lit("").alias("rel"))).distinct()
    at = put.join(below, key).withColumn("path", model.joined(F.col("w_path"), F.col("rel"))).drop("rel")
    up = put.withColumn("path", F.explode(model.prefixes(F.col("w_path"), strict=True)))
    rows = at.unionByName(up)
    segs, compiler, valid, asked = model.segments(F.col("path")), Compiler({}), F.lit(True), F.lit(False)
    for path, siblings, k, tree in rules.rules:
        if k == "validate":
            compiler.names = _names(path, segs, None, rules.environment)
            here = _applies(path, siblings, segs, True)
            valid, asked = valid & (~here | compiler.boolean(tree)), asked | here
    broken = _answer(rows.filter(asked), [*key, "path"], leaf, compiler.lookups).filter(~valid).select(*key).distinct().withColumn("__bad", F.lit(True))
    return granted.join(broken, key, "left").select(*key, (F.col("__w") & F.col("__bad").isNull()).alias("ok"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])))
def _writes_at(op: pd.Series, path: pd.Series, value: pd.Series, view: pd.Series) -> pd.Series:
    def put(out, segments, v):
        *head, tail = segments
        for k in head:
            if not isinstance(out.get(k), dict):
                out[k] = {}
            out = out[k]
        if not (isinstance(v, dict) and isinstance(out.get(tail), dict)):
            out[tail] = v
            return
        for k, x in v.items():  # both are objects: the later one's keys count
            put(out[tail], [k], x)

    def one(o, p, text, at):
        at, out = at.strip("/"), {}
        for where, v in _written(o, p, text):
            if at == where or where == "" or at.startswith(where + "/"):
                for k in filter(None, at[len(where) :].split("/")):
                    v = dict(children(v)).get(k) if isinstance(v, (dict, list)) else None
                for k, x in children(v) if isinstance(v, (dict, list)) else ():
                    put(out, [k], x)
            elif at == "" or where.startswith(at + "/"):
                put(out, [k for k in where[len(at) :].split("/") if k], v)
        return [{"name": k, "value": dump(x)} for k, x in sorted(out.items())]

    return pd.Series([None if None in (o, p, at) else one(o, p, t, at) for o, p, t, at in zip(op, path, value, view)], dtype=object)


def writes_at(writes: DataFrame, view_path: Column) -> DataFrame:
    """``writes`` with name and value (JSON, perhaps a part only) of each child of ``view_path`` that a write touches.

    Keys of an UPDATE that lie below one child are merged; a delete gives null.
    """
    return writes.select("*", F.explode(_writes_at(F.col("op"), F.col("path"), F.col("value"), view_path)).alias("__c")).select(*writes.columns, "__c.name", F.col("__c.value").alias("child_value"))
