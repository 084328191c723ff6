"""Trees as leaf rows: reading, shallow reading, rendering with the array rule, hashing.

A leaf table has db, path (no outer slashes) and value (a JSON scalar). A container
exists only through its leaves, so cleaning and pruning need no code of their own.
Empty tables give no rows; null paths or values are no leaves.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy import model
from canopy.functions.jsontext import INVALID, dump, fold, leaves, parse, safe


def flatten_json(df: DataFrame, keys: list[str], json_col: str) -> DataFrame:
    """``keys``, path and value of every leaf of a JSON column; nulls and empty containers vanish."""
    slim = df.select(*keys, F.col(json_col).cast("string").alias("__json")).filter("__json is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, paths, values = [], [], []
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                v = parse(text)
                for p, x in leaves("", None if v is INVALID else v):
                    at.append(i)
                    paths.append(safe(p))
                    values.append(dump(x))
            kept = pa.Table.from_batches([b]).take(pa.array(at, pa.int64())).combine_chunks()
            cols = [(kept.column(i).chunk(0) if kept.num_rows else pa.array([], b.schema.field(i).type)) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[*keys, "path", "value"])


    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
    return slim.mapInArrow(run, schema)


def subtree(leaf: DataFrame, at: str) -> DataFrame:
    """The leaves at or below a path, with paths relative to it."""
    at = at.strip("/")
    p = F.col("path")
    if not at:
        return leaf.filter(p.isNotNull())
    n = len(at)
    return leaf.filter((p == at) | p.startswith(at + "/")).withColumn("path", F.when(p == at, "").otherwise(F.substring(p, n + 2, 1 << 30)))


def child_keys(leaf: DataFrame, at: str = "") -> DataFrame:
    """db, key, leaves, bytes, value of each child; value is null for containers."""
    below = subtree(leaf, at).filter(F.col("path") != "")
    s = F.split("path", "/", 2)
    rows = below.select("db", s[0].alias("key"), (F.size(s) == 1).alias("scalar"), "value")
    return rows.groupBy("db", "key").agg(F.count("*").alias("leaves"), F.sum(F.octet_length("value")).alias("bytes"), F.max(F.when(F.col("scalar"), F.col("value"))).alias("value"))


def scalar_size(value: Column) -> Column:
    """The size estimate of a JSON scalar: null 4, bool 5, number 12, string its bytes + 2."""
    text = F.try_variant_get(F.try_parse_json(value), "$", "string")
    return F.when(F.startswith(value, F.lit('"')), F.octet_length(text) + 2).when(value.isin("true", "false"), 5).when(value == "null", 4).otherwise(12)


def child_sizes(leaf: DataFrame, at: str = "") -> DataFrame:
    """db, key, size, nodes, fields: the estimate of :func:`value_size`, by aggregation only.

    A node adds its key and 4, a container 1, a scalar its own size; nodes counts all below
    the child and itself, fields those that are scalars. A subtree of any size is summed up.
    """
    s = F.split("path", "/", 2)
    below = subtree(leaf, at).filter(F.col("path") != "").select("db", s[0].alias("key"), F.when(F.size(s) > 1, s[1]).alias("rest"), scalar_size(F.col("value")).alias("own"))
    scalars = below.select("db", "key", "rest", "own", F.lit(0).alias("box"))
    inner = below.filter("rest is not null").select("db", "key", F.explode(model.prefixes(F.col("rest"), strict=True)).alias("rest")).distinct()
    boxes = inner.select("db", "key", F.nullif(F.col("rest"), F.lit("")).alias("rest"), F.lit(0).alias("own"), F.lit(1).alias("box"))
    named = F.when(F.col("rest").isNotNull(), F.octet_length(F.substring_index("rest", "/", -1)) + 4).otherwise(0)
    g = scalars.unionByName(boxes).groupBy("db", "key")
    return g.agg(F.sum(F.col("own") + named + F.col("box")).alias("size"), F.count("*").alias("nodes"), F.sum(1 - F.col("box")).alias("fields"))


def shallow(leaf: DataFrame, at: str = "") -> DataFrame:
    """db, key, value: primitives as they are, containers as ``{".sz": size estimate}``."""
    kids = child_keys(leaf, at).join(child_sizes(leaf, at), ["db", "key"])
    return kids.select("db", "key", F.coalesce("value", F.to_json(F.struct(F.col("size").alias(".sz")))).alias("value"))


def shallow_truncated(leaf: DataFrame, at: str = "") -> DataFrame:
    """db, key, true for every child."""
    return child_keys(leaf, at).select("db", "key", F.lit(True).alias("value"))


def _is_array(keys: list[str]) -> bool:
    """Every key a canonical integer and the largest below twice their number."""
    if not keys or not all(k.isascii() and k.isdigit() and (k == "0" or k[0] != "0") and int(k) < 2**64 for k in keys):
        return False
    return max(map(int, keys)) < 2 * len(keys)


def nested(items: list[tuple[str, str]]):
    """The value that (path, JSON scalar) leaves make up, arrays rendered."""
    root: dict = {}
    for path, text in items:
        v = json.loads(text)
        if path == "":
            return v
        at = root
        *head, tail = path.split("/")
        for k in head:
            at = at.setdefault(k, {})
        at[tail] = v
    return rendered(root)


def rendered(value):
    """Containers whose keys make up an array become lists, gaps null; at every depth."""

    def node(v, parts):
        names = v if isinstance(v, dict) else map(str, range(len(v)))
        out = {k: x for k, x in zip(names, parts, strict=True) if isinstance(v, dict) or x is not None}
        if _is_array(list(out)):
            return [out.get(str(i)) for i in range(max(map(int, out)) + 1)]
        return out

    return fold(value, lambda x: x, node)


@F.pandas_udf(T.StringType())
def render_json(text: pd.Series) -> pd.Series:
    """A JSON text as it reads back once stored: cleaned, arrays by the array rule; null if nothing is left."""

    def one(t):
        v = parse(t)
        kept = [] if v is INVALID else [(p, dump(x)) for p, x in leaves("", v)]
        return dump(nested(kept)) if kept else None

    return text.map(one)


def assemble(leaf: DataFrame, levels: int = 1, at: str = "") -> DataFrame:
    """db, path, value (JSON): the subtrees ``levels`` below ``at``, one row each.

    One group is one subtree, which the tree's size limit bounds (256 MiB read at once);
    a whole database of any size is read as its subtrees, not as one value.
    """
    below = subtree(leaf, at)
    head = F.array_join(F.slice(F.split("path", "/"), 1, levels), "/")
    rest = F.array_join(F.expr(f"slice(split(path, '/'), {levels + 1}, size(split(path, '/')))"), "/")
    rows = below.groupBy("db", head.alias("path")).agg(F.sort_array(F.collect_list(F.struct(rest.alias("p"), F.col("value").alias("v")))).alias("items"))

    @F.pandas_udf(T.StringType())
    def build(items: pd.Series) -> pd.Series:
        return items.map(lambda xs: dump(nested([(x["p"], x["v"]) for x in xs])))

    return rows.select("db", "path", build("items").alias("value"))


def array_shape(leaf: DataFrame) -> DataFrame:
    """db, parent, children, max_index, is_array of every container, by aggregation only."""
    steps = leaf.filter("path <> ''").select("db", F.explode(model.prefixes(F.col("path"))).alias("path"))
    kids = steps.filter("path <> ''").distinct().select("db", model.parent(F.col("path")).alias("parent"), model.last_segment(F.col("path")).alias("key"))
    canonical = F.rlike("key", F.lit("^(0|[1-9][0-9]{0,18})$"))
    number = F.when(canonical, F.col("key").try_cast("decimal(20,0)"))
    g = kids.groupBy("db", "parent").agg(F.count("*").alias("children"), F.max(number).cast("bigint").alias("max_index"), F.min(canonical).alias("all_int"))
    return g.select("db", "parent", "children", "max_index", (F.col("all_int") & (F.col("max_index") < 2 * F.col("children"))).alias("is_array"))


def structural_fields(leaf: DataFrame) -> DataFrame:
    """Distinct keys of objects that hold no push-id-like key."""
    steps = leaf.filter("path <> ''").select("db", F.explode(model.prefixes(F.col("path"))).alias("path"))
    kids = steps.filter("path <> ''").distinct().select("db", model.parent(F.col("path")).alias("parent"), model.last_segment(F.col("path")).alias("key"))
    plain = kids.groupBy("db", "parent").agg(F.max(push_id_like(F.col("key"))).alias("c")).filter(~F.col("c")).select("db", "parent")
    return kids.join(plain, ["db", "parent"], "left_semi").select("key").distinct()


def push_id_like(key: Column) -> Column:
    return F.rlike(key, F.lit("^-[A-Za-z0-9_-]+$"))


def value_size(json_col: Column) -> Column:
    """Byte estimate of a value (null 4, bool 5, number 12, string its bytes + 2, containers by their parts)."""

    @F.pandas_udf(T.LongType())
    def size(text: pd.Series) -> pd.Series:
        def leaf(v):
            return 4 if v is None else 5 if isinstance(v, bool) else 12 if isinstance(v, (int, float)) else len(v.encode("utf-8", "replace")) + 2

        def node(v, parts):
            names = v if isinstance(v, dict) else map(str, range(len(v)))
            return 2 + sum(len(k.encode("utf-8", "replace")) + 3 + n for k, n in zip(names, parts, strict=True)) + max(0, len(parts) - 1)

        return text.map(lambda t: None if (v := parse(t)) is INVALID else fold(v, leaf, node)).astype("Int64")

    return size(json_col)


def value_depth(json_col: Column) -> Column:
    """0 for scalars, else one more than the deepest part; null if no JSON."""

    @F.pandas_udf(T.IntegerType())
    def depth(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if (v := parse(t)) is INVALID else fold(v, lambda x: 0, lambda x, parts: 1 + max(parts, default=0))).astype("Int32")

    return depth(json_col)


# hashes -----------------------------------------------------------------------

def _number(v) -> str:
    """A number as RFC 8785 writes it (ECMAScript's shortest form)."""
    f = float(v)
    if f == 0:
        return "0"
    if math.isinf(f):
        raise ValueError("not a JSON number")
    text = repr(f)
    mantissa, _, exp = text.partition("e")
    sign, mantissa = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
    whole, _, frac = mantissa.partition(".")
    digits = (whole + frac).lstrip("0")
    point = len(whole) + int(exp or 0) - (len(whole + frac) - len((whole + frac).lstrip("0")))
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if 0 < point <= 21:
        return sign + (digits + "0" * (point - n) if n <= point else digits[:point] + "." + digits[point:])
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return sign + digits[0] + ("." + digits[1:] if n > 1 else "") + ("e+" if e > 0 else "e-") + str(abs(e))


def canonical(value) -> str:
    """RFC 8785 text of a value: keys by UTF-16 code units, no white space."""
    quoted = lambda t: json.dumps(t, ensure_ascii=False)

    def leaf(v):
        return json.dumps(v) if v is None or isinstance(v, bool) else quoted(v) if isinstance(v, str) else _number(v)

    def node(v, parts):
        if isinstance(v, list):
            return "[" + ",".join(parts) + "]"
        pairs = sorted(zip(v, parts, strict=True), key=lambda kp: kp[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{quoted(k)}:{text}" for k, text in pairs) + "}"

    return fold(value, leaf, node)


@F.pandas_udf(T.StringType())
def native_hash(text: pd.Series) -> pd.Series:
    """SHA-256 (hex) of the RFC 8785 text; null for text that is no JSON."""
    return text.map(lambda t: None if (v := parse(t)) is INVALID else hashlib.sha256(canonical(v).encode("utf-8", "replace")).hexdigest())


def _leaf_text(v) -> str:
    if isinstance(v, bool):
        return f"boolean:{str(v).lower()}"
    if isinstance(v, (int, float)):
        return f"number:{struct.pack('>d', float(v)).hex()}"
    return f"string:{v}"


def _hash_key(k: str):
    try:
        n = int(k) if k.lstrip("+-").isdigit() else None
    except ValueError:
        n = None
    return (0, n, "") if n is not None and -(2**63) <= n < 2**63 else (1, 0, k)


def _priority(v):
    return v.get(".priority") if isinstance(v, dict) else None


def _digest(priority, body: str) -> str:
    head = f"priority:{_leaf_text(priority)}:" if priority is not None else ""
    return base64.b64encode(hashlib.sha1((head + body).encode("utf-8", "replace")).digest()).decode()


def sdk_hash_of(value) -> str:
    """Base64 SHA-1 of the typed text of a value; ``""`` for null and empty containers."""

    def leaf(v):
        return "" if v is None else _digest(None, _leaf_text(v))

    def node(v, parts):
        named = dict(zip(v if isinstance(v, dict) else map(str, range(len(v))), zip(v.values() if isinstance(v, dict) else v, parts, strict=True), strict=True))
        priority = _priority(v)
        if isinstance(v, dict) and ".value" in v:  # a scalar with its priority, or a container so wrapped
            inner, plain = named[".value"]
            if isinstance(inner, (dict, list)) or inner is None:
                return plain if priority is None or not plain else _digest(priority, kids(inner))
            return _digest(priority, _leaf_text(inner))
        body = listed(named)
        return _digest(priority, body) if body else ""

    def listed(named):
        rows = []
        for k, (x, h) in named.items():
            if k != ".priority" and h:
                p = _priority(x)
                rank = 0 if p is None else 1 if isinstance(p, (int, float)) else 2
                rows.append(((rank, p if rank == 1 else 0, p if rank == 2 else ""), _hash_key(k), k, h))
        return "".join(f":{k}:{h}" for _, _, k, h in sorted(rows))

    def kids(v):
        pairs = v.items() if isinstance(v, dict) else ((str(i), x) for i, x in enumerate(v))
        return listed({k: (x, sdk_hash_of(x)) for k, x in pairs})

    return fold(value, leaf, node)


@F.pandas_udf(T.StringType())
def sdk_hash(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (v := parse(t)) is INVALID else sdk_hash_of(v))


def hash_kind(h: Column) -> Column:
    """native (64 hex digits), sdk, or none (empty or null)."""
    return F.when(F.rlike(h, F.lit("^[0-9a-f]{64}$")), "native").when(F.coalesce(h, F.lit("")) == "", "none").otherwise("sdk")
