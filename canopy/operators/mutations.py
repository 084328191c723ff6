"""Writes before they reach the log: filtering, transactions, conditions, server values.

A write row has db, client (connection), request_id, seq, op (s, u, d; c in
transactions), path, value (JSON text). Order is ``seq``. All operators keep rows whose
deciding columns are null as the docstrings say; empty inputs give empty outputs.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy import model
from canopy.functions.jsontext import INVALID, children, dump, fold, has_leaf, leaves, parse
from canopy.operators import tree

#: Requests that a connection remembers.
REMEMBERED = 500
#: Copies of a view that the mutations below it are spread over.
SALTS = 16
TX_OPS, ON_DISCONNECT_ACTIONS, ON_DISCONNECT_BYTES, DB_BYTES = 1000, 100, 1 << 20, 1 << 40
WRITE_BYTES = 16 << 20
BURST_BYTES, REFILL_BYTES, REFILL_SECONDS = 512 << 20, 64 << 20, 15


def canonical_op(op: Column, value: Column) -> Column:
    """A SET of null (SQL or JSON) is a DELETE."""
    return F.when((op == "s") & (value.isNull() | (F.trim(value) == "null")), "d").otherwise(op)


def dedup(writes: DataFrame, keys: tuple[str, ...] = ("client", "request_id")) -> DataFrame:
    """The first delivery of each (client, request_id); rows without an id are all kept."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    cols = writes.columns
    firsts = writes.filter(known).groupBy(*keys).agg(F.min_by(F.struct(*cols), "seq").alias("__r")).select("__r.*")
    return firsts.unionByName(writes.filter(~F.coalesce(known, F.lit(False))))


def dedup_recent(writes: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """Writes whose (client, request_id) is not among the client's last ``remembered`` ones, in order of seq.

    What a connection with a bounded memory of requests lets through: a repeat that comes late enough
    is a write again. Rows without an id are all kept. The fold of a client is ordered; rows stream
    through it, and only the remembered ids are kept.
    """
    names = writes.columns

    def run(batches):
        import pyarrow as pa

        client, known = None, OrderedDict()
        for b in batches:
            keep = []
            for c, i in zip(b.column(names.index("client")).to_pylist(), b.column(names.index("request_id")).to_pylist(), strict=True):
                if c != client:
                    client, known = c, OrderedDict()
                fresh = c is None or i is None or i == "" or i not in known
                if fresh and i:
                    known[i] = None
                    if len(known) > remembered:
                        known.popitem(last=False)
                keep.append(fresh)
            yield b.filter(pa.array(keep, pa.bool_()))

    return writes.repartition("client").sortWithinPartitions("client", "seq").mapInArrow(run, writes.schema)


def untainted(writes: DataFrame, nacked: DataFrame, pending: str = "pending") -> DataFrame:
    """Writes whose list of pending requests holds no request of the client that was refused before."""
    ids = writes.filter(F.size(pending) > 0).select("client", "seq", F.explode(pending).alias("request_id"))
    refused = nacked.groupBy("client", "request_id").agg(F.min("seq").alias("n_seq"))
    bad = ids.join(refused, ["client", "request_id"]).filter("n_seq < seq").select("client", "seq").distinct()
    return writes.join(bad, ["client", "seq"], "left_anti")


def expand_update(writes: DataFrame) -> DataFrame:
    """UPDATE rows as one SET or DELETE per key, keys in byte order; other rows as they are (idx 0)."""
    v = F.from_json("value", "map<string,string>")
    entries = F.array_sort(F.map_entries(v))
    raw = F.try_parse_json(F.col("value"))
    u = writes.filter((F.col("op") == "u") & F.startswith(F.schema_of_variant(raw), F.lit("OBJECT")))
    rest = [c for c in writes.columns if c not in ("op", "path", "value")]
    e = u.select(*rest, "path", F.posexplode(entries).alias("idx", "e"), raw.alias("raw"))
    at = e.select(*rest, "idx", model.joined(F.col("path"), F.col("e.key")).alias("path"), F.col("e.value").alias("text"), F.col("e.key").alias("k"))
    upd = at.select(*rest, F.when(F.col("text").isNull() | (F.col("text") == "null"), "d").otherwise("s").alias("op"), "path", F.col("text").alias("value"), "idx")
    other = writes.filter(F.col("op") != "u").select(*rest, canonical_op(F.col("op"), F.col("value")).alias("op"), model.trimmed(F.col("path")).alias("path"), "value", F.lit(0).alias("idx"))
    return other.unionByName(upd)


def increments(writes: DataFrame, keys: list[str], delta: str = "delta", base: str = "base") -> DataFrame:
    """The value after each write of a path: a SET gives ``base``, an increment adds ``delta`` to what is there.

    A missing or non-numeric value counts 0. Windowed per path: a running sum since the
    last SET.
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    sets = writes.withColumn("__g", F.sum(F.col(base).isNotNull().cast("long")).over(w))
    amount = F.coalesce(F.col(base).cast("double"), F.col(delta).cast("double"), F.lit(0.0))
    return sets.withColumn("result", F.sum(amount).over(Window.partitionBy(*keys, "__g").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))).drop("__g")


def server_values(value: Column, now_ms: Column) -> Column:
    """``{".sv":"timestamp"}`` anywhere in a value becomes the write's milliseconds."""
    return F.regexp_replace(value, F.lit(r'\{\s*"\.sv"\s*:\s*"timestamp"\s*\}'), now_ms.cast("string"))


def _is_increment(v) -> bool:
    return isinstance(v, dict) and len(v) == 1 and isinstance(v.get(".sv"), dict) and set(v[".sv"]) == {"increment"}


def _changes(writes: DataFrame) -> DataFrame:
    """db, seq, idx, path and what stands there after a write: base (a number), delta (an increment), or neither.

    One row per leaf a write holds, and one per path it replaces.
    """
    schema = "db string, seq long, idx int, path string, base double, delta double, whole boolean"

    def run(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        for b in batches:
            out = []
            for db, seq, op, path, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                v, path = parse(value), path.strip("/")
                parts = [(path, None if op == "d" else v)] if op != "u" else [(f"{path}/{k.strip('/')}".strip("/"), v[k]) for k in sorted(v)] if isinstance(v, dict) else []
                for i, (at, x) in enumerate(parts if op == "d" or v is not INVALID else []):
                    if not _is_increment(x):
                        out.append((db, seq, i, at, None, None, True))
                    todo = [(at, x)]
                    while todo:
                        p, y = todo.pop()
                        if _is_increment(y):
                            d = y[".sv"]["increment"]
                            out.append((db, seq, i, p, None, float(d) if isinstance(d, (int, float)) and not isinstance(d, bool) else None, False))
                        elif isinstance(y, (dict, list)):
                            todo += [(f"{p}/{k}".strip("/"), z) for k, z in children(y)]
                        elif isinstance(y, (int, float)) and not isinstance(y, bool):
                            out.append((db, seq, i, p, float(y), None, False))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["db", "seq", "idx", "path", "base", "delta", "whole"])

    return writes.select("db", F.col("seq").cast("long"), "op", "path", "value").filter("db is not null and seq is not null and op in ('s', 'u', 'd') and path is not null").mapInArrow(run, schema)


@F.pandas_udf(T.StringType())
def _filled(value: pd.Series, op: pd.Series, path: pd.Series, results: pd.Series) -> pd.Series:
    """A value with its increments replaced by the results (JSON object of path to number)."""

    def one(text, kind, at, found):
        if found is None:
            return text
        numbers = parse(found)
        v, at = parse(text), at.strip("/")
        box = {"": v}
        todo = [(box, "", at)]
        while todo:
            holder, k, p = todo.pop()
            x = holder[k]
            if _is_increment(x):
                n = numbers.get(p)
                holder[k] = int(n) if n is not None and n == int(n) else n
            elif isinstance(x, dict):
                todo += [(x, j, f"{p}/{j.strip('/') if kind == 'u' and x is v else j}".strip("/")) for j in x]
            elif isinstance(x, list):
                todo += [(x, j, f"{p}/{j}".strip("/")) for j in range(len(x))]
        return dump(box[""])

    return pd.Series([one(*row) for row in zip(value, op, path, results)], dtype=object)


def resolve_increments(writes: DataFrame, leaf: DataFrame) -> DataFrame:
    """``writes`` (db, seq unique in a db, op, path, value) with ``{".sv":{"increment":n}}`` replaced by numbers, and ``error``.

    What is there counts: the tree (``leaf``: db, path, value) and the writes before, increments
    among them; a place that holds no number counts 0, whole results are integers. A delta that
    is no number is ``invalid_data``. Only places that are incremented are looked at: each meets
    the writes of itself and its ancestors by equality, then runs a sum since the last that set it.
    """
    c = _changes(writes)
    at = ["db", "path"]
    wanted = c.filter("delta is not null").select(*at).distinct()
    own = c.filter("not whole").join(wanted, at, "left_semi").select(*at, "seq", "idx", F.lit(1).alias("part"), "base", "delta")
    up = wanted.select("db", "path", F.explode(model.prefixes(F.col("path"))).alias("up"))
    # a write of an ancestor or of the place sets it: to its own number if it names one (part 1), else to nothing
    wiped = c.filter("whole").withColumnRenamed("path", "up").join(up, ["db", "up"]).select(*at, "seq", "idx", F.lit(0).alias("part"), F.lit(0.0).alias("base"), F.lit(None).cast("double").alias("delta"))
    # a write below makes the place a container, which counts 0
    below = c.filter("whole").select("db", "seq", "idx", F.explode(model.prefixes(F.col("path"), strict=True)).alias("path")).join(wanted, at, "left_semi").select(*at, "seq", "idx", F.lit(2).alias("part"), F.lit(0.0).alias("base"), F.lit(None).cast("double").alias("delta"))
    before = leaf.select("db", model.trimmed(F.col("path")).alias("path"), F.col("value").try_cast("double").alias("base")).join(wanted, at, "left_semi")
    before = before.select(*at, F.lit(-(2**62)).alias("seq"), F.lit(0).alias("idx"), F.lit(0).alias("part"), F.coalesce("base", F.lit(0.0)).alias("base"), F.lit(None).cast("double").alias("delta"))
    steps = own.unionByName(wiped).unionByName(below).unionByName(before)
    order = Window.partitionBy(*at).orderBy("seq", "idx", "part")
    steps = steps.withColumn("__g", F.sum(F.col("base").isNotNull().cast("long")).over(order))
    run = F.sum(F.coalesce("base", "delta", F.lit(0.0))).over(Window.partitionBy(*at, "__g").orderBy("seq", "idx", "part").rowsBetween(Window.unboundedPreceding, 0))
    results = steps.withColumn("n", run).filter("delta is not null").groupBy("db", "seq").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("path", "n")))).alias("__found"))
    bad = c.filter("not whole and base is null and delta is null").select("db", "seq").distinct().withColumn("__bad", F.lit("invalid_data"))
    j = writes.join(results, ["db", "seq"], "left").join(bad, ["db", "seq"], "left")
    filled = F.when(F.col("__bad").isNull(), _filled(F.col("value"), F.col("op"), F.col("path"), F.col("__found"))).otherwise(F.col("value"))
    return j.select(*[filled.alias("value") if x == "value" else F.col(x) for x in writes.columns], F.col("__bad").alias("error"))


def valid_writes(writes: DataFrame, db_bytes: str | None = None) -> DataFrame:
    """``error``: why a write would be refused (null: it is fine).

    ``db_bytes`` names a column with the size of the write's database, if known: one at its cap takes deletes only.
    """
    v = F.col("value")
    depth = F.coalesce(tree.value_depth(v), F.lit(0))
    error = (
        F.when(~F.coalesce(model.valid_path(F.col("path")), F.lit(False)), "invalid_path")
        .when((F.col("op") != "d") & v.isNotNull() & F.try_parse_json(v).isNull(), "invalid_data")
        .when((F.col("op") == "u") & ~F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(v)), F.lit("OBJECT")), F.lit(False)), "invalid_data")
        .when(F.size(model.segments(F.col("path"))) + depth > model.MAX_DEPTH, "too_deep")
        .when(F.octet_length(v) > WRITE_BYTES, "too_large")
        .when((canonical_op(F.col("op"), v) != "d") & (F.col(db_bytes) >= DB_BYTES) if db_bytes else F.lit(False), "database_full")
    )
    return writes.withColumn("error", error)


@F.pandas_udf(T.BooleanType())
def valid_value_keys(text: pd.Series) -> pd.Series:
    """Whether all keys inside a value are valid, and ``.value`` has no sibling but ``.priority``."""
    def key_ok(k):
        return k != "" and len(k.encode("utf-8", "replace")) <= model.MAX_KEY_BYTES and not any(c in "$#[]/" or ord(c) < 32 or ord(c) == 127 for c in k) and "." not in k[1:]

    def ok(v, parts):
        if isinstance(v, dict) and (not all(map(key_ok, v)) or (".value" in v and set(v) - {".value", ".priority"})):
            return False
        return all(parts)

    return text.map(lambda t: None if (v := parse(t)) is INVALID else fold(v, lambda x: True, ok)).astype("boolean")


def present_values(checks: DataFrame, leaf: DataFrame) -> DataFrame:
    """db, __p, __now: what stands at the paths ``checks`` (db, __p) ask for, as JSON.

    A place that is a leaf is met by equality; only for the others is the tree exploded, to
    what lies below them. One group is a subtree, bounded by what one read may return.
    """
    wanted = checks.select("db", "__p").distinct()
    own = leaf.select("db", F.col("path").alias("__p"), "value")
    exact = wanted.join(own, ["db", "__p"]).select("db", "__p", F.col("value").alias("__now"))
    boxes = wanted.join(own, ["db", "__p"], "left_anti")
    up = leaf.select("db", F.explode(model.prefixes(F.col("path"), strict=True)).alias("__p"), "path", "value")
    rel = F.expr("substring(path, if(__p = '', 1, length(__p) + 2))")
    below = up.join(boxes, ["db", "__p"], "left_semi").groupBy("db", "__p").agg(F.sort_array(F.collect_list(F.struct(rel.alias("p"), F.col("value").alias("v")))).alias("items"))

    @F.pandas_udf(T.StringType())
    def build(items: pd.Series) -> pd.Series:
        return items.map(lambda xs: None if xs is None else dump(tree.nested([(x["p"], x["v"]) for x in xs])))

    return exact.unionByName(below.select("db", "__p", build("items").alias("__now")))


def conditions(checks: DataFrame, leaf: DataFrame) -> DataFrame:
    """``holds`` for each condition row (tx_id, db, path, hash, value): the present value has that hash,
    equals ``value``, or, with neither, is absent. ``leaf`` is the tree (db, path, value) before."""
    c = checks.select("*", model.trimmed(F.col("path")).alias("__p"))
    j = c.join(present_values(c, leaf), ["db", "__p"], "left")
    now, kind, wanted = F.col("__now"), tree.hash_kind(F.col("hash")), F.col("value")
    hashed = F.when(kind == "native", tree.native_hash(F.when(kind == "native", now)) == F.col("hash")).when(kind == "sdk", tree.sdk_hash(F.when(kind == "sdk", now)) == F.col("hash"))
    # scalars are compared in the JVM, containers by their hash
    box = F.rlike(now, F.lit(r"^\s*[\[{]")) & F.rlike(wanted, F.lit(r"^\s*[\[{]"))
    plain = lambda t: F.when(~box, model.sort_key(t))
    by_value = F.when(box, tree.native_hash(F.when(box, now)) == tree.native_hash(F.when(box, wanted))).otherwise((plain(now) == plain(wanted)) & (plain(now).getField("rank") < model.CONTAINER))
    holds = F.when(kind != "none", hashed).when(wanted.isNotNull() & (F.trim(wanted) != "null"), by_value).otherwise(now.isNull())
    return j.withColumn("holds", F.coalesce(holds, F.lit(False))).drop("__p", "__now")


def transactions(ops: DataFrame, leaf: DataFrame) -> DataFrame:
    """tx_id, committed, reason: all or nothing, after paths, size and conditions are checked.

    ``ops``: tx_id, db, seq, op, path, value, hash. Every transaction is judged against
    ``leaf``, none sees another; :func:`transactions_in_order` judges those that follow each other.
    """
    bad = valid_writes(ops.filter("op <> 'c'")).groupBy("tx_id").agg(F.min("error").alias("error"))
    size = ops.groupBy("tx_id").agg(F.count("*").alias("n"))
    held = conditions(ops.filter("op = 'c'"), leaf).groupBy("tx_id").agg(F.min("holds").alias("holds"))
    j = size.join(bad, "tx_id", "left").join(held, "tx_id", "left")
    reason = F.when(F.col("n") > TX_OPS, "too_many_operations").when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce("holds", F.lit(True)), "condition_failed")
    return j.select("tx_id", reason.isNull().alias("committed"), reason.alias("reason"))


class _Overlay:
    """Writes in order over a tree whose first values come with the questions."""

    def __init__(self):
        self.root: dict = {"kids": {}}

    def write(self, path: str, value) -> None:
        at = self.root
        for k in filter(None, path.split("/")):
            if value is not None:  # a scalar above is replaced, for good
                at["grown"] = True
            at = at["kids"].setdefault(k, {"kids": {}})
        at.update(kids={}, set=value, grown=False)

    def read(self, path: str, now):
        """The value at a path, ``now`` being what stood there at first."""
        at, value = self.root, now
        replaced = "set" in at
        value = at["set"] if replaced else now
        for k in filter(None, path.split("/")):
            if replaced:
                value = dict(children(value)).get(k) if isinstance(value, (dict, list)) else None
            at = at["kids"].get(k) if at else None
            if at and "set" in at:
                replaced, value = True, at["set"]
        return self._below(at, value) if at else value

    def _below(self, at, value):
        """``value`` with what was written below ``at`` laid over it, kept as leaves by path."""
        if not at["kids"]:
            return value
        held = {p: x for p, x in leaves("", value)} if value is not None else {}
        todo = [("", at)]
        while todo:
            p, node = todo.pop()
            if p and "set" in node:
                held = {q: x for q, x in held.items() if q != p and not q.startswith(p + "/")}
                new = dict(leaves(p, node["set"])) if node["set"] is not None else {}
                if new:
                    above = {"/".join(p.split("/")[:i]) for i in range(len(p.split("/")))}
                    held = {q: x for q, x in held.items() if q not in above} | new
            if node.get("grown"):
                held.pop(p, None)
            todo += [(f"{p}/{k}".strip("/"), n) for k, n in node["kids"].items()]
        return tree.nested([(p, dump(x)) for p, x in held.items()]) if held else None


def transactions_in_order(ops: DataFrame, leaf: DataFrame) -> DataFrame:
    """tx_id, committed, reason of transactions that follow each other: each is judged after the ones before it.

    ``ops``: tx_id, db, tx_seq (order of the transactions of a database), seq (order in one), op, path,
    value, hash. Paths and sizes are checked, then conditions against ``leaf`` and what earlier ones wrote.
    A database is one ordered stream, as the order is its meaning; where no transaction of
    it spans several top-level keys, each key is a stream of its own. A stream keeps what it wrote.
    """
    top = F.get(model.segments(F.col("path")), F.lit(0))
    spans = ops.groupBy("db", "tx_id").agg(F.min(F.coalesce(top, F.lit(""))).alias("lo"), F.max(F.coalesce(top, F.lit(""))).alias("hi"))
    whole = spans.groupBy("db").agg(F.max((F.col("lo") != F.col("hi")) | (F.col("lo") == "")).alias("__whole"))
    bad = valid_writes(ops.filter("op <> 'c'")).groupBy("db", "tx_id").agg(F.min("error").alias("__error"))
    size = ops.groupBy("db", "tx_id").agg(F.count("*").alias("__n"))
    c = ops.select("*", F.when(F.col("op") == "c", model.trimmed(F.col("path"))).alias("__p"))
    j = c.join(present_values(c.filter("op = 'c'"), leaf), ["db", "__p"], "left").join(bad, ["db", "tx_id"], "left").join(size, ["db", "tx_id"]).join(whole, "db")
    j = j.withColumn("__stream", F.concat_ws("\u0001", "db", F.when(~F.col("__whole"), top)))
    names = ["__stream", "tx_id", "op", "path", "value", "hash", "__now", "__error", "__n"]
    kind = dict(ops.dtypes)["tx_id"]

    def judge(rows, state):
        _, tx_id, *_, error, n = rows[0]
        if n > TX_OPS or error:
            return tx_id, False, "too_many_operations" if n > TX_OPS else error
        mine = [(op, path.strip("/"), parse(value) if value is not None else None, h, now) for _, _, op, path, value, h, now, _, _ in rows]
        for op, path, v, h, now in mine:
            if op == "c" and not _matches(state.read(path, None if now is None else parse(now)), v, h):
                return tx_id, False, "condition_failed"
        for op, path, v, _, _ in mine:
            if op == "u":
                for k in sorted(v):
                    state.write(f"{path}/{k.strip('/')}", v[k] if has_leaf(v[k]) else None)
            elif op in ("s", "d"):
                state.write(path, v if op == "s" and has_leaf(v) else None)
        return tx_id, True, None

    def run(batches):
        import pyarrow as pa

        stream, state, rows = None, _Overlay(), []

        def table(out):
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64() if kind in ("bigint", "int") else pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], pa.string())], names=["tx_id", "committed", "reason"])

        for b in batches:
            out = []
            for r in zip(*(col.to_pylist() for col in b.columns), strict=True):
                if rows and (r[0], r[1]) != (rows[0][0], rows[0][1]):
                    out.append(judge(rows, state))
                    rows = []
                if r[0] != stream:
                    stream, state = r[0], _Overlay()
                rows.append(r)
            yield table(out)
        if rows:
            yield table([judge(rows, state)])

    ordered = j.repartition("__stream").sortWithinPartitions("__stream", "tx_seq", "tx_id", "seq").select(*names)
    return ordered.mapInArrow(run, f"tx_id {'bigint' if kind in ('bigint', 'int') else 'string'}, committed boolean, reason string")


def _matches(now, value, h: str | None) -> bool:
    """Whether a present value meets a condition: by hash, by value, or by being absent."""
    if h and len(h) == 64:
        return now is not None and hashlib.sha256(tree.canonical(now).encode("utf-8", "replace")).hexdigest() == h
    if h:
        return now is not None and tree.sdk_hash_of(now) == h
    if value is None:
        return now is None
    return now is not None and tree.canonical(tree.rendered(now)) == tree.canonical(tree.rendered(value))


def conditional_writes(writes: DataFrame, leaf: DataFrame) -> DataFrame:
    """Writes with a hash condition of their own (CAS, ``If-Match``), with ``committed`` and ``reason``.

    ``writes``: id, db, seq, op, path, value, h, hp. With ``hp`` the present value at the path must have the
    hash ``h``, an empty one meaning that there is none; without, the write is unconditional. A write
    that fails (``condition_failed``) refuses nothing else. Each is judged after those before it.
    """
    base = writes.select(F.col("id").alias("tx_id"), "db", F.col("seq").alias("tx_seq"), F.lit(1).alias("seq"), "op", "path", "value", F.lit(None).cast("string").alias("hash"))
    asks = writes.filter("hp").select(F.col("id").alias("tx_id"), "db", F.col("seq").alias("tx_seq"), F.lit(0).alias("seq"), F.lit("c").alias("op"), "path", F.lit(None).cast("string").alias("value"), F.nullif("h", F.lit("")).alias("hash"))
    verdict = transactions_in_order(base.unionByName(asks), leaf)
    return writes.join(verdict.withColumnRenamed("tx_id", "id"), "id")


def committed_ops(ops: DataFrame, verdict: DataFrame) -> DataFrame:
    """The writes of committed transactions (conditions write nothing)."""
    return ops.filter("op <> 'c'").join(verdict.filter("committed").select("tx_id"), "tx_id", "left_semi")


def on_disconnect(registrations: DataFrame, leaves_: DataFrame) -> DataFrame:
    """Log rows (client, seq, idx, op, path, value) that disconnects fire: the client's registrations before it, in their order.

    ``registrations``: client, seq, op (s, u, d, c to cancel the exact path), path, value;
    ``leaves_``: client, seq, ts_ms of each disconnect. A registration fires once, at the first
    disconnect after it, unless a cancel of its path came between. A client holds at most 100 actions
    and 1 MiB of values; what goes beyond is refused. The fold of a client is ordered; rows stream
    through it, and only the actions held (bounded so) are kept. Rows without client or seq have no effect.
    """
    r = registrations.select("client", F.col("seq").cast("long").alias("seq"), "op", model.trimmed(F.col("path")).alias("path"), "value", F.lit(None).cast("long").alias("ts_ms"))
    d = leaves_.select("client", F.col("seq").cast("long").alias("seq"), *[F.lit(None).cast("string").alias(c) for c in ("op", "path", "value")], F.coalesce(F.col("ts_ms").cast("long"), F.lit(0)).alias("ts_ms"))
    kind = registrations.schema["client"].dataType
    schema = T.StructType([T.StructField("client", kind), T.StructField("seq", T.LongType()), T.StructField("idx", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("op", "path", "value")], T.StructField("ts_ms", T.LongType())])

    def fold_clients(batches):
        import pyarrow as pa

        client, held, used = None, [], 0
        for b in batches:
            out = []
            for c, seq, op, path, value, ts in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != client:
                    client, held, used = c, [], 0
                if ts is not None:
                    out += [(c, seq, i + 1, *action, ts) for i, action in enumerate(held)]
                    held, used = [], 0
                elif op == "c":
                    held = [a for a in held if a[1] != path]
                    used = sum(len((a[2] or "").encode("utf-8", "replace")) for a in held)
                elif op in ("s", "u", "d") and path is not None:
                    size = len((value or "").encode("utf-8", "replace"))
                    if len(held) < ON_DISCONNECT_ACTIONS and used + size <= ON_DISCONNECT_BYTES:
                        held.append((op, path, value))
                        used += size
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [b.schema.field(0).type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=schema.names)

    both = r.unionByName(d).filter("client is not null and seq is not null")
    fired = both.repartition("client").sortWithinPartitions("client", "seq", F.col("ts_ms").asc_nulls_first()).mapInArrow(fold_clients, schema)
    return fired.withColumn("value", server_values(F.col("value"), F.col("ts_ms"))).drop("ts_ms")


def rate_limited(writes: DataFrame, key: str, ts_s: str, size: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``allowed`` per write under a token bucket (512 MiB burst, 64 MiB each 15 s), in order of time, then ``order``.

    The state passes from write to write, so a key's writes run in one ordered fold; rows
    stream through it in Arrow batches and the fold keeps two numbers.
    """

    schema = T.StructType([*writes.schema.fields, T.StructField("allowed", T.BooleanType())])

    def fill(batches):
        at: dict = {}
        for b in batches:
            rows = b.to_pydict()
            out = []
            for k, t, n in zip(rows[key], rows[ts_s], rows[size], strict=True):
                tokens, last = at.get(k, (BURST_BYTES, t))
                tokens = min(BURST_BYTES, tokens + (t - last) // REFILL_SECONDS * REFILL_BYTES)
                last += (t - last) // REFILL_SECONDS * REFILL_SECONDS
                ok = n <= tokens
                at = {k: (tokens - n if ok else tokens, last)}
                out.append(ok)
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "allowed"])

    known = writes.filter(F.col(key).isNotNull() & F.col(ts_s).isNotNull() & F.col(size).isNotNull())
    return known.repartition(F.col(key)).sortWithinPartitions(key, ts_s, *order).mapInArrow(fill, schema)


def match_views(mutations: DataFrame, views: DataFrame) -> DataFrame:
    """(mutation, view) pairs on one line of the tree: equal, above or below.

    Two equi-joins on exploded prefixes instead of a prefix theta join. ``relation``
    says where the mutation is: at, below or above the view.
    """
    m = mutations.withColumn("m_path", model.trimmed(F.col("path"))).drop("path")
    v = views.withColumn("v_path", model.trimmed(F.col("view_path"))).drop("view_path")
    # a view of a root meets all mutations of its database: they are spread over copies of it
    copies = v.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = m.withColumn("__salt", F.pmod(F.xxhash64("m_path"), F.lit(SALTS)).cast("int")).withColumn("v_path", F.explode(model.prefixes(F.col("m_path"))))
    at_or_below = spread.join(copies, ["db", "v_path", "__salt"]).drop("__salt")
    above = v.withColumn("m_path", F.explode(model.prefixes(F.col("v_path"), strict=True))).join(m, ["db", "m_path"])
    relation = F.when(F.col("m_path") == F.col("v_path"), "at").when(model.is_ancestor(F.col("v_path"), F.col("m_path")), "below").otherwise("above")
    return at_or_below.unionByName(above).withColumn("relation", relation)


def view_events(matched: DataFrame) -> DataFrame:
    """``matched`` with ev, rel_path, data: the put or patch a simple view gets for a mutation.

    At or below the view a set is a put at the path below it, a delete a put of null, and an update a
    patch at ``/`` keyed by relative path. Above the view a set or delete is a put at ``/`` of the view's
    part of the value; an update that names the view or an ancestor of it likewise, one that names
    places below it a patch at ``/`` of these, and one that names neither gives no event.
    """
    event = _view_event("op", "m_path", "v_path", "relation", "value").alias("__e")
    return matched.select("*", event).filter("__e.ev is not null").select(*matched.columns, "__e.ev", "__e.rel_path", "__e.data")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("ev", "rel_path", "data")]))
def _view_event(op: pd.Series, m_path: pd.Series, v_path: pd.Series, relation: pd.Series, value: pd.Series) -> pd.DataFrame:
    def part(v, rel: str):
        for k in filter(None, rel.split("/")):
            v = dict(children(v)).get(k) if isinstance(v, (dict, list)) else None
        return v

    def one(kind, m, v, where, text):
        x = None if kind == "d" or text is None else parse(text)
        if x is INVALID:
            return None, None, None
        rel = m[len(v) :].strip("/") if where != "above" else v[len(m) :].strip("/")
        if kind != "u":
            return ("put", "/", dump(part(x, rel))) if where == "above" else ("put", f"/{rel}", dump(x))
        if not isinstance(x, dict):
            return None, None, None
        if where != "above":
            return "patch", "/", dump({f"{rel}/{k.strip('/')}".strip("/"): y for k, y in x.items()})
        patch = {}
        for k, y in sorted(x.items()):
            k = k.strip("/")
            if rel == k or rel.startswith(f"{k}/"):
                return "put", "/", dump(part(y, rel[len(k) :]))
            if k.startswith(f"{rel}/"):
                patch[k[len(rel) + 1 :]] = y
        return ("patch", "/", dump(patch)) if patch else (None, None, None)

    return pd.DataFrame([one(*row) for row in zip(op, m_path, v_path, relation, value)], columns=["ev", "rel_path", "data"], dtype=object)


def overlay(tree_leaves: DataFrame, updates: DataFrame) -> DataFrame:
    """A tree with pending writes laid over it: leaves (db, path, value) a rule sees as newData.

    ``updates`` are expanded rows (db, path, value as leaf or null to remove).
    """
    up = updates.select("db", F.col("path").alias("__u"), F.col("value").alias("__v"))
    gone = tree_leaves.select("db", "path", F.explode(model.prefixes(F.col("path"))).alias("__u")).join(up.select("db", "__u").distinct(), ["db", "__u"], "left_semi").select("db", "path").distinct()
    under = up.filter("__v is not null").select("db", F.explode(model.prefixes(F.col("__u"), strict=True)).alias("path")).distinct()
    kept = tree_leaves.select("db", "path", "value").join(gone.unionByName(under).distinct(), ["db", "path"], "left_anti")
    return kept.unionByName(up.filter("__v is not null").select("db", F.col("__u").alias("path"), F.col("__v").alias("value")))
