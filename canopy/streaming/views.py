"""Live query views, volatile traffic and deduplication on Structured Streaming.

A view is one (db, view_path, query_id); its keyed state is a map of child key to value
(in the state store, not in memory) and the ordered keys of its window, which a limit
bounds. Rows of a micro-batch are applied in order of seq. A change that can't alter
the window costs one comparison with its edge, one that stays inside it a place in a sorted
list; only when a child of a full window leaves it or falls behind its edge is the map
scanned for the one that follows.

Events: ``put`` of a child's new value or null, ``patch`` where one child replaces
another or a child inside the window changed, ``put`` at ``/`` of the whole window on
subscribing and where the collection itself was replaced. Null values remove; repeated rows
with the same value give no events; unlimited views keep all their keys in the window.
"""

from __future__ import annotations

import bisect
import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canopy.functions.jsontext import INVALID, children, dump, has_leaf, parse
from canopy.operators.mutations import match_views
from canopy.operators.query import TreeQuery

EVENT_SCHEMA = "db string, view_path string, query_id string, seq long, ord int, ev string, rel_path string, data string"
FAST_MS, SLOW_MS = 50, 150


def py_sort_key(v) -> tuple[int, float, str]:
    if v is None:
        return 0, 0.0, ""
    if isinstance(v, bool):
        return (2 if v else 1), 0.0, ""
    if isinstance(v, (int, float)):
        return 3, float(v), ""
    return (4, 0.0, v) if isinstance(v, str) else (5, 0.0, "")


def py_key_order(key: str) -> tuple:
    digits = key.removeprefix("+").removeprefix("-") if not key.startswith("+-") else ""
    canonical = digits.isascii() and digits.isdigit() and (digits == "0" or digits[0] != "0") and key != "-0"
    if canonical and -(2**31) <= int(key) < 2**31:
        return 0, int(key), b""
    return 1, 0, key.encode("utf-8", "surrogatepass")


def child_order(q: TreeQuery, key: str, value) -> tuple:
    """The place of a child in a query's order, as a comparable tuple."""
    if q.order == "key":
        return ((0, 0.0, b""), py_key_order(key))
    v = value
    if q.order in ("child", "priority"):
        for s in (q.child if q.order == "child" else ".priority").split("/"):
            v = v.get(s) if isinstance(v, dict) else None
    r, n, s = py_sort_key(v)
    return ((r, n, s.encode("utf-8", "surrogatepass")), py_key_order(key))


def in_range(q: TreeQuery, place: tuple, key: str) -> bool:
    """The range test of a query on one child."""
    sort, order = place
    by_key = q.order == "key"

    def at(b):
        if by_key:
            text = b.value if isinstance(b.value, str) else b.key if b.value is None else None
            return text
        r, n, s = py_sort_key(b.value)
        return r, n, s.encode()

    if q.equal:
        if by_key:
            return key == (at(q.equal) or "")
        return sort == at(q.equal) and (q.equal.key is None or q.equal.key == key)
    for b, low in ((q.lower, True), (q.upper, False)):
        if not b or (a := at(b)) is None:
            continue
        mine, edge = (order, py_key_order(a)) if by_key else (sort, a)
        if not by_key and b.key is not None:
            mine, edge = (sort, order), (a, py_key_order(b.key))
        elif not by_key and mine == edge:
            if b.inclusive:
                continue
            return False
        if mine == edge:
            if not b.inclusive:
                return False
        elif (mine < edge) == low:
            return False
    return True


def _placed_in(value, segments: list[str], v):
    """``value`` with ``v`` at a path below it; containers left empty vanish, scalars on the way give way to what is written."""
    if not segments:
        return v
    k, *rest = segments
    box = dict(children(value)) if isinstance(value, (dict, list)) else {}
    if v is None and k not in box:
        return value
    x = _placed_in(box.get(k), rest, v)
    if x is None or (isinstance(x, (dict, list)) and not has_leaf(x)):
        box.pop(k, None)
    else:
        box[k] = x
    return box or None


class ViewProcessor(StatefulProcessor):
    """Keeps each view's window and emits what changed. ``queries`` maps query_id to its query."""

    def __init__(self, queries: dict[str, TreeQuery]):
        self.queries = queries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "key string", "value string")
        self.window = handle.getValueState("window", "keys array<string>")

    def _value(self, key):
        return self.values.getValue((key,))[0] if self.values.containsKey((key,)) else None

    def _keep(self, key, text):
        if text is not None:
            self.values.updateValue((key,), (text,))
        elif self.values.containsKey((key,)):
            self.values.removeKey((key,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        self.q = self.queries[key[2]]
        n = self.q.first if self.q.first is not None else self.q.last
        self.n = None if n is None or n < 0 else n
        self.order, self.places, out = [], {}, []  # (place, key) of the window, ascending
        for k in self.window.get()[0] if self.window.exists() else []:
            self._insert(k, child_order(self.q, k, json.loads(self._value(k))))
        for r in sorted(rows, key=lambda r: (r.seq, r.part)):
            events = self._events(r)
            out += [Row(db=key[0], view_path=key[1], query_id=key[2], seq=r.seq, ord=i, ev=e, rel_path=p, data=d) for i, (e, p, d) in enumerate(events)]
        self.window.update(([k for _, k in self.order],))
        return iter(out)

    def _whole(self):
        return ("put", "/", "{" + ",".join(f"{json.dumps(k)}:{self._value(k)}" for _, k in self.order) + "}" if self.order else "null")

    def _events(self, r) -> list[tuple[str, str, str]]:
        if r.kind == "sub":
            return [self._whole()]
        if r.kind in ("all", "unsub"):
            new = json.loads(r.value) if r.kind == "all" and r.value is not None else None
            for (k,) in [k for k, _ in self.values.iterator()]:
                self.values.removeKey((k,))
            for k, v in children(new) if isinstance(new, (dict, list)) else ():
                if v is not None and (not isinstance(v, (dict, list)) or has_leaf(v)):
                    self._keep(k, dump(v))
            self._scan()
            return [self._whole()] if r.kind == "all" else []
        had, text = self._value(r.key), r.value
        if r.rel:
            v = _placed_in(None if had is None else json.loads(had), r.rel.split("/"), None if text is None else json.loads(text))
            text = None if v is None else dump(v)
        if had == text:
            return []
        self._keep(r.key, text)
        was_in = r.key in self.places
        place = None if text is None else child_order(self.q, r.key, json.loads(text))
        entered, exited = self._move(r.key, place if place is not None and in_range(self.q, place, r.key) else None)
        if entered and exited:
            body = ",".join([f"{json.dumps(k)}:null" for k in exited] + [f"{json.dumps(k)}:{self._value(k)}" for k in entered])
            return [("patch", "/", "{" + body + "}")]
        events = [("put", f"/{k}", "null") for k in exited] + [("put", f"/{k}", self._value(k)) for k in entered]
        if was_in and r.key in self.places:
            events.append(("patch", "/", "{" + f"{json.dumps(r.key)}:{text}" + "}"))
        return events

    def _insert(self, key, place):
        bisect.insort(self.order, (place, key))
        self.places[key] = place

    def _move(self, key, place) -> tuple[list[str], list[str]]:
        """Give a child its new place (None: out of the query's range); the keys that entered and left the window."""
        first, full = self.q.first is not None, self.n is not None and len(self.order) == self.n
        edge = (self.order[-1] if first else self.order[0]) if self.order else None
        was = self.places.pop(key, None)
        if was is not None:
            self.order.pop(bisect.bisect_left(self.order, (was, key)))
        if was is not None and full and (place is None or ((place, key) > edge if first else (place, key) < edge)):
            before = {key, *self.places}
            self._scan()
            return [k for _, k in self.order if k not in before], [k for k in sorted(before) if k not in self.places]
        if place is None or self.n == 0:
            return [], [key] if was is not None else []
        self._insert(key, place)
        left = []
        if self.n is not None and len(self.order) > self.n:
            left = [self.order.pop(-1 if first else 0)[1]]
            del self.places[left[0]]
        if left == [key]:
            return [], []
        return ([key] if was is None else []), left

    def _scan(self):
        def ranged():
            for (k,), (v,) in self.values.iterator():
                p = child_order(self.q, k, json.loads(v))
                if in_range(self.q, p, k):
                    yield p, k

        pick = sorted(ranged()) if self.n is None else sorted((heapq.nsmallest if self.q.first is not None else heapq.nlargest)(self.n, ranged()))
        self.order, self.places = pick, {k: p for p, k in pick}

    def close(self) -> None:
        pass


def live_views(changes: DataFrame, queries: dict[str, TreeQuery]) -> DataFrame:
    """Events of views. ``changes`` (stream or table): db, view_path, query_id, seq, key, value (JSON or null).

    With a column ``rel`` the value stands that far below the child. With ``kind``: ``sub`` gives the
    window as it is (no key needed), ``unsub`` drops the view's state, ``all`` replaces the whole
    collection by the value. Needs the RocksDB state store provider on the session.
    """
    extra = [(F.col(c) if c in changes.columns else F.lit(None).cast("string")).alias(c) for c in ("rel", "kind")] + [(F.col("part") if "part" in changes.columns else F.lit(0)).cast("int").alias("part")]
    slim = changes.select("db", "view_path", "query_id", F.col("seq").cast("long").alias("seq"), "key", "value", *extra).filter("key is not null or kind in ('sub', 'unsub', 'all')")
    return slim.groupBy("db", "view_path", "query_id").transformWithState(ViewProcessor(queries), EVENT_SCHEMA, "Append", "None")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("key", "rel", "value", "kind")])))
def _child_changes(op: pd.Series, path: pd.Series, value: pd.Series, view: pd.Series) -> pd.Series:
    def one(o, p, text, at):
        p, v = p.strip("/"), None if o == "d" or text is None else parse(text)
        if v is INVALID or (o == "u" and not isinstance(v, dict)):
            return []
        parts = [(p, v)] if o != "u" else [(f"{p}/{k.strip('/')}".strip("/"), v[k]) for k in sorted(v)]
        out = []
        for where, x in parts:
            if where == at or where == "" or at.startswith(where + "/"):
                for k in filter(None, at[len(where) :].split("/")):
                    x = dict(children(x)).get(k) if isinstance(x, (dict, list)) else None
                out.append({"key": None, "rel": None, "value": None if x is None else dump(x), "kind": "all"})
            elif at == "" or where.startswith(at + "/"):
                key, _, rel = where[len(at) :].strip("/").partition("/")
                gone = x is None or (isinstance(x, (dict, list)) and not has_leaf(x))
                out.append({"key": key, "rel": rel or None, "value": None if gone else dump(x), "kind": None})
        return out

    return pd.Series([one(*row) for row in zip(op, path, value, view)], dtype=object)


def view_changes(mutations: DataFrame, views: DataFrame) -> DataFrame:
    """Rows for :func:`live_views` of the views (db, view_path, query_id) that mutations (db, seq, op, path, value) reach.

    A write below a child is its new value at ``rel``, so a sort field deep in a child moves it;
    a write of the view's path or above replaces the collection. The parts of an update that fall
    into one view have places of their own (``part``) after seq.
    """
    m = match_views(mutations, views)
    parts = m.select("db", F.col("v_path").alias("view_path"), "query_id", "seq", F.posexplode(_child_changes("op", "m_path", "value", "v_path")).alias("i", "c"))
    return parts.select("db", "view_path", "query_id", "seq", F.col("i").alias("part"), "c.key", "c.value", "c.rel", "c.kind")


def volatile_flush(writes: DataFrame, keys: list[str], ts: str, millis: int, value: str, seq: str) -> DataFrame:
    """The last value per key and flush window of ``millis`` (epoch-aligned), by time then seq."""
    ms = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1000 * millis)) * millis
    last = F.max_by(F.col(value), F.struct(F.col(ts), F.col(seq)))
    return writes.groupBy(*keys, ms.cast("bigint").alias("flush_ms")).agg(last.alias("value"), F.count("*").alias("coalesced"))


def dedup_stream(writes: DataFrame, ts: str, keys: tuple[str, ...] = ("client", "request_id"), within: str = "10 minutes") -> DataFrame:
    """Drop repeated requests that come within the watermark; state is bounded by it."""
    return writes.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def stream_windows(samples: DataFrame, keys: list[str], ts: str, length: str, sums: list[str], delay: str = "10 minutes") -> DataFrame:
    """Tumbling sums with late data up to ``delay``, for append output."""
    return samples.withWatermark(ts, delay).groupBy(*keys, F.window(ts, length)).agg(*[F.sum(c).alias(c) for c in sums])


def run_available(stream: DataFrame, at: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now; its output as a table. ``at`` holds checkpoint and output."""
    spark = stream.sparkSession

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if kept is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)
    return spark.read.schema(stream.schema).parquet(f"{at}/out/*")


