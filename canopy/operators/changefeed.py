"""Applying a feed of inserts, updates and deletes to rebuild the current tree.

The feed is folded by *keyed streaming state*: one state row per written path and
database holds the payload of the newest change, its position (sequence, line,
order inside the entry) and, as a null payload, the tombstone. A change is accepted
only if its position is newer, so repeated and out-of-order deliveries fold to the
same state whatever the batches. Each micro-batch emits the touched state rows as
upserts into a folder of its own number; a repeated batch overwrites its folder.

``resolve`` then turns the written paths into live leaves: a write of an ancestor
that came later wipes what lies below it, and a later write below a scalar replaces
the scalar. Both are tested in one ordered pass over ranges of the tree.

Nulls: a row without project, database, sequence, line, op or path has no effect.
Empty feeds give no leaves. Extra columns of the feed are ignored. Values nested to any
depth are read. A number beyond the doubles reads back as ``1e999``.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy import model
from canopy.functions.jsontext import INVALID, dump, has_leaf, leaves, parse, safe
from canopy.session import folders, remove, run_dir, written

DB = ["project_id", "database_id"]
FEED = [*DB, "sequence", "line_no", "op", "path", "value"]
CHANGE_SCHEMA = "project_id string, database_id string, sequence long, line_no int, path string, idx int, payload string"
LEAF_SCHEMA = "project_id string, database_id string, path string, value string, sequence long, line_no int"
STATE_SCHEMA = (
    "project_id string, database_id string, path string, "
    "last struct<sequence: long, line_no: int, idx: int, payload: string>, "
    "wrote struct<sequence: long, line_no: int, idx: int>"
)
#: State rows of a part of the tree at most, on average, and rows sampled per part to find where parts begin.
PART_ROWS, SAMPLE = 1 << 20, 64


def _expand_one(op: str, path: str, value: str | None) -> Iterator[tuple[str, int, str | None]]:
    path = path.strip("/")
    if op == "d":
        yield path, 0, None
    elif op == "s":
        v = None if value is None else parse(value)
        if v is not INVALID:
            yield path, 0, value if has_leaf(v) else None
    elif op == "u":
        v = parse(value)
        if isinstance(v, dict):
            for i, k in enumerate(sorted(v)):
                yield safe(f"{path}/{k.strip('/')}".strip("/")), i, dump(v[k]) if has_leaf(v[k]) else None


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns that stay are taken by row number in Arrow; only op, path and value become Python objects."""
    names = [*DB, "sequence", "line_no", "path", "idx", "payload"]
    for b in batches:
        at, paths, order, payloads = [], [], [], []
        for row, (op, path, value) in enumerate(zip(*(b.column(i).to_pylist() for i in (4, 5, 6)), strict=True)):
            for target, i, payload in _expand_one(op, path, value):
                at.append(row)
                paths.append(target)
                order.append(i)
                payloads.append(payload)
        rows = pa.array(at, pa.int32())
        kept = [b.column(i).take(rows) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(paths, pa.string()), pa.array(order, pa.int32()), pa.array(payloads, pa.string())], names=names)


def expand(feed: DataFrame) -> DataFrame:
    """One row per path that an entry replaces: SET and DELETE give one, UPDATE one per key.

    A null payload is a removal. Entries whose value is not valid JSON give nothing.
    """
    present = None
    for c in FEED[:-1]:
        present = F.col(c).isNotNull() if present is None else present & F.col(c).isNotNull()
    slim = feed.filter(present).select(
        *DB, F.col("sequence").cast("long"), F.col("line_no").cast("int"), "op", "path", "value"
    )
    return slim.mapInArrow(_expand, CHANGE_SCHEMA)


def fold(changes: DataFrame) -> DataFrame:
    """The newest change per written path, and the position of the newest write that left something.

    On a stream this is the keyed state; on a table it is a plain aggregation.
    """
    pos = F.struct("sequence", "line_no", "idx")
    return changes.groupBy(*DB, "path").agg(
        F.max(F.struct("sequence", "line_no", "idx", "payload")).alias("last"),
        F.max(F.when(F.col("payload").isNotNull(), pos)).alias("wrote"),
    )


def latest(upserts: DataFrame) -> DataFrame:
    """The current state rows out of all batches' upserts (state only ever moves forward)."""
    return upserts.groupBy(*DB, "path").agg(F.max("last").alias("last"), F.max("wrote").alias("wrote"))


_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",  # else each write reads first
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def stream_state(
    spark: SparkSession, feed_path: str, at: str | None = None, bytes_per_batch: int = 8 << 30, files_per_batch: int | None = None
) -> DataFrame:
    """Fold the feed's files as a stream; gives the state rows (``STATE_SCHEMA``).

    ``at`` holds the checkpoint and the batch-versioned upserts. Calling again with
    the same ``at`` reads only files that came since, and continues from the state.
    """
    at = at or run_dir(spark, "changefeed")
    schema = spark.read.parquet(feed_path).schema
    kept = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)

    def upsert(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{at}/upserts/batch={batch}")

    try:
        source = spark.readStream.schema(schema)
        source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source.option("maxBytesPerTrigger", bytes_per_batch)
        query = (
            fold(expand(source.parquet(f"{feed_path[:-1]}[{feed_path[-1]}]")))  # a pattern, so that one file will do
            .writeStream.outputMode("update")
            .foreachBatch(upsert)
            .option("checkpointLocation", f"{at}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return _current(spark, at)


def _current(spark: SparkSession, at: str) -> DataFrame:
    """The state rows as a table: all batches' upserts, compacted into one version of the state.

    Batches up to a version's number are part of it and go; the version before the newest
    stays, as results may still read it. A first run of one batch is its own state.
    """
    number = lambda names, kind: sorted(int(n.split("=")[1]) for n in names if n.startswith(kind))
    versions, batches = number(folders(spark, f"{at}/state"), "upto="), number(folders(spark, f"{at}/upserts"), "batch=")
    done = versions[-1] if versions else -1
    fresh = [b for b in batches if b > done]
    read = lambda path: spark.read.schema(STATE_SCHEMA).parquet(path)
    if not versions and len(fresh) < 2:
        return read(f"{at}/upserts/batch={fresh[0]}") if fresh else spark.createDataFrame([], STATE_SCHEMA)
    if fresh:
        parts = [f"{at}/upserts/batch={b}" for b in fresh] + ([f"{at}/state/upto={done}"] if versions else [])
        latest(spark.read.schema(STATE_SCHEMA).parquet(*parts)).write.mode("overwrite").parquet(f"{at}/state/upto={fresh[-1]}")
        for old in versions[:-1]:
            remove(spark, f"{at}/state/upto={old}")
        if versions:
            for b in batches:
                if b <= done:
                    remove(spark, f"{at}/upserts/batch={b}")
        done = fresh[-1]
    return read(f"{at}/state/upto={done}")


def _codes(*columns: pa.Array) -> pa.Array:
    """Positions (sequence, line, order in the entry) as 16 bytes that compare in the same order; null stays null."""
    valid = columns[0].is_valid()
    packed = np.empty(len(valid), [("s", ">u8"), ("l", ">u4"), ("i", ">u4")])
    for name, c, bits in zip("sli", columns, (64, 32, 32), strict=True):
        whole = c.fill_null(0).to_numpy(zero_copy_only=False).astype(f"i{bits // 8}")
        packed[name] = whole.view(f"u{bits // 8}") ^ np.array(1 << (bits - 1), f"u{bits // 8}")
    codes = pa.Array.from_buffers(pa.binary(16), len(valid), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
    return pc.if_else(valid, codes, pa.scalar(None, pa.binary()))


def _decoded(code: bytes) -> tuple[int, int]:
    """Sequence and line of a position."""
    s, n, _ = struct.unpack(">QII", code)
    return s - (1 << 63), n - (1 << 31)


def _escaped(text: str) -> str:
    return text.replace("\1", "\1\2").replace("\0", "\1\1") if "\1" in text or "\0" in text else text


def _tree_key(project: str, database: str, path: str) -> str:
    """A text per node, in whose order each node comes right before all that lies below it."""
    head = f"{_escaped(project)}\0{_escaped(database)}"
    return f"{head}\0{_escaped(path).replace('/', chr(0))}" if path else head


def _tree_node(key: str) -> tuple[str, str, str]:
    parts = key.split("\0", 2)
    parts[2:] = [parts[2].replace("\0", "/")] if len(parts) > 2 else [""]
    return tuple(x.replace("\1\1", "\0").replace("\1\2", "\1") if "\1" in x else x for x in parts)


def _bounds(state: DataFrame, n: int, parts: int) -> list[tuple[str, str, str]]:
    """The nodes at which the parts of the tree begin, from a sample of about ``SAMPLE`` rows a part, by size of payload."""
    if parts < 2:
        return []
    size = (F.octet_length(F.coalesce("last.payload", F.lit(""))) + 32).alias("size")
    rows = state.sample(min(1.0, SAMPLE * parts / max(n, 1)), 7).select(*DB, "path", size).collect()
    sample = sorted((_tree_key(*r[:3]), r) for r in rows)
    whole, so_far, out = sum(r["size"] for _, r in sample), 0, []
    for _, r in sample:
        if so_far * parts >= whole * (len(out) + 1) and (not out or out[-1] != tuple(r[:3])):
            out.append(tuple(r[:3]))
        so_far += r["size"]
    return out


def _above(state: DataFrame, bounds: list[tuple[str, str, str]]) -> tuple[dict[str, bytes], dict[str, bytes]]:
    """Of the nodes above the bounds (a bound's depth each): their own position, and the newest write below them that left something."""
    spark = state.sparkSession
    nodes = {(p, d, "/".join(path.split("/")[:i])) for p, d, path in bounds for i in range(len(path.split("/")) if path else 0)}
    if not nodes:
        return {}, {}
    up = F.broadcast(spark.createDataFrame(sorted(nodes), "project_id string, database_id string, up string"))
    cut = F.broadcast(spark.createDataFrame(sorted({n[:2] for n in nodes}), "project_id string, database_id string"))
    steps = state.join(cut, DB, "left_semi").select(*DB, "path", F.struct("last.sequence", "last.line_no", "last.idx").alias("pos"), "wrote", F.explode(model.prefixes(F.col("path"))).alias("up")).join(up, [*DB, "up"])
    own = F.max(F.when(F.col("path") == F.col("up"), F.col("pos"))).alias("pos")
    found = steps.groupBy(*DB, "up").agg(own, F.max(F.when(F.col("path") != F.col("up"), F.col("wrote"))).alias("wrote")).collect()
    out = []
    for name in ("pos", "wrote"):
        kinds = (pa.int64(), pa.int32(), pa.int32())
        codes = _codes(*(pa.array([None if r[name] is None else r[name][i] for r in found], k) for i, k in enumerate(kinds)))
        out.append({_tree_key(*r[:3]): c for r, c in zip(found, codes.to_pylist(), strict=True) if c is not None})
    return out[0], out[1]


class _Payload:
    """The payload of a live mark while the pass is below it; what newer marks replace is taken out."""

    def __init__(self, pos: bytes, text: str):
        self.pos, self.text, self.tree = pos, text, None

    def _grown(self):
        """The payload as nested dicts by path segment; of two values for one place a subtree counts before a scalar."""
        v = parse(self.text)
        if not isinstance(v, (dict, list)):
            return v
        root: dict = {}
        for path, x in leaves("", v):
            *head, tail = path.split("/")
            at = root
            for k in head:
                if not isinstance(at.get(k), dict):
                    at[k] = {}
                at = at[k]
            if not isinstance(at.get(tail), dict):
                at[tail] = x
        return root

    def replace(self, below: str, pos: bytes, wrote: bytes | None) -> None:
        """A mark at the tree key ``below`` this one: newer ones take their subtree, and scalars on the way if they left something."""
        if pos <= self.pos:
            return
        if self.tree is None:
            self.tree = self._grown()
        left = wrote is not None and wrote > self.pos
        if not isinstance(self.tree, dict):
            self.tree = {} if left else self.tree
            return
        at = self.tree
        *head, tail = below.split("\0")
        for k in head:
            x = at.get(k)
            if not isinstance(x, dict):
                if left:
                    at.pop(k, None)
                return
            at = x
        at.pop(tail, None)

    def leaves(self, path: str) -> Iterator[tuple[str, object]]:
        if self.tree is None:
            named_twice = "/" in self.text or "\\" in self.text  # perhaps: keys that hold a slash
            self.tree = self._grown() if named_twice else parse(self.text)
        return leaves(path, self.tree)


def resolve(state: DataFrame) -> DataFrame:
    """Live leaves of folded state: project_id, database_id, path, value, sequence, line_no.

    ``state`` is read several times, so give it as a table. Its rows (marks) are cut into parts
    by ranges of the tree's own order, in which a node comes right before all that lies below
    it; one shuffle brings them there, and one pass over each part keeps the marks above the
    present one on a stack. A mark older than one above it is dead. A newer one takes its subtree
    out of the payloads above, and the scalars on the way if it left something. What is left
    of a payload when the pass leaves its subtree are live leaves.

    Marks in whose subtree another part begins (at most a path's depth per part) send their
    leaves to the parts one by one, and each part is given the marks above its first node. So a
    database or collection with a third of all rows is cut like any other. Parts are as many
    as shuffle partitions, or one per ``PART_ROWS`` state rows if those are more.

    If a payload names a place twice (by keys that hold ``/``), a subtree counts before a scalar.
    """
    spark = state.sparkSession
    n = state.count()
    bounds = _bounds(state, n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // PART_ROWS + 1))
    marks, wrote_below = _above(state, bounds)
    edges = [_tree_key(*b) for b in bounds]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, wrote = _codes(*b.columns[4:7]), _codes(*b.columns[7:10])
            rows, left, parts, keys, values = [], [], [], [], []
            for row, (p, d, path, payload) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)):
                key = _tree_key(p, d, path)
                part = bisect_right(edges, key)
                cut = part < len(edges) and edges[part].startswith(key + "\0")  # another part begins below this node
                rows.append(row)
                left.append(row)
                parts.append(part)
                keys.append(key)
                values.append(None if cut else payload)
                if cut and payload is not None:
                    for at, x in _Payload(b"", payload).leaves(path):
                        key = _tree_key(p, d, safe(at))
                        rows.append(row)
                        left.append(None)
                        parts.append(bisect_right(edges, key))
                        keys.append(key)
                        values.append(dump(x))
            columns = [pa.array(parts, pa.int32()), pa.array(keys, pa.string()), own.take(pa.array(rows, pa.int32())), wrote.take(pa.array(left, pa.int32())), pa.array([x is not None for x in left]), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "key", "pos", "wrote", "mark", "value"])

    def opened(part: int) -> list[list]:
        """The marks above a part's first node, outermost first, as stack entries."""
        stack, newest = [], b""
        segments = edges[part - 1].split("\0") if part else []
        for i in range(2, len(segments)):
            key = "\0".join(segments[:i])
            if key in marks:
                newest = max(newest, marks[key])
                stack.append([key, key + "\0", newest, None, None])
        return stack

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a stack entry: node, what its descendants begin with, newest mark on the way, leaf that was sent here, payload
        part, stack, out, holding = None, [], [], []
        kinds, names = [*[pa.string()] * 4, pa.int64(), pa.int32()], [*DB, "path", "value", "sequence", "line_no"]

        def table():
            cols = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        def close(node):
            key, _, newest, leaf, payload = node
            if payload:
                holding.pop()
                project, database, path = _tree_node(key)
                at = _decoded(payload.pos)
                for p, x in payload.leaves(path):
                    out.append((project, database, f"/{safe(p)}", dump(x), *at))
            if leaf and leaf[0] >= newest and wrote_below.get(key, b"") <= leaf[0]:
                project, database, path = _tree_node(key)
                out.append((project, database, f"/{path}", leaf[1], *_decoded(leaf[0])))

        for b in batches:
            for p, key, pos, wrote, mark, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part:
                    while stack:
                        close(stack.pop())
                    part, stack = p, opened(p)
                while stack and key != stack[-1][0] and not key.startswith(stack[-1][1]):
                    close(stack.pop())
                if not stack or stack[-1][0] != key:
                    stack.append([key, key + "\0", stack[-1][2] if stack else b"", None, None])
                top = stack[-1]
                if mark:
                    for node in holding:
                        node[4].replace(key[len(node[1]) :], pos, wrote)
                    if wrote is not None and len(stack) > 1:
                        for node in stack[:-1]:
                            if node[3] and node[3][0] < wrote:
                                node[3] = None
                    if pos >= top[2]:
                        top[2] = pos
                        if value is not None:
                            top[4] = _Payload(pos, value)
                            holding.append(top)
                elif not top[3] or (pos, value) > top[3]:
                    top[3] = (pos, value)
            yield table()
        while stack:
            close(stack.pop())
        if out:
            yield table()

    columns = [*DB, "path", "last.payload", "last.sequence", "last.line_no", "last.idx", "wrote.sequence", "wrote.line_no", "wrote.idx"]
    dealt = state.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = dealt.mapInArrow(spread, "part int, key string, pos binary, wrote binary, mark boolean, value string")
    return rows.repartitionById(len(edges) + 1, F.col("part")).sortWithinPartitions("part", "key").mapInArrow(scan, LEAF_SCHEMA)


def current_leaves(spark: SparkSession, feed_path: str, **options) -> DataFrame:
    """The whole operator: stream the feed into keyed state, then resolve the live leaves."""
    return resolve(stream_state(spark, feed_path, **options))


def state_at(feed: DataFrame, sequence: int | None = None) -> DataFrame:
    """Live leaves of a feed held as a table, up to and with log file ``sequence``."""
    feed = feed if sequence is None else feed.filter(F.col("sequence") <= sequence)
    return resolve(written(fold(expand(feed)), "feed-state"))
