"""Deeply nested semi-structured records to flat tables of parents and children, by structural variant.

A bottom-up tree automaton walks each JSON text: a scalar's state is its type, an
array's state is the set of its elements' states, an object's state is the set of
its (key, child state) pairs. Keys that look like data (push ids, numbered names, integers)
run through the automaton as ``*``, so a map of a thousand users has one shape. The
state of an object, as a 64-bit hash, is its *variant*. Objects with the same
*position* (path with indexes and data keys as ``*``) make up a table, each variant
a typed subtype of it, and the keys all variants share are the supertype.

``route`` writes every object to its subtype's place: one table, dealt and sorted by position
and variant, so that a subtype is a run of row groups that Parquet finds by their statistics.
A subtype with a third of all objects is dealt over several files. What a key is in the end is
decided from the data (:func:`key_shapes`): one that looks like data but is held by many objects
of a position is a field (``address1``), and where a position has very many keys that few
objects hold, these are data however they look.

Every object gives one row with the JSON pointer of itself and of the nearest object
around it, so children join to parents on (table_name, row_id, pointer).

Defined results: null, empty or torn text gives no rows; text that is a scalar gives
none; JSON text inside a string stays a string; an object with integer keys is an
object; repeated input rows give their rows each. Extra columns are ignored. Any depth is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.jsontext import INVALID, dump, parse, safe

OBJECT_SCHEMA = (
    "table_name string, row_id long, parent_path string, child_path string, in_array boolean, position string, variant string, "
    "fields array<struct<key: string, kind: string>>, data_keys array<struct<key: string, kind: string>>, scalars string"
)
LINKS, SHAPE = ["table_name", "row_id", "parent_path", "child_path"], ["table_name", "position"]
#: Files that a subtype is dealt over, and names and shapes that a walk remembers.
SALTS, REMEMBERED = 8, 1 << 17
#: A key that this share of a position's objects hold is a field; one that looks like data also needs so many objects.
NAMED_SHARE, EVIDENCE = 0.01, 20
#: With more keys than these below the share, such keys of a position are data.
RARE_KEYS = 100
#: Keys that look like data rather than like field names: push ids, integers, a short word and digits.
DATA_KEY = re.compile(r"-[0-9A-Za-z_-]{8,}|\d+|[A-Za-z]{1,12}[0-9]+|.*[/:.].*", re.DOTALL)
SCALARS = {bool: "boolean", int: "bigint", float: "double", str: "string", type(None): "null"}


def _state(text: str) -> str:
    return f"{xxhash.xxh64_intdigest(text):016x}"


def _pointer(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1") if "~" in key or "/" in key else key


class _Names(dict):
    """Keys as the automaton sees them: themselves, or ``*``."""

    def __missing__(self, key):
        if len(self) > REMEMBERED:
            self.clear()
        self[key] = name = "*" if DATA_KEY.fullmatch(key) else key
        return name


def objects_of(value, names: dict | None = None, shapes: dict | None = None) -> Iterator[tuple]:
    """(pointer, parent pointer, element of an array, position, variant, fields, data keys, scalars) of each object.

    Children come before their parents; the walk keeps its own stack. ``shapes`` remembers
    the variant and fields of signatures seen before.
    """
    names, shapes = _Names() if names is None else names, {} if shapes is None else shapes
    states: dict[int, str] = {}
    # a frame is entered, then left once its children's states are known
    todo = [(value, "", None, False, "$", False)]
    while todo:
        v, at, parent, in_array, position, leave = todo.pop()
        is_object = isinstance(v, dict)
        if not leave:
            if not is_object and not isinstance(v, list):
                continue
            todo.append((v, at, parent, in_array, position, True))
            around = at if is_object else parent
            if parent is None and not is_object:
                around = ""  # the root array stands for the root
            if is_object:
                for k, x in v.items():
                    if isinstance(x, (dict, list)):
                        todo.append((x, f"{at}/{_pointer(k)}", around, False, f"{position}.{names[k]}", False))
            else:
                for i, x in enumerate(v):
                    if isinstance(x, (dict, list)):
                        todo.append((x, f"{at}/{i}", around, True, f"{position}[]", False))
            continue
        if not is_object:
            state = "[" + ",".join(sorted({states[id(x)] if isinstance(x, (dict, list)) else SCALARS[type(x)] for x in v})) + "]"
            states[id(v)] = state if len(state) <= 64 else "[" + _state(state) + "]"
            continue
        pairs, scalars, data = set(), {}, []
        for k, x in v.items():
            name = names[k]
            if isinstance(x, (dict, list)):
                state, kind = states[id(x)], "object" if isinstance(x, dict) else "array"
            else:
                state = kind = SCALARS[type(x)]
                scalars[k] = x
            pairs.add((name, state, kind))
            if name == "*":
                data.append((k, kind))
        signature = tuple(sorted(pairs))
        shape = shapes.get(signature)
        if shape is None:
            if len(shapes) > REMEMBERED:
                shapes.clear()
            kinds: dict[str, set] = {}
            for name, _, kind in signature:
                kinds.setdefault(name, set()).add(kind)
            text = "\0".join(f"{name}\1{state}" for name, state, _ in signature)
            shape = shapes[signature] = (_state(safe(text)), [(safe(k), "|".join(sorted(kinds[k]))) for k in sorted(kinds)])
        states[id(v)] = shape[0]
        yield at, parent, in_array, position, shape[0], shape[1], data, scalars


def _pairs(rows: list) -> pa.Array:
    """Lists of (key, kind) pairs as one Arrow column, built flat; None stays null."""
    offsets, flat = [0], []
    for r in rows:
        flat.extend(r or ())
        offsets.append(len(flat))
    keys, kinds = zip(*flat, strict=True) if flat else ((), ())
    values = pa.StructArray.from_arrays([pa.array([safe(k) for k in keys], pa.string()), pa.array(kinds, pa.string())], ["key", "kind"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array([r is None for r in rows], pa.bool_()))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, shapes = _Names(), {}
    columns = ["table_name", "row_id", "parent_path", "child_path", "in_array", "position", "variant", "fields", "data_keys", "scalars"]
    for b in batches:
        seen: set[str] = set()
        row, parents, paths, arrays, positions, variants_, fields_, data_, scalars_ = ([] for _ in range(9))
        for i, text in enumerate(b.column(2).to_pylist()):
            v = parse(text)
            if v is INVALID or not isinstance(v, (dict, list)):
                continue
            for at, parent, in_array, position, variant, fields, data, scalars in objects_of(v, names, shapes):
                row.append(i)
                parents.append(None if parent is None else safe(parent))
                paths.append(safe(at))
                arrays.append(in_array)
                positions.append(safe(position))
                variants_.append(variant)
                fields_.append(None if (position, variant) in seen else fields)  # once a batch is enough for the catalogue
                seen.add((position, variant))
                data_.append(data or None)
                scalars_.append(dump(scalars))
        at = pa.array(row, pa.int32())
        text = lambda x: pa.array(x, pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), text(parents), text(paths), pa.array(arrays, pa.bool_()), text(positions), text(variants_), _pairs(fields_), _pairs(data_), text(scalars_)], names=columns)


def flatten_objects(df: DataFrame, table_name: str, row_id: str, json: str) -> DataFrame:
    """One row per object of the column ``json`` (``OBJECT_SCHEMA``).

    ``parent_path`` is null for an object that is the root; ``scalars`` holds the object's own
    scalar fields as JSON text, ready for typing by variant; ``fields`` is there for a
    part of a variant's objects only, at least one, as all have the same.
    """
    slim = df.filter(F.col(json).isNotNull()).select(F.lit(table_name).alias("table_name"), F.col(row_id).cast("long").alias("row_id"), F.col(json).alias("json"))
    return slim.mapInArrow(_walk, OBJECT_SCHEMA)


def route(objects: DataFrame, at: str) -> DataFrame:
    """Write each object to the place of its position and variant, and read the table back.

    Rows are dealt by subtype (and a salt, so that a subtype may be large) and sorted by it.
    """
    dealt = objects.repartition(*SHAPE, "variant", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    dealt.sortWithinPartitions(*SHAPE, "variant").write.parquet(at)
    return objects.sparkSession.read.schema(OBJECT_SCHEMA).parquet(at)


def array_children(objects: DataFrame) -> DataFrame:
    """The parent-child links of objects that are elements of arrays."""
    return objects.filter("in_array").select(*LINKS)


def with_parents(objects: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Objects joined to the object around them: links, position and variant, and those of the parent (null for roots)."""
    up = (objects if parents is None else parents).select("table_name", "row_id", F.col("child_path").alias("parent_path"), F.col("position").alias("parent_position"), F.col("variant").alias("parent_variant"))
    return objects.select(*LINKS, "position", "variant").join(up, ["table_name", "row_id", "parent_path"], "left")


def variants(objects: DataFrame) -> DataFrame:
    """The catalogue: each position's variants, their fields and how many objects have them."""
    return objects.groupBy(*SHAPE, "variant").agg(F.first("fields", ignorenulls=True).alias("fields"), F.count("*").alias("objects"))


def key_shapes(objects: DataFrame) -> DataFrame:
    """table_name, position, key, kinds, objects (that hold it), looks (like data), field: what each key is, by who holds it."""
    catalogue = variants(objects)
    whole = catalogue.groupBy(*SHAPE).agg(F.sum("objects").alias("all"))
    named = catalogue.select(*SHAPE, "objects", F.explode("fields").alias("f")).filter("f.key <> '*'").select(*SHAPE, "f.key", "f.kind", "objects", F.lit(False).alias("looks"))
    data = objects.select(*SHAPE, F.explode("data_keys").alias("f")).groupBy(*SHAPE, "f.key", "f.kind").agg(F.count("*").alias("objects")).withColumn("looks", F.lit(True))
    keys = named.unionByName(data).groupBy(*SHAPE, "key", "looks").agg(F.sum("objects").alias("objects"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))
    rare = keys.join(whole, SHAPE).withColumn("rare", F.col("objects") < NAMED_SHARE * F.col("all"))
    many = rare.filter("rare and not looks").groupBy(*SHAPE).agg((F.count("*") > RARE_KEYS).alias("many"))
    field = F.when(F.col("looks"), ~F.col("rare") & (F.col("objects") >= EVIDENCE)).otherwise(~F.col("rare") | ~F.coalesce("many", F.lit(False)))
    return rare.join(many, SHAPE, "left").select(*SHAPE, "key", "kinds", "objects", "looks", field.alias("field"))


def subtypes(objects: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """The catalogue by what keys are: table_name, position, subtype, fields (key, kind; ``*`` for all data keys), objects.

    A variant's keys that turned out to be data become ``*``; keys that look like data but are
    fields are named, so objects with and without ``address2`` are two subtypes.
    """
    shapes = key_shapes(objects) if shapes is None else shapes
    made = shapes.filter("looks and field").groupBy(*SHAPE).agg(F.array_sort(F.collect_set("key")).alias("made"))  # at most one per share
    lost = shapes.filter("not looks and not field").select(*SHAPE, "key", F.lit(True).alias("lost"))
    own = F.array_sort(F.filter(F.coalesce("data_keys", F.array().cast("array<struct<key:string,kind:string>>")), lambda d: F.array_contains(F.col("made"), d["key"])))
    told = objects.join(made, SHAPE, "left").select(*SHAPE, "variant", "fields", F.when(F.col("made").isNotNull(), own).alias("own"), (F.size("data_keys") > F.size(own)).alias("rest"))
    told = told.groupBy(*SHAPE, "variant", "own", "rest").agg(F.count("*").alias("objects"))
    named = variants(objects).select(*SHAPE, "variant", F.explode("fields").alias("f")).select(*SHAPE, "variant", F.col("f.key").alias("key"), F.col("f.kind").alias("kind")).join(lost, [*SHAPE, "key"], "left")
    kept = named.groupBy(*SHAPE, "variant").agg(F.array_sort(F.collect_set(F.struct(F.when(F.col("lost"), "*").otherwise(F.col("key")).alias("key"), F.when(F.col("lost"), F.lit("any")).otherwise(F.col("kind")).alias("kind")))).alias("kept"))
    held = F.coalesce("kept", F.array().cast("array<struct<key:string,kind:string>>"))
    whole = F.when(F.col("own").isNull(), held).otherwise(F.array_sort(F.concat(F.filter(held, lambda f: (f["key"] != "*") | F.col("rest")), "own")))
    out = told.join(kept, [*SHAPE, "variant"], "left").select(*SHAPE, whole.alias("fields"), "objects")
    return out.groupBy(*SHAPE, "fields").agg(F.sum("objects").alias("objects")).select(*SHAPE, F.lower(F.hex(F.xxhash64(F.to_json("fields")))).alias("subtype"), "fields", "objects")


def supertypes(objects: DataFrame) -> DataFrame:
    """The keys that every variant of a position has, with all kinds seen for them."""
    catalogue = variants(objects)
    total = catalogue.groupBy(*SHAPE).agg(F.count("*").alias("variants"), F.sum("objects").alias("objects"))
    keys = (
        catalogue.select(*SHAPE, F.explode("fields").alias("f"))
        .groupBy(*SHAPE, F.col("f.key").alias("key"))
        .agg(F.count("*").alias("having"), F.array_join(F.array_sort(F.collect_set("f.kind")), "|").alias("kinds"))
    )
    common = keys.join(total, SHAPE).filter(F.col("having") == F.col("variants"))
    shared = common.groupBy(*SHAPE).agg(F.array_sort(F.collect_list(F.struct("key", "kinds"))).alias("common_keys"))
    return total.join(shared, SHAPE, "left")


def subtype_table(objects: DataFrame, table_name: str, position: str, variant: str, named: tuple[str, ...] = ()) -> DataFrame:
    """The typed table of one variant: links, then a column per named scalar field.

    Data keys (``*`` in the variant) have no column of their own but those ``named``
    (:func:`key_shapes`), as text; all stay in ``scalars``.
    """
    own = objects.filter((F.col("table_name") == table_name) & (F.col("position") == position) & (F.col("variant") == variant))
    head = own.filter("fields is not null").select("fields").limit(1).collect()
    typed = [(f.key, f.kind) for f in (head[0].fields if head else []) if f.kind in ("boolean", "bigint", "double", "string") and f.key != "*"]
    typed += [(k, "string") for k in named]
    links = [*LINKS, "scalars"]
    if not typed:
        return own.select(*links)
    schema = ", ".join(f"`{k.replace('`', '``')}` {t}" for k, t in typed)
    parsed = own.select(*links, F.from_json("scalars", schema).alias("_f"))
    return parsed.select(*links, *[F.col("_f").getField(k).alias(f"f_{k}") for k, _ in typed])
