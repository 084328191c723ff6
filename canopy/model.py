"""Paths, keys, values and their orders, as Spark columns.

A path is text without outer slashes (``""`` is the root); a child row of a collection
is (key, value as JSON text). Values order as: missing/null, false, true, numbers,
strings (bytewise), containers; numbers compare as doubles. Keys that are 32-bit
integers order numerically before all others, which order bytewise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_KEY_BYTES = 32, 768
#: Ranks of the value order.
NULL, FALSE, TRUE, NUMBER, STRING, CONTAINER = range(6)


# paths -----------------------------------------------------------------------

def trimmed(path: Column) -> Column:
    """A path without outer slashes; inner empty segments stay."""
    return F.btrim(path, F.lit("/"))


def normalized(path: Column) -> Column:
    """A path with one leading slash and no trailing one; ``/`` for the root."""
    return F.concat(F.lit("/"), trimmed(path))


def segments(path: Column) -> Column:
    t = trimmed(path)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "/"))


def joined(base: Column, child: Column) -> Column:
    """``child`` (one or more segments) below ``base``."""
    return trimmed(F.concat(trimmed(base), F.lit("/"), trimmed(child)))


def parent(path: Column) -> Column:
    """The parent path; null for the root."""
    t = trimmed(path)
    return F.when(t != "", F.substring(t, F.lit(1), F.greatest(F.length(t) - F.length(F.substring_index(t, "/", -1)) - 1, F.lit(0))))


def last_segment(path: Column) -> Column:
    t = trimmed(path)
    return F.when(t != "", F.substring_index(t, "/", -1))


def is_ancestor(a: Column, b: Column) -> Column:
    """Whether ``a`` is a strict ancestor of ``b``."""
    x, y = trimmed(a), trimmed(b)
    return (x != y) & ((x == "") | F.startswith(y, F.concat(x, F.lit("/"))))


def relative_to(path: Column, ancestor: Column) -> Column:
    """The rest of ``path`` below ``ancestor`` (``""`` if equal), null if it isn't below it."""
    p, a = trimmed(path), trimmed(ancestor)
    rest = F.when(a == "", p).otherwise(F.substring(p, F.length(a) + 2, F.length(p)))
    return F.when(p == a, F.lit("")).when(is_ancestor(a, p), rest)


def depth(trimmed_path: Column) -> Column:
    """The number of segments of a path without outer slashes."""
    return F.when(trimmed_path == "", 0).otherwise(F.length(trimmed_path) - F.length(F.replace(trimmed_path, F.lit("/"), F.lit(""))) + 1)


def prefixes(path: Column, strict: bool = False) -> Column:
    """All ancestors of a path from the root on, and itself unless ``strict``.

    The outer one-element transform binds the trimmed path, so it is made once per row.
    """

    def of(p):
        n = depth(p)
        first = lambda i: F.call_function("substring_index", p, F.lit("/"), i)
        every = F.transform(F.sequence(F.lit(0), n - 1 if strict else n), first)
        return F.when(n > 0, every).otherwise(F.array().cast("array<string>")) if strict else every

    return F.transform(F.array(trimmed(path)), of)[0]


def matches_pattern(path: Column, pattern: Column) -> Column:
    """Volatile patterns: ``*`` (or ``$name``) is one segment; a match holds for all below it."""
    p, q = segments(path), segments(pattern)
    pairs = F.zip_with(F.slice(p, 1, F.size(q)), q, lambda a, b: (b == "*") | F.startswith(b, F.lit("$")) | (a == b))
    return (F.size(p) >= F.size(q)) & F.forall(pairs, lambda ok: F.coalesce(ok, F.lit(False)))


def valid_key(key: Column) -> Column:
    r"""Not empty, at most 768 bytes, none of ``$ # [ ] /``, no control characters, ``.`` only in front."""
    return F.coalesce((key != "") & (F.octet_length(key) <= MAX_KEY_BYTES) & ~F.rlike(key, F.lit(r"[$#\[\]/\x00-\x1f\x7f]|(?s:.)\.")), F.lit(False))


def valid_path(path: Column) -> Column:
    s = segments(path)
    return (F.size(s) <= MAX_DEPTH) & F.forall(s, valid_key)


def valid_database(name: Column) -> Column:
    """1 to 40 of ``a-z 0-9 -``, no hyphen outside or twice in a row."""
    return F.rlike(name, F.lit("^[a-z0-9]+(-[a-z0-9]+)*$")) & (F.length(name) <= 40)


# keys and values ---------------------------------------------------------------

def int_key(key: Column) -> Column:
    """The 32-bit integer a key stands for, else null (no leading zeros, no ``-0``; a ``+`` is allowed)."""
    n = F.regexp_replace(key, r"^\+", "").try_cast("bigint")
    return F.when(F.rlike(key, F.lit(r"^\+?(0|[1-9][0-9]{0,9})$|^-[1-9][0-9]{0,9}$")) & n.between(-(2**31), 2**31 - 1), n.cast("int"))


def key_order(key: Column) -> list[Column]:
    """Sort columns of the key order."""
    return [int_key(key).asc_nulls_last(), key.asc()]


def key_struct(key: Column) -> Column:
    """The key order as one comparable struct."""
    n = int_key(key)
    return F.struct(n.isNull().alias("text"), F.coalesce(n, F.lit(0)).alias("n"), F.when(n.isNull(), key).otherwise(F.lit("")).alias("s"))


def sort_key(json: Column) -> Column:
    """rank, num, str of a JSON text; null and text that is no JSON rank as missing."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(v)
    num = F.try_variant_get(v, "$", "double")
    rank = (
        F.when(v.isNull() | (kind == "VOID"), NULL)
        .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), TRUE).otherwise(FALSE))
        .when(kind == "STRING", STRING)
        .when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), CONTAINER)
        .otherwise(NUMBER)
    )
    return F.struct(rank.alias("rank"), F.when(rank == NUMBER, num).otherwise(0.0).alias("num"), F.when(rank == STRING, F.try_variant_get(v, "$", "string")).otherwise("").alias("str"))


def scalar_sort_key(c: Column, kind: str) -> Column:
    """rank, num, str of a typed column, without going through JSON."""
    if kind == "boolean":
        return F.struct(F.when(c, TRUE).when(~c, FALSE).otherwise(NULL).alias("rank"), F.lit(0.0).alias("num"), F.lit("").alias("str"))
    if kind == "string":
        return F.struct(F.when(c.isNull(), NULL).otherwise(STRING).alias("rank"), F.lit(0.0).alias("num"), F.coalesce(c, F.lit("")).alias("str"))
    return F.struct(F.when(c.isNull(), NULL).otherwise(NUMBER).alias("rank"), F.coalesce(c.cast("double"), F.lit(0.0)).alias("num"), F.lit("").alias("str"))


def literal_sort_key(value) -> Column:
    """rank, num, str of a Python value (None, bool, number, str, dict or list)."""
    if value is None:
        rank, num, text = NULL, 0.0, ""
    elif isinstance(value, bool):
        rank, num, text = TRUE if value else FALSE, 0.0, ""
    elif isinstance(value, (int, float)):
        rank, num, text = NUMBER, float(value), ""
    elif isinstance(value, str):
        rank, num, text = STRING, 0.0, value
    else:
        rank, num, text = CONTAINER, 0.0, ""
    return F.struct(F.lit(rank).alias("rank"), F.lit(num).alias("num"), F.lit(text).alias("str"))


def child_json(json: Column, path: str) -> Column:
    """The JSON text below ``a/b`` of a JSON text, null if absent."""
    at = "$" + "".join("['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']" for s in path.strip("/").split("/") if s)
    return F.to_json(F.try_variant_get(F.try_parse_json(json), at, "variant"))
