"""Rule expressions as Spark columns.

A rule value is a triple of columns (rank, num, str), the ranks those of the value
order. Snapshots (data, newData, root) stay symbolic: each place of the tree an
expression reads becomes one *lookup* (source, path column), which the engine answers
with a join. Every expression is total: nothing raises under ANSI mode, and unknown
names and methods are null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy import model
from canopy.model import CONTAINER, FALSE, NULL, NUMBER, STRING, TRUE

NAN = float("nan")


@dataclass
class Val:
    r: Column
    n: Column
    s: Column
    snap: tuple[str, Column] | None = None
    items: list[Val] | None = None
    members: Callable[[str], Val] | None = None


def null() -> Val:
    return Val(F.lit(NULL), F.lit(0.0), F.lit(""))


def of_struct(c: Column) -> Val:
    return Val(F.coalesce(c.getField("rank"), F.lit(NULL)), F.coalesce(c.getField("num"), F.lit(0.0)), F.coalesce(c.getField("str"), F.lit("")))


def literal(v) -> Val:
    return of_struct(model.literal_sort_key(v))


def of_bool(c: Column) -> Val:
    return Val(F.when(F.coalesce(c, F.lit(False)), TRUE).otherwise(FALSE), F.lit(0.0), F.lit(""))


def of_number(c: Column) -> Val:
    return Val(F.when(c.isNull(), NULL).otherwise(NUMBER), F.coalesce(c, F.lit(0.0)).cast("double"), F.lit(""))


def of_string(c: Column) -> Val:
    return Val(F.when(c.isNull(), NULL).otherwise(STRING), F.lit(0.0), F.coalesce(c, F.lit("")))


def truthy(v: Val) -> Column:
    """null, false, 0 and "" are false; NaN is true."""
    return F.when(v.r <= FALSE, False).when(v.r == NUMBER, v.n != 0).when(v.r == STRING, v.s != "").otherwise(True)


def number(v: Val) -> Column:
    t = F.regexp_replace(v.s, r"(?U)^\s+|\s+$", "")
    text = F.when(t == "", 0.0).otherwise(F.coalesce(t.try_cast("double"), F.lit(NAN)))
    return F.when(v.r == NUMBER, v.n).when(v.r == STRING, text).when(v.r == TRUE, 1.0).when(v.r <= FALSE, 0.0).otherwise(NAN)


def string(v: Val) -> Column:
    whole = (v.n == F.floor(v.n).cast("double")) & (F.abs(v.n) < 1e15)
    num = F.when(whole, v.n.try_cast("bigint").cast("string")).otherwise(v.n.cast("string"))
    return F.when(v.r == STRING, v.s).when(v.r == NUMBER, num).when(v.r == TRUE, "true").when(v.r == FALSE, "false").when(v.r == NULL, "null").otherwise("[object]")


def same(a: Val, b: Val) -> Column:
    """``===``: one kind and equal; containers never, NaN never."""
    return (a.r == b.r) & (a.r < CONTAINER) & F.when(a.r == NUMBER, (a.n == b.n) & ~F.isnan(a.n)).when(a.r == STRING, a.s == b.s).otherwise(True)


def alike(a: Val, b: Val) -> Column:
    """``==``: numbers and strings and booleans by number; null only equals null."""
    x, y = number(a), number(b)
    mixed = (x == y) & ~F.isnan(x)
    return F.when((a.r == NULL) | (b.r == NULL), a.r == b.r).when((a.r == CONTAINER) | (b.r == CONTAINER), False).when(a.r == b.r, same(a, b)).otherwise(mixed)


def compared(op: str, a: Val, b: Val) -> Column:
    f = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    x, y = number(a), number(b)
    return F.when((a.r == STRING) & (b.r == STRING), f(a.s, b.s)).otherwise(f(x, y) & ~F.isnan(x) & ~F.isnan(y))


def arithmetic(op: str, a: Val, b: Val) -> Val:
    x, y = number(a), number(b)
    if op == "+":
        text = (a.r == STRING) | (b.r == STRING)
        return Val(F.when(text, STRING).otherwise(NUMBER), F.when(text, 0.0).otherwise(x + y), F.when(text, F.concat(string(a), string(b))).otherwise(""))
    if op == "/":
        return of_number(F.when(y == 0, 0.0).otherwise(F.try_divide(x, y)))
    if op == "%":
        whole = lambda c: F.coalesce(F.when(F.isnan(c), 0.0).otherwise(c).try_cast("bigint"), F.lit(0))
        return of_number(F.coalesce(F.try_mod(whole(x), whole(y)), F.lit(0)).cast("double"))
    return of_number(x - y if op == "-" else x * y)


def utf16_length(s: Column) -> Column:
    return F.octet_length(F.encode(s, "UTF-16BE")) / 2


def string_method(v: Val, name: str, args: list[Val]) -> Val:
    a = args[0].s if args else F.lit("")
    tests = {"contains": F.contains, "beginsWith": F.startswith, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}
    if name in tests:
        out = of_bool(tests[name](v.s, a))
    elif name == "replace":
        between = F.regexp_replace(v.s, F.lit("(?s)(?<=.)(?=.)|^|$"), args[1].s if len(args) > 1 else F.lit(""))
        out = of_string(v.s if len(args) < 2 else F.when(a == "", between).otherwise(F.replace(v.s, a, args[1].s)))
    elif name in ("toLowerCase", "toUpperCase", "trim"):
        out = of_string({"toLowerCase": F.lower(v.s), "toUpperCase": F.upper(v.s), "trim": F.regexp_replace(v.s, r"(?U)^\s+|\s+$", "")}[name])
    else:
        return null()
    is_text = v.r == STRING
    return Val(F.when(is_text, out.r).otherwise(NULL), F.when(is_text, out.n).otherwise(0.0), F.when(is_text, out.s).otherwise(""))


@dataclass
class Compiler:
    """Compiles one request table's expressions. ``names`` gives the variables."""

    names: dict[str, Val]
    lookups: list[tuple[str, Column]] = field(default_factory=list)
    _known: dict[tuple[str, str], int] = field(default_factory=dict)

    def node(self, source: str, path: Column) -> Val:
        key = (source, str(path))
        if key not in self._known:
            self._known[key] = len(self.lookups)
            self.lookups.append((source, path))
        return of_struct(F.col(f"__n{self._known[key]}"))

    def boolean(self, tree) -> Column:
        """Whether an expression holds; errors and null do not."""
        return F.coalesce(truthy(self.value(tree)), F.lit(False))

    def value(self, t) -> Val:
        kind = t[0]
        if kind == "lit":
            return literal(t[1])
        if kind == "id":
            return self.names.get(t[1], null())
        if kind == "arr":
            return Val(F.lit(CONTAINER), F.lit(0.0), F.lit(""), items=[self.value(x) for x in t[1]])
        if kind == "un":
            v = self.value(t[2])
            return of_bool(~truthy(v)) if t[1] == "!" else of_number(-number(v))
        if kind == "cond":
            c, a, b = truthy(self.value(t[1])), self.value(t[2]), self.value(t[3])
            return Val(F.when(c, a.r).otherwise(b.r), F.when(c, a.n).otherwise(b.n), F.when(c, a.s).otherwise(b.s))
        if kind == "bin":
            op, a, b = t[1], self.value(t[2]), self.value(t[3])
            if op in ("&&", "||"):
                return of_bool(truthy(a) & truthy(b) if op == "&&" else truthy(a) | truthy(b))
            if op in ("===", "!=="):
                return of_bool(same(a, b) if op == "===" else ~same(a, b))
            if op in ("==", "!="):
                return of_bool(alike(a, b) if op == "==" else ~alike(a, b))
            return of_bool(compared(op, a, b)) if op in ("<", ">", "<=", ">=") else arithmetic(op, a, b)
        if kind == "mem":
            v = self.value(t[1])
            if v.members:
                return v.members(t[2])
            if t[2] == "length":
                return literal(len(v.items)) if v.items is not None else of_number(F.when(v.r == STRING, utf16_length(v.s)))
            return null()
        if t[1][0] != "mem":  # a call of something that is no member
            return null()
        args = [self.value(x) for x in t[2]]
        v, name = self.value(t[1][1]), t[1][2]
        if v.snap:
            return self.snapshot_method(v.snap, name, args)
        if v.items is not None:
            hit = F.lit(False)
            for x in v.items:
                hit = hit | (same(x, args[0]) if args else F.lit(False))
            return of_bool(hit) if name == "includes" else null()
        if v.members and name == "hasOwnProperty" and args:
            found = F.lit(False)
            for k in ("uid", "provider", "token"):
                found = found | ((args[0].s == k) & (v.members(k).r != NULL))
            return of_bool(found)
        return string_method(v, name, args)

    def snapshot_method(self, snap, name, args) -> Val:
        source, path = snap
        child = lambda k: model.joined(path, k)
        if name == "val":
            return self.node(source, path)
        if name == "exists":
            return of_bool(self.node(source, path).r != NULL)
        if name == "child" and args:
            return Val(F.lit(CONTAINER), F.lit(0.0), F.lit(""), snap=(source, child(args[0].s)))
        if name == "parent":
            return Val(F.lit(CONTAINER), F.lit(0.0), F.lit(""), snap=(source, F.coalesce(model.parent(path), F.lit(""))))
        if name == "hasChild" and args:
            return of_bool(self.node(source, child(args[0].s)).r != NULL)
        if name == "hasChildren":
            if not args:
                return of_bool(self.node(source, path).r == CONTAINER)
            ok = F.lit(bool(args[0].items))
            for k in args[0].items or []:
                ok = ok & (self.node(source, child(k.s)).r != NULL)
            return of_bool(ok)
        if name == "getPriority":
            return self.node(source, child(F.lit(".priority")))
        if name in ("isString", "isNumber", "isBoolean"):
            r = self.node(source, path).r
            return of_bool({"isString": r == STRING, "isNumber": r == NUMBER, "isBoolean": r.isin(FALSE, TRUE)}[name])
        return null()
