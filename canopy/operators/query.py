"""Ordered, ranged and limited queries over the children of a node.

A collection is any DataFrame with a key column and either typed child columns or a
JSON value column. A query sorts by key, value, a child or priority, filters by a
range, then limits: in that order. The filter runs before the sort here, which gives
the same rows and lets Catalyst push it down; the limit becomes a top-k.

Nulls: a missing sort value is null and orders first, so ``end_at(5)`` holds it and
``start_at(5)`` doesn't. Ties are broken by key. Empty collections give no rows.
"""

from __future__ import annotations

import json as _json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy import model

LIMIT_MAX, READ_BYTES = 10_000, 256 << 20


@dataclass(frozen=True)
class Bound:
    value: object
    key: str | None = None
    inclusive: bool = True


@dataclass(frozen=True)
class TreeQuery:
    """An immutable query; its methods give changed copies. No order means priority order."""

    order: str = "priority"
    child: str | None = None
    lower: Bound | None = None
    upper: Bound | None = None
    equal: Bound | None = None
    first: int | None = None
    last: int | None = None
    explicit: bool = False

    # builders -------------------------------------------------------------------
    def order_by(self, name: str) -> TreeQuery:
        """key, value, priority (with or without ``$``), or the path of a child after ``child:``; else key."""
        if name.startswith("child:"):
            return self.order_by_child(name[6:])
        name = name.removeprefix("$")
        return replace(self, order=name if name in ("key", "value", "priority") else "key", child=None, explicit=True)

    def order_by_key(self) -> TreeQuery:
        return self.order_by("key")

    def order_by_value(self) -> TreeQuery:
        return self.order_by("value")

    def order_by_priority(self) -> TreeQuery:
        return self.order_by("priority")

    def order_by_child(self, path: str) -> TreeQuery:
        return replace(self, order="child", child=path.strip("/"), explicit=True)

    def start_at(self, value, key: str | None = None) -> TreeQuery:
        return replace(self, lower=Bound(value, key))

    def start_after(self, value, key: str | None = None) -> TreeQuery:
        """Ignored if ``start_at`` is set: that takes precedence."""
        return self if self.lower and self.lower.inclusive else replace(self, lower=Bound(value, key, False))

    def end_at(self, value, key: str | None = None) -> TreeQuery:
        return replace(self, upper=Bound(value, key))

    def end_before(self, value, key: str | None = None) -> TreeQuery:
        return self if self.upper and self.upper.inclusive else replace(self, upper=Bound(value, key, False))

    def equal_to(self, value, key: str | None = None) -> TreeQuery:
        """Overrides both bounds."""
        return replace(self, equal=Bound(value, key))

    def limit_to_first(self, n: int) -> TreeQuery:
        return replace(self, first=_limit(n))

    def limit_to_last(self, n: int) -> TreeQuery:
        return replace(self, last=_limit(n))

    # facts ----------------------------------------------------------------------
    def identifier(self) -> str:
        """The canonical text of the query: equal queries share a view."""
        parts: dict[str, object] = {}
        if self.explicit:
            parts["i"] = "." + self.child if self.order == "child" else f".{self.order}"
        for name, b in (("s", self.lower), ("e", self.upper)):
            if self.equal:
                b = self.equal
            if b:
                parts[f"{name}p"] = b.value
                parts[f"{name}in"] = b.inclusive
                if b.key is not None:
                    parts[f"{name}n"] = b.key
        if self.first is not None:
            parts |= {"l": self.first, "vf": "l"}
        elif self.last is not None:
            parts |= {"l": self.last, "vf": "r"}
        return _json.dumps(parts, sort_keys=True, separators=(",", ":")) if parts else "default"

    def rules_fields(self) -> dict[str, object]:
        """What a rule sees as ``query``."""
        out: dict[str, object] = {f"orderBy{k.title()}": self.explicit and self.order == k for k in ("key", "value", "priority")}
        out["orderByChild"] = self.child
        out |= {"limitToFirst": self.first, "limitToLast": None if self.first is not None else self.last}
        out |= {"startAt": self.lower.value if self.lower else None, "endAt": self.upper.value if self.upper else None, "equalTo": self.equal.value if self.equal else None}
        return out

    # evaluation -----------------------------------------------------------------
    def _key_bound(self, b: Bound, equal: bool = False) -> str | None:
        """Under key order a bound is a string, or null with a key; others don't count (but equal to "")."""
        if isinstance(b.value, str):
            return b.value
        if b.value is None and b.key is not None:
            return b.key
        return "" if equal else None

    def condition(self, sort: Column, key: Column) -> Column:
        """The range as one condition on a sort-key struct and the key."""
        order = model.key_struct(key)
        ok = F.lit(True)
        if self.order == "key":
            if self.equal:
                return key == F.lit(self._key_bound(self.equal, True))
            for b, low in ((self.lower, True), (self.upper, False)):
                text = self._key_bound(b) if b else None
                if text is None:
                    continue
                at = model.key_struct(F.lit(text))
                ok = ok & ((order >= at if b.inclusive else order > at) if low else (order <= at if b.inclusive else order < at))
            return ok
        if self.equal:
            ok = sort == model.literal_sort_key(self.equal.value)
            return ok if self.equal.key is None else ok & (key == F.lit(self.equal.key))
        for b, low in ((self.lower, True), (self.upper, False)):
            if not b:
                continue
            at = model.literal_sort_key(b.value)
            beyond = sort > at if low else sort < at
            if b.key is None:
                ok = ok & (beyond | (sort == at) if b.inclusive else beyond)
            else:
                k = model.key_struct(F.lit(b.key))
                tie = (order >= k if b.inclusive else order > k) if low else (order <= k if b.inclusive else order < k)
                ok = ok & (beyond | ((sort == at) & tie))
        return ok

    def sort_column(self, df: DataFrame, key: str, value: str | None) -> Column:
        """The sort-key struct of each child: from a typed column of that name, else from the JSON value."""
        kinds = dict(df.dtypes)

        def typed(c: str) -> Column:
            k = kinds[c]
            if k in ("boolean", "string"):
                return model.scalar_sort_key(F.col(f"`{c}`"), k)
            if k.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
                return model.scalar_sort_key(F.col(f"`{c}`"), "number")
            return F.struct(F.when(F.col(f"`{c}`").isNull(), model.NULL).otherwise(model.CONTAINER).alias("rank"), F.lit(0.0).alias("num"), F.lit("").alias("str"))

        if self.order == "key":
            return F.lit(None)
        if self.order == "value":
            return model.sort_key(F.col(value)) if value and kinds[value] == "string" else typed(value)
        child = ".priority" if self.order == "priority" else self.child
        if child in kinds:
            return typed(child)
        return model.sort_key(model.child_json(F.col(value), child)) if value else model.literal_sort_key(None)

    def apply(self, children: DataFrame, key: str = "key", value: str | None = None) -> DataFrame:
        """The surviving children in ascending order, with the columns of ``children``."""
        k = F.col(key).cast("string")
        df = children.select("*", self.sort_column(children, key, value).alias("__s"), model.key_struct(k).alias("__k"))
        df = df.filter(self.condition(F.col("__s"), k))
        by = [F.col("__k")] if self.order == "key" else [F.col("__s"), F.col("__k")]
        n = self.first if self.first is not None else self.last
        if n is None or n < 0:  # a negative limit is none
            df = df.orderBy(*by)
        elif self.first is not None:
            df = df.orderBy(*by).limit(n)
        else:
            df = df.orderBy(*[c.desc() for c in by]).limit(n).orderBy(*by)
        return df.drop("__s", "__k")


    def result(self, children: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
        """One row: the surviving children as one JSON value by the array rule, null if there are none.

        What one read returns is bounded: more than ``READ_BYTES`` raises before anything is gathered.
        """
        from canopy.operators.tree import render_json

        kept = self.apply(children, key, value).filter(F.col(value).isNotNull())
        pair = F.concat(F.expr(f"substring(to_json(array(cast(`{key}` as string))), 2, length(to_json(array(cast(`{key}` as string)))) - 2)"), F.lit(":"), F.col(value))
        whole = kept.agg(F.sum(F.octet_length(pair)).alias("__bytes"))  # one row
        small = F.when(F.col("__bytes") > READ_BYTES, F.raise_error(F.lit(f"a read of more than {READ_BYTES} bytes"))).otherwise(pair)
        pair = F.col("__pair")
        kept = kept.crossJoin(F.broadcast(whole)).select(small.alias("__pair"))
        body = kept.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(pair), ","), F.lit("}")).alias("json"))
        return body.select(render_json("json").alias("value"))


def _limit(n: int) -> int:
    if n > LIMIT_MAX:
        raise ValueError(f"limit above {LIMIT_MAX}")
    return n


def from_rest(params: dict[str, str]) -> TreeQuery:
    """A query from REST parameters (JSON-quoted names and values, as in a URL)."""
    load = lambda text: _json.loads(text)
    q = TreeQuery()
    if "orderBy" in params:
        name = load(params["orderBy"])
        q = q.order_by(name) if name.startswith("$") else q.order_by_child(name)
    for name, method in (("startAt", "start_at"), ("startAfter", "start_after"), ("endAt", "end_at"), ("endBefore", "end_before"), ("equalTo", "equal_to")):
        if name in params:
            q = getattr(q, method)(load(params[name]))
    for name, method in (("limitToFirst", "limit_to_first"), ("limitToLast", "limit_to_last")):
        if name in params:
            q = getattr(q, method)(int(params[name]))
    if params.get("shallow") == "true" and q != TreeQuery():
        raise ValueError("shallow can't be combined with a query")
    return q


def predecessors(children: DataFrame, by: list[str], q: TreeQuery, key: str = "key", value: str | None = None) -> DataFrame:
    """``children`` with ``previous``: the key before each in the query's order, in its collection ``by``; null for the first.

    A collection is one ordered window, which sorts and spills but is not collected.
    """
    k = F.col(key).cast("string")
    order = [model.key_struct(k)] if q.order == "key" else [q.sort_column(children, key, value), model.key_struct(k)]
    return children.withColumn("previous", F.lag(k).over(Window.partitionBy(*by).orderBy(*order)))


def views_diff(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """(key, change): entered, exited or stayed between two results of one query."""
    a = old.select(F.col(key).alias("key"), F.lit(1).alias("a"))
    b = new.select(F.col(key).alias("key"), F.lit(1).alias("b"))
    return a.join(b, "key", "full").select("key", F.when(F.col("a").isNull(), "entered").when(F.col("b").isNull(), "exited").otherwise("stayed").alias("change"))
