"""References to records that do not exist (yet, or any more), per table and period.

A reference is a tuple of columns, a target a tuple of columns with the interval in
which the record exists. References are grouped by the mask of their null columns
and each group is anti-joined on the columns it has:

* ``simple`` - a reference with any null column is no orphan (SQL's default);
* ``partial`` - the columns present must match some target;
* ``full`` - all null is no orphan, a mix of null and not null always is one.

Keys are compared without outer spaces and in lower case; empty keys are null.
References without a time are matched by key alone. A hot key is met salted: the
reference side is spread over ``salts`` parts, the (far smaller) target side repeated.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_key(c: Column) -> Column:
    """A key as compared: outer spaces off, lower case, empty as null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def lives(df: DataFrame, key: str, start: Column, end: Column, version: list[str] | None = None) -> DataFrame:
    """(key, start, end) of each life of a record; end is null while it lasts.

    Rows of one life (same key and start) count once: the newest by ``version``, else
    the one with an end.
    """
    rows = df.select(clean_key(F.col(key)).alias("key"), start.alias("start"), end.alias("end"), *(version or [])).filter(F.col("key").isNotNull() & F.col("start").isNotNull())
    pick = F.max_by(F.col("end"), F.struct(*version)) if version else F.min("end")
    return rows.groupBy("key", "start").agg(pick.alias("end"))


def orphans(refs: DataFrame, keys: list[str], targets: DataFrame, target_keys: list[str], match: str = "simple", at: str | None = None, salts: int = 8) -> DataFrame:
    """The rows of ``refs`` whose tuple ``keys`` has no target that exists at column ``at``.

    ``targets`` has ``target_keys`` (already clean), ``start`` and ``end`` (null: open).
    Columns of ``refs`` come back as they are, whatever their names.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(match)
    names = [f"__k{i}" for i in range(len(keys))]
    spread = refs.select(F.struct("*").alias("__row"), *[clean_key(F.col(k)).alias(n) for k, n in zip(keys, names, strict=True)], (F.col(at) if at else F.lit(None)).cast("long").alias("__at"))
    spread = spread.withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(salts)).cast("int"))
    side = targets.select(*[F.col(t).alias(n) for t, n in zip(target_keys, names, strict=True)], F.col("start").alias("__start"), F.col("end").alias("__end"))
    side = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = None
    for mask in product((True, False), repeat=len(keys)):  # True: the column is there
        here = F.lit(True)
        for n, there in zip(names, mask, strict=True):
            here = here & (F.col(n).isNotNull() if there else F.col(n).isNull())
        if not any(mask) or (match == "simple" and not all(mask)):
            continue
        group = spread.filter(here)
        if match == "full" and not all(mask):
            part = group
        else:
            on = [n for n, there in zip(names, mask, strict=True) if there]
            l, r = group.alias("l"), side.select(*on, "__start", "__end", "__salt").distinct().alias("r")
            alive = F.col("l.__at").isNull() | ((F.col("l.__at") >= F.col("r.__start")) & (F.col("r.__end").isNull() | (F.col("l.__at") < F.col("r.__end"))))
            cond = (F.col("l.__salt") == F.col("r.__salt")) & alive
            for n in on:
                cond = cond & (F.col(f"l.{n}") == F.col(f"r.{n}"))
            part = l.join(r, cond, "left_anti")
        part = part.select("__row")
        found = part if found is None else found.unionByName(part)
    return found.select("__row.*")


def report(cases: DataFrame, table_name: str, field_name: str, at: str, row_key: Column) -> DataFrame:
    """(table_name, field_name, period, row_key), once per row however often it came."""
    period = F.date_format(F.date_from_unix_date(F.floor(F.col(at) / 86_400).cast("int")), "yyyy-MM")
    return cases.select(F.lit(table_name).alias("table_name"), F.lit(field_name).alias("field_name"), period.alias("period"), row_key.alias("row_key")).distinct()
