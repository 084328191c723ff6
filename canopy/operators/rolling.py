"""Rolling totals over trailing periods, days without activity included.

Each daily amount becomes two contributions per window: it adds at its day and
subtracts ``window`` days later. The running sum of the contributions along an
entity's calendar is the trailing total of every day, so one ordered pass serves any
number of windows and no row is joined to the days it counts for.

Before that pass, rows are reduced to one per entity and day, so the ordered groups
hold days, not rows; an entity with a third of all rows costs no more than another.

Nulls: amounts that are null count 0 (their row still opens the entity's calendar);
rows without entity or time are ignored. Totals are decimal(38,0) and never overflow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import epoch_seconds

DAY = 86_400


def newest_rows(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """Of the rows with the same keys, the values of the one with the highest version."""
    return df.groupBy(*keys).agg(*[F.max_by(v, version).alias(v) for v in values])


def daily(df: DataFrame, entity: str, ts: str, amounts: list[str]) -> DataFrame:
    """Per entity and day (days since 1970) the sums of the amounts."""
    day = F.floor(epoch_seconds(F.col(ts)) / DAY).cast("int")
    known = df.filter(F.col(entity).isNotNull() & F.col(ts).isNotNull())
    return known.groupBy(F.col(entity).alias("entity"), day.alias("day")).agg(
        *[F.coalesce(F.sum(F.col(a).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias(a) for a in amounts]
    )


def trailing_totals(days: DataFrame, amounts: list[str], windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """entity, day, day_no (1 for an entity's first), ``{amount}_{window}`` totals for every day.

    An entity's calendar runs from its first day to the last day of the whole table.
    """
    last = days.agg(F.max("day").alias("last"))
    deltas = None
    for shift in (0, *windows):
        sign = 1 if shift == 0 else -1
        part = days.select(
            "entity",
            (F.col("day") + shift).alias("day"),
            *[(F.col(a) * sign if shift in (0, w) else F.lit(0)).cast("decimal(38,0)").alias(f"{a}_{w}") for a in amounts for w in windows],
        )
        deltas = part if deltas is None else deltas.unionByName(part)
    names = [f"{a}_{w}" for a in amounts for w in windows]
    span = days.groupBy("entity").agg(F.min("day").alias("first")).crossJoin(F.broadcast(last))  # one row
    calendar = span.select("entity", F.explode(F.sequence("first", "last")).alias("day"), *[F.lit(0).cast("decimal(38,0)").alias(n) for n in names])
    net = deltas.unionByName(calendar).groupBy("entity", "day").agg(*[F.sum(n).cast("decimal(38,0)").alias(n) for n in names])
    w = Window.partitionBy("entity").orderBy("day")
    running = net.select(
        "entity", "day", F.row_number().over(w).alias("day_no"), *[F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(38,0)").alias(n) for n in names]
    )
    return running.crossJoin(F.broadcast(last)).filter(F.col("day") <= F.col("last")).drop("last")


def surges(totals: DataFrame, amounts: list[str], short: int = 7, long: int = 30, factor: int = 2) -> DataFrame:
    """(metric, entity, day) where the short average is more than ``factor`` times the long one.

    Compared in whole numbers; an entity's first ``long - 1`` days are never cases.
    """
    full = totals.filter(F.col("day_no") >= long)
    metric = F.explode(F.array(*[F.struct(F.lit(a).alias("metric"), F.col(f"{a}_{short}").alias("s"), F.col(f"{a}_{long}").alias("l")) for a in amounts])).alias("m")
    return full.select("entity", "day", metric).filter(F.col("m.s") * long > F.col("m.l") * (factor * short)).select("m.metric", "entity", F.date_from_unix_date("day").alias("day"))
