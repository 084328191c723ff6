"""Operational metrics: windows, roll-ups, percentiles, anomalies.

Nulls take no part in sums, maxima and averages; empty inputs give no rows (the global
summary gives its one row of zeros).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.session import epoch_seconds

COUNTERS = ["ccu", "peak_ccu", "bytes_in", "bytes_out", "writes", "reads", "volatile_writes", "volatile_bytes_in", "events_sent", "permission_denials", "connection_rejections"]
MAX_RANGE_S, DEFAULT_RANGE_S = 30 * 86_400, 86_400


def ingest(samples: DataFrame) -> DataFrame:
    """Samples of type db_metrics with a project."""
    return samples.filter((F.col("type") == "db_metrics") & (F.coalesce("project", F.lit("")) != ""))


def project_rollup(m: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per (ts, project_id): counters summed, latencies averaged over their non-zero values."""
    lat = lambda c: F.coalesce(F.avg(F.nullif(F.col(c), F.lit(0))), F.lit(0.0)).alias(c)
    return m.groupBy("ts", "project_id", *extra).agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in COUNTERS], lat("p50_latency_us"), lat("p99_latency_us"))


def summary(m: DataFrame, by: list[str]) -> DataFrame:
    """Peak, totals, and the integer mean of the non-zero p50 latencies."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)")
    lat = F.when(F.col("p50_latency_us") > 0, F.col("p50_latency_us"))
    mean = F.coalesce(F.floor(F.sum(lat) / F.count(lat)), F.lit(0)).cast("bigint")
    return m.groupBy(*by).agg(F.coalesce(F.max("peak_ccu"), F.lit(0)).alias("peak_ccu"), *[total(c).alias(f"total_{c}") for c in ("bytes_in", "bytes_out", "writes", "reads", "events_sent")], mean.alias("avg_latency_us"))


def window_start(ts: Column, seconds: int) -> Column:
    """Epoch-aligned start (seconds) of a tumbling window."""
    return (F.floor(epoch_seconds(ts) / seconds) * seconds).cast("bigint")


def accumulate(samples: DataFrame, keys: list[str], ts: str, seconds: int, sums: list[str], gauges: list[str], peaks: list[str], latency: str | None = None, order: str | None = None) -> DataFrame:
    """Tumbling windows per key: sums, last values of gauges, maxima; latency as integer mean and max.

    Windows without any activity (all sums 0) are left out, as a flush leaves them out.
    The last value is that of the highest ``order``, if named, else of the highest ``ts``.
    """
    aggs = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums] + [F.max_by(c, order or ts).alias(f"last_{c}") for c in gauges] + [F.max(c).alias(f"max_{c}") for c in peaks]
    if latency:
        aggs += [F.floor(F.sum(latency) / F.count(latency)).cast("bigint").alias("p50"), F.max(latency).alias("latency_max")]
    g = samples.groupBy(*keys, window_start(F.col(ts), seconds).alias("window_s")).agg(*aggs)
    active = F.lit(False)
    for c in sums:
        active = active | (F.col(c) > 0)
    return g.filter(active) if sums else g


def flush_rows(samples: DataFrame, keys: list[str], ts: str, seconds: int, sums: list[str], gauges: list[str], ccu: str, latency: str, order: str | None = None) -> DataFrame:
    """Rows of a periodic flush: sums, last gauges, the mean latency as p50 and 0 as p99; idle windows are left out.

    A window's peak starts from the last ``ccu`` of the key's window before, as a flush resets it to that.
    """
    quiet = accumulate(samples, keys, ts, seconds, [], [ccu], [ccu], order=order)
    carried = F.greatest(F.col(f"max_{ccu}"), F.lag(f"last_{ccu}").over(Window.partitionBy(*keys).orderBy("window_s")))
    peaks = quiet.select(*keys, "window_s", carried.alias(f"peak_{ccu}"))
    busy = accumulate(samples, keys, ts, seconds, sums, [*gauges, ccu], [], latency, order=order)
    return busy.drop("latency_max").join(peaks, [*keys, "window_s"]).withColumn("p99", F.lit(0).cast("bigint"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: tuple[int, ...] = (50, 90, 99), rounding: str = "floor") -> DataFrame:
    """Nearest-rank percentiles: the value at index floor((n-1)p/100) (or rounded), no interpolation.

    Values are first counted, then ranked by running counts; a key of any size keeps one
    row per distinct value, never a list of its values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("__upto", F.sum("__c").over(w)).join(counts.groupBy(*keys).agg(F.sum("__c").alias("__n")), keys)
    at = {p: (F.floor if rounding == "floor" else F.round)((F.col("__n") - 1) * p / F.lit(100)) for p in ps}
    return ranked.groupBy(*keys).agg(F.max("__n").alias("n"), *[F.min(F.when(F.col("__upto") > at[p], F.col(value))).alias(f"p{p}") for p in ps])


def high_latency(samples: DataFrame, project: str, database: str, ts: str, latency: str, events: str, window_s: int = 180) -> DataFrame:
    """Samples of at least 10 ms and 100 events whose latency is over three times the project's mean in the window."""
    win = samples.withColumn("window_s", window_start(F.col(ts), window_s))
    means = win.groupBy(project, "window_s").agg(F.floor(F.sum(latency) / F.count(latency)).cast("bigint").alias("project_avg"))
    j = win.join(means, [project, "window_s"])
    return j.filter((F.col(latency) >= 10_000) & (F.col(events) >= 100) & (F.col("project_avg") > 0) & (F.col(latency) > 3 * F.col("project_avg")))


def with_cooldown(events: DataFrame, keys: list[str], ts_s: str, seconds: int = 300) -> DataFrame:
    """Of each key's events those at least ``seconds`` after the last one kept.

    Which event is kept depends on the one before, so a key's distinct times are folded in
    order; rows stream by in Arrow batches, and only the last kept time is held.
    """
    import pyarrow as pa

    cols = events.columns

    def fold(batches):
        key, last = None, None
        for b in batches:
            rows = b.to_pydict()
            keep = []
            for k, t in zip(zip(*(rows[c] for c in keys), strict=True), rows[ts_s], strict=True):
                ok = k != key or t - last >= seconds
                if ok:
                    key, last = k, t
                keep.append(ok)
            yield b.filter(pa.array(keep, pa.bool_()))

    return events.filter(F.col(ts_s).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, ts_s).select(*cols).mapInArrow(fold, events.schema)


def stale(m: DataFrame, keys: list[str], ts: str, now_s: int, seconds: int = 180) -> DataFrame:
    """Keys without a sample for ``seconds``."""
    return m.groupBy(*keys).agg(F.max(epoch_seconds(F.col(ts))).alias("last_s")).filter(F.col("last_s") < now_s - seconds)


def time_range(start_s: int | None, end_s: int | None, now_s: int) -> tuple[int, int]:
    """The checked range of a dashboard query: 24 h by default, 30 days at most, end after start."""
    end = now_s if end_s is None else end_s
    start = end - DEFAULT_RANGE_S if start_s is None else start_s
    if end <= start:
        raise ValueError("a range ends after it begins")
    if end - start > MAX_RANGE_S:
        raise ValueError("range above 30 days")
    return start, end
