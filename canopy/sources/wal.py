"""Log files (JSON lines ``{"o","p","v"}``, one file per sequence), snapshots, sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators import changefeed


class LogError(ValueError):
    """The log has a gap or a broken line that is not its very end."""


def read_log(spark: SparkSession, folder: str, after: int | None = None, upto: int | None = None) -> DataFrame:
    """sequence, line_no, op, path, value of the log files with sequence in (after, upto].

    A log file is ``NNNNNN.wal``, or the one file in ``sequence=N`` that :func:`append_log`
    writes. Lines are numbered by file offset order: each file is one unsplit text (they rotate
    at 5 MiB). Broken lines come back with a null op; :func:`check` says whether that is fatal.
    """
    found = spark.read.option("pathGlobFilter", "*.{wal,txt}").option("recursiveFileLookup", True).text(folder, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)\.wal$", 1)
    other = F.regexp_extract(F.col("_metadata.file_path"), r"/sequence=(\d+)/[^/]*\.txt$", 1)
    files = found.select(F.coalesce(F.nullif(number, F.lit("")), F.nullif(other, F.lit(""))).cast("bigint").alias("sequence"), "value").filter("sequence is not null")
    if after is not None:
        files = files.filter(F.col("sequence") > after)
    if upto is not None:
        files = files.filter(F.col("sequence") <= upto)
    lines = files.select("sequence", F.posexplode(F.split(F.regexp_replace("value", "\n+$", ""), "\n")).alias("at", "line")).filter(F.trim("line") != "")
    v = F.try_parse_json(F.col("line"))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    value = F.to_json(F.try_variant_get(v, "$.v", "variant"))
    return lines.select("sequence", (F.col("at") + 1).cast("int").alias("line_no"), get("o").alias("op"), get("p").alias("path"), value.alias("value"), "line")


def gaps(log: DataFrame, least: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, missing_from and missing_to between the distinct sequences of each log; also before the first if ``least`` is given.

    Anti-joins leave only the ends of unbroken runs, so the ordered step sees a row or
    two per gap, however many files there are.
    """
    on = [*keys, "sequence"]
    s = log.select(*on).distinct()
    shifted = lambda by: s.select(*keys, (F.col("sequence") + by).alias("sequence"))
    starts = s.join(shifted(1), on, "left_anti").withColumn("end", F.lit(False))
    ends = s.join(shifted(-1), on, "left_anti").withColumn("end", F.lit(True))
    edges = starts.unionByName(ends)
    g = edges.select(*on, "end", F.lag("sequence").over(Window.partitionBy(*keys).orderBy("sequence", "end")).alias("prev")).filter(~F.col("end"))
    first = F.lit(least - 1).cast("bigint") if least is not None else F.lit(None).cast("bigint")
    g = g.withColumn("prev", F.coalesce("prev", first))
    return g.filter(F.col("sequence") > F.col("prev") + 1).select(*keys, (F.col("prev") + 1).alias("missing_from"), (F.col("sequence") - 1).alias("missing_to"))


def check(log: DataFrame, least: int | None = None) -> DataFrame:
    """The log without a torn last line; raises :class:`LogError` for gaps and other broken lines."""
    hole = gaps(log, least).limit(1).collect()
    if hole:
        raise LogError(f"missing log files {hole[0].missing_from} to {hole[0].missing_to}")
    broken = F.col("op").isNull() | ~F.col("op").isin("s", "u", "d") | F.col("path").isNull()
    at = F.struct("sequence", "line_no")
    ends = log.agg(F.max(at).alias("last"), F.min(F.when(broken, at)).alias("first_bad")).collect()[0]
    if ends.first_bad is not None and ends.first_bad != ends["last"]:
        raise LogError(f"broken line {ends.first_bad.line_no} of log file {ends.first_bad.sequence}")
    return log.filter(~broken)


def append_log(entries: DataFrame, folder: str) -> None:
    """Write entries (sequence, line_no, op, path, value) as log files, one per sequence, as :func:`read_log` reads them.

    A sequence is written whole: its entries come in one call, in the order of line_no.
    """
    line = F.concat(F.lit('{"o":"'), "op", F.lit('","p":'), F.to_json(F.array("path")).substr(F.lit(2), F.length(F.to_json(F.array("path"))) - 2), F.when(F.col("op") == "d", "").otherwise(F.concat(F.lit(',"v":'), F.coalesce("value", F.lit("null")))), F.lit("}"))
    entries.select("sequence", "line_no", line.alias("line")).repartition("sequence").sortWithinPartitions("sequence", "line_no").select("sequence", "line").write.mode("append").partitionBy("sequence").text(folder)


def write_snapshot(leaves: DataFrame, folder: str, sequence: int) -> str:
    """A snapshot of live leaves up to ``sequence``, by database; gives its folder."""
    at = f"{folder}/sequence={sequence}"
    leaves.write.mode("overwrite").partitionBy("project_id").parquet(at)
    return at


def compact(spark: SparkSession, snapshot: DataFrame | None, feed: DataFrame) -> DataFrame:
    """The tree of a snapshot's leaves with newer log entries applied.

    A snapshot leaf is a SET at its own position, so one fold serves both.
    """
    entries = feed.select(*changefeed.FEED)
    if snapshot is not None:
        old = snapshot.select("project_id", "database_id", "sequence", F.col("line_no").cast("int").alias("line_no"), F.lit("s").alias("op"), "path", "value")
        changes = changefeed.expand(entries)
        # leaves of one entry share its position and lie side by side, never above one another
        changes = changes.unionByName(old.select("project_id", "database_id", F.regexp_replace("path", "^/+|/+$", "").alias("path"), "sequence", "line_no", F.lit(0).alias("idx"), F.col("value").alias("payload")))
    else:
        changes = changefeed.expand(entries)
    from canopy.session import written

    return changefeed.resolve(written(changefeed.fold(changes), "compaction"))


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Metric samples of JSON files (arrays or lines)."""
    schema = "type string, ts bigint, server string, core int, project string, database string, writes bigint, reads bigint, bytes_in bigint, bytes_out bigint, events_sent bigint, ccu bigint, data_size_bytes bigint, latency_avg_us int, latency_max_us int"
    return spark.read.schema(schema).option("multiLine", True).json(folder)
