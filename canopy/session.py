"""Session helpers: local session for tests and bench, shared folder, table access."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RUNS: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, one machine) a folder of our own is
    made and set, so that a cluster never writes to a machine-local place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.environ.get("CANOPY_LOCAL_DIR") or tempfile.mkdtemp(prefix="canopy-")
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of :func:`shared_dir` for one run of one operator, removed when Python ends."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not _RUNS:
        atexit.unregister(_remove_runs)
        atexit.register(_remove_runs)
    _RUNS.append((spark, at))
    return at


def _remove_runs() -> None:
    """Results are read lazily, so their folders can only go at the very end."""
    for spark, at in _RUNS:
        try:
            remove(spark, at)
        except Exception:  # noqa: BLE001 - the session is gone: leave the folder
            return


def release_runs() -> None:
    """Remove the run folders made so far; for long sessions, once the results that read them are done with."""
    _remove_runs()
    _RUNS.clear()


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, at: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    fs, path = _fs(spark, at)
    fs.delete(path, True)


def folders(spark: SparkSession, at: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    fs, path = _fs(spark, at)
    return sorted(f.getPath().getName() for f in fs.listStatus(path) if f.isDirectory()) if fs.exists(path) else []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    at = run_dir(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def placed(df: DataFrame, by: list[Column | str], name: str, place: str = "place") -> DataFrame:
    """``df``, written, with each row's place (from 0) in the order ``by``, which must be total.

    Rows are range-partitioned and sorted; a place is the row's number in its partition
    and the count of the partitions before it, so no partition holds more than its share.
    """
    at = "__at"
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col(at), 33)
    counts = rows.groupBy(part.alias("__part")).count().orderBy("__part").collect()  # one row per partition
    before, starts = 0, []
    for r in counts:
        starts.append((r["__part"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "__part long, __before long")
    inner = F.col(at) - F.shiftleft(F.col("__part"), 33)
    return rows.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(place, F.col("__before") + inner).drop("__part", "__before", at)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds of a zoneless timestamp, whatever the session's time zone."""
    return F.expr("0L") + F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))
