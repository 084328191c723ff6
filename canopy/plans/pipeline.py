"""The general data-processing problems over the tables of a sf directory (p1 to p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import changefeed, nested, orphans, rolling, spikes
from canopy.session import epoch_seconds, run_dir, table, written


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Live leaves of every database, with the position of the entry that wrote them."""
    leaves = changefeed.current_leaves(spark, f"{sf}/wal_entries.parquet")
    return leaves.select("project_id", "database_id", "path", "sequence", "line_no")


def p1_leaves_per_database(spark: SparkSession, sf: str) -> DataFrame:
    """The state folded in one batch: leaves and distinct top-level keys of each database."""
    leaves = changefeed.state_at(table(spark, sf, "wal_entries"))
    top = F.split("path", "/")[1]
    return leaves.groupBy("project_id", "database_id").agg(F.count("*").alias("leaves"), F.countDistinct(top).alias("top_keys"), F.max("sequence").alias("last_sequence"))


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    """All objects, routed to their subtypes."""
    wal = nested.flatten_objects(table(spark, sf, "wal_entries"), "wal_entries", "entry_id", "value")
    auth = nested.flatten_objects(table(spark, sf, "auth_payloads"), "auth_payloads", "payload_id", "claims")
    return nested.route(wal.unionByName(auth), run_dir(spark, "objects"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that are elements of arrays, linked to the object around them, out of the routed subtype tables."""
    return nested.array_children(_objects(spark, sf))


def p2_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue of structural variants."""
    v = nested.variants(_objects(spark, sf))
    return v.select("table_name", "position", "variant", F.to_json("fields").alias("fields"), "objects")


def p2_subtypes(spark: SparkSession, sf: str) -> DataFrame:
    """The catalogue by what keys are, fields or data, as the objects that hold them say."""
    v = nested.subtypes(_objects(spark, sf))
    return v.select("table_name", "position", "subtype", F.to_json("fields").alias("fields"), "objects")


def p2_parents(spark: SparkSession, sf: str) -> DataFrame:
    """Round trip of the links: objects of each position by the position of the parent they join to; orphans would show."""
    j = nested.with_parents(_objects(spark, sf))
    lost = F.sum((F.col("parent_path").isNotNull() & F.col("parent_position").isNull() & (F.col("position").substr(1, 2) != "$[")).cast("int"))
    return j.groupBy("table_name", "position", "parent_position").agg(F.count("*").alias("objects"), lost.alias("orphans"))


def p2_supertypes(spark: SparkSession, sf: str) -> DataFrame:
    """Keys shared by all variants of a position."""
    s = nested.supertypes(_objects(spark, sf))
    return s.select("table_name", "position", "variants", "objects", F.to_json("common_keys").alias("common_keys"))


AMOUNTS = ["writes", "bytes_in"]


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "database_metrics").select("id", "ts", "project_id", "database_id", *AMOUNTS)
    rows = rolling.newest_rows(m, ["project_id", "database_id", "ts"], "id", AMOUNTS)
    return rolling.trailing_totals(rolling.daily(rows, "project_id", "ts", AMOUNTS), AMOUNTS)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Project days whose 7-day average is more than twice the 30-day average."""
    cases = rolling.surges(_totals(spark, sf), AMOUNTS)
    return cases.select("metric", F.col("entity").alias("project_id"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p3_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Trailing totals and averages of every project and day."""
    t = _totals(spark, sf)
    cols = [c for a in AMOUNTS for w in (7, 30) for c in (F.col(f"{a}_{w}").cast("bigint").alias(f"{a}_{w}"), F.round(F.col(f"{a}_{w}").cast("double") / w, 3).alias(f"{a}_{w}_avg"))]
    return t.select(F.col("entity").alias("project_id"), F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("day"), *cols)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references of sessions and project_databases."""
    account_lives = orphans.lives(table(spark, sf, "accounts"), "id", F.col("created_at"), F.col("deleted_at"))
    project_lives = orphans.lives(table(spark, sf, "projects"), "id", F.col("created_at"), F.col("deleted_at"), ["config_version", "updated_at"])
    beats = table(spark, sf, "servers").select(orphans.clean_key(F.col("id")).alias("key"), "last_heartbeat", "status").filter("key is not null and last_heartbeat is not null")
    server_lives = beats.groupBy("key").agg(F.min("last_heartbeat").alias("start"), F.min(F.when(F.col("status") == "removed", F.col("last_heartbeat"))).alias("end"))

    sessions = table(spark, sf, "sessions").select("id", "account_id", "created_at").distinct()
    dbs = table(spark, sf, "project_databases").select("project_id", "id", "server_id", "last_activity", "created_at").distinct()
    db_key = F.concat_ws("/", "project_id", "id")
    parts = [
        orphans.report(orphans.orphans(sessions, ["account_id"], account_lives, ["key"], at="created_at"), "sessions", "account_id", "created_at", F.col("id")),
        orphans.report(orphans.orphans(dbs, ["project_id"], project_lives, ["key"], at="created_at"), "project_databases", "project_id", "created_at", db_key),
        orphans.report(orphans.orphans(dbs, ["server_id"], server_lives, ["key"], at="last_activity"), "project_databases", "server_id", "last_activity", db_key),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per table, field and month."""
    return p4_found(spark, sf).groupBy("table_name", "field_name", "period").agg(F.count("*").alias("orphans"))


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per source and time, the newest of those sent again, with what the row allows."""
    entry = lambda name, ok: F.struct(F.lit(name).alias("metric"), F.col(name).cast("long").alias("value"), ok.alias("possible"))
    m = table(spark, sf, "database_metrics").select("project_id", "database_id", "ts", "id", "ccu", "peak_ccu", "writes", "data_size_bytes")
    m = rolling.newest_rows(m, ["project_id", "database_id", "ts"], "id", ["ccu", "peak_ccu", "writes", "data_size_bytes"])
    ccu = entry("ccu", spikes.possible(F.col("ccu"), F.col("peak_ccu"), 2**31 - 1))
    size = entry("data_size_bytes", spikes.possible(F.col("data_size_bytes"), F.lit(2**40), 2**63 - 1))
    databases = m.select(F.concat_ws("/", "project_id", "database_id").alias("source"), epoch_seconds(F.col("ts")).alias("t"), (F.col("writes") > 0).alias("active"), (F.col("writes") == 0).alias("idle"), F.array(ccu, size).alias("metrics"))
    s = table(spark, sf, "servers").groupBy("id", "last_heartbeat").agg(F.max("connection_count").alias("connection_count"), F.max("capacity").alias("capacity"))
    connections = entry("connection_count", spikes.possible(F.col("connection_count"), F.col("capacity"), 2**31 - 1))
    servers = s.select(F.col("id").alias("source"), F.col("last_heartbeat").alias("t"), F.lit(True).alias("active"), F.lit(False).alias("idle"), F.array(connections).alias("metrics"))
    return databases.unionByName(servers)


def p5_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Implausible readings with their kind."""
    readings = written(_readings(spark, sf), "readings")
    return spikes.implausible(readings).select("metric", "source", F.col("t").alias("ts_s"), "reason")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Implausible readings of databases and servers, each once."""
    return p5_cases(spark, sf).select("metric", "source", "ts_s").distinct()


P3_TOTALS_SQL = """
WITH
n AS (SELECT m.project_id, CAST(m.ts AS DATE) AS d, CAST(SUM(COALESCE(m.writes, 0)) AS BIGINT) AS writes, CAST(SUM(COALESCE(m.bytes_in, 0)) AS BIGINT) AS bytes_in
  FROM database_metrics m JOIN (SELECT project_id, database_id, ts, MAX(id) AS id FROM database_metrics GROUP BY ALL) k ON m.id = k.id GROUP BY ALL),
c AS (SELECT project_id, CAST(UNNEST(generate_series(MIN(d), (SELECT MAX(d) FROM n), INTERVAL 1 DAY)) AS DATE) AS d FROM n GROUP BY project_id),
f AS (SELECT c.project_id, c.d, COALESCE(n.writes, 0) AS writes, COALESCE(n.bytes_in, 0) AS bytes_in FROM c LEFT JOIN n ON n.project_id = c.project_id AND n.d = c.d),
t AS (SELECT project_id, d, ROW_NUMBER() OVER p AS k,
  CAST(SUM(writes) OVER (p ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS writes_7, CAST(SUM(writes) OVER (p ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS writes_30,
  CAST(SUM(bytes_in) OVER (p ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes_in_7, CAST(SUM(bytes_in) OVER (p ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS BIGINT) AS bytes_in_30
  FROM f WINDOW p AS (PARTITION BY project_id ORDER BY d))
"""

P4_SQL = """
WITH a AS (SELECT LOWER(TRIM(id)) AS k, created_at AS s, MIN(deleted_at) AS e FROM accounts GROUP BY 1, 2),
p AS (SELECT LOWER(TRIM(id)) AS k, created_at AS s, CASE WHEN COUNT(*) FILTER (deleted_at IS NOT NULL) > 0 THEN MIN(deleted_at) END AS e FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY LOWER(TRIM(id)), created_at ORDER BY config_version DESC, updated_at DESC) AS rn FROM projects) WHERE rn = 1 GROUP BY 1, 2),
v AS (SELECT LOWER(TRIM(id)) AS k, MIN(last_heartbeat) AS s, MIN(CASE WHEN status = 'removed' THEN last_heartbeat END) AS e FROM servers GROUP BY 1),
x AS (
  SELECT DISTINCT 'sessions' AS table_name, 'account_id' AS field_name, strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m') AS period, id AS row_key FROM sessions r
  WHERE TRIM(account_id) <> '' AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = LOWER(TRIM(r.account_id)) AND r.created_at >= a.s AND (a.e IS NULL OR r.created_at < a.e))
  UNION ALL SELECT DISTINCT 'project_databases', 'project_id', strftime(to_timestamp(created_at) AT TIME ZONE 'UTC', '%Y-%m'), project_id || '/' || id FROM project_databases r
  WHERE TRIM(project_id) <> '' AND NOT EXISTS (SELECT 1 FROM p WHERE p.k = LOWER(TRIM(r.project_id)) AND r.created_at >= p.s AND (p.e IS NULL OR r.created_at < p.e))
  UNION ALL SELECT DISTINCT 'project_databases', 'server_id', strftime(to_timestamp(last_activity) AT TIME ZONE 'UTC', '%Y-%m'), project_id || '/' || id FROM project_databases r
  WHERE TRIM(server_id) <> '' AND NOT EXISTS (SELECT 1 FROM v WHERE v.k = LOWER(TRIM(r.server_id)) AND r.last_activity >= v.s AND (v.e IS NULL OR r.last_activity < v.e)))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_leaves_per_database, p2_found, p2_variants, p2_subtypes, p2_parents, p2_supertypes, p3_found, p3_totals, p4_found, p4_report, p5_found, p5_cases]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    averages = ", ".join(f"{a}_{w}, ROUND(CAST({a}_{w} AS DOUBLE) / {w}, 3) AS {a}_{w}_avg" for a in AMOUNTS for w in (7, 30))
    case = "SELECT '{a}' AS metric, project_id, strftime(d, '%Y-%m-%d') AS day FROM t WHERE k >= 30 AND CAST({a}_7 AS DOUBLE) / 7 > 2 * CAST({a}_30 AS DOUBLE) / 30"
    return {
        "p3_found": P3_TOTALS_SQL + " UNION ALL ".join(case.format(a=a) for a in AMOUNTS),
        "p3_totals": P3_TOTALS_SQL + f"SELECT project_id, strftime(d, '%Y-%m-%d') AS day, {averages} FROM t",
        "p4_found": P4_SQL + "SELECT * FROM x",
        "p4_report": P4_SQL + "SELECT table_name, field_name, period, COUNT(*) AS orphans FROM x GROUP BY ALL",
    }
