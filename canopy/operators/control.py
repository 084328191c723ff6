"""Control-plane tables: lookups, assignment, upserts, paging.

Inputs are DataFrames with the columns named; nulls in a compared column never match,
and empty inputs give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_DEFAULT, PAGE_MAX = 50, 200


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key (a heartbeat or version history as a current table)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("__r")).select("__r.*")


def healthy(servers: DataFrame, now_s: Column, timeout_s: int) -> DataFrame:
    """Active servers with a heartbeat inside the timeout."""
    return servers.filter((F.col("status") == "active") & (F.col("last_heartbeat") > now_s - timeout_s))


def unhealthy(servers: DataFrame, now_s: Column, timeout_s: int) -> DataFrame:
    return servers.filter((F.col("status") == "active") & (F.col("last_heartbeat") <= now_s - timeout_s))


def best_server(servers: DataFrame) -> DataFrame:
    """The one with the fewest databases (ties: lowest id)."""
    return servers.orderBy("database_count", "id").limit(1)


def connect_data(projects: DataFrame, databases: DataFrame, healthy_servers: DataFrame) -> DataFrame:
    """Every project, its databases if any, and their server if it is healthy."""
    d = databases.select("project_id", F.col("id").alias("database_id"), "server_id", F.col("status").alias("database_status"))
    s = healthy_servers.select(F.col("id").alias("server_id"), "hostname", "ip_address", "udp_port")
    p = projects.select(F.col("id").alias("project_id"), "name", "config_version")
    return p.join(d, "project_id", "left").join(s, "server_id", "left")


def numbered(servers: DataFrame) -> DataFrame:
    """id, idx (from 0, by id) and total, for a deterministic pick. One row per server of a fleet."""
    w = Window.orderBy("id")
    return servers.select("id", (F.row_number().over(w) - 1).alias("idx"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("total"))


def assign(databases: DataFrame, healthy_servers: DataFrame, hash_column: Column) -> DataFrame:
    """Each database with a server: the one it has if that is healthy, else the hash-th of the healthy ones."""
    n = numbered(healthy_servers)
    total = n.agg(F.count("*").alias("total"))
    kept = databases.join(healthy_servers.select(F.col("id").alias("server_id")).withColumn("ok", F.lit(True)), "server_id", "left")
    keyed = kept.crossJoin(F.broadcast(total)).withColumn("idx", F.when(F.col("total") > 0, F.pmod(hash_column, F.greatest("total", F.lit(1)))))  # one row
    picked = keyed.join(n.select("idx", F.col("id").alias("picked")), "idx", "left")
    return picked.select(*[c for c in databases.columns if c != "server_id"], F.when(F.col("ok"), F.col("server_id")).otherwise(F.col("picked")).alias("server_id"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """``table`` with ``changes`` merged in by key; columns ``keep_if_null`` keep the old value on null."""
    rest = [c for c in table.columns if c not in keys]
    a = table.select(*keys, F.struct(*rest).alias("__a"))
    b = changes.select(*keys, F.struct(*rest).alias("__b"))
    j = a.join(b, keys, "full")
    pick = lambda c: F.when(F.col("__b").isNull(), F.col("__a").getField(c)).otherwise(F.coalesce(F.col("__b").getField(c), F.col("__a").getField(c)) if c in keep_if_null else F.col("__b").getField(c))
    return j.select(*keys, *[pick(c).alias(c) for c in rest]).select(*table.columns)


def evict(databases: DataFrame, evictions: DataFrame) -> DataFrame:
    """Databases after eviction: ephemeral ones gone, others without server and inactive."""
    e = evictions.select("project_id", "id").distinct().withColumn("__e", F.lit(True))
    j = databases.join(e, ["project_id", "id"], "left")
    j = j.filter(F.col("__e").isNull() | (F.col("ephemeral") == 0))
    out = {"server_id": F.when(F.col("__e").isNull(), F.col("server_id")), "status": F.when(F.col("__e").isNull(), F.col("status")).otherwise("inactive")}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in databases.columns])


def sweep(databases: DataFrame, servers: DataFrame, now_s: Column, timeout_s: int) -> DataFrame:
    """Databases without the servers whose heartbeat is older than the timeout: no server, inactive."""
    gone = unhealthy(servers, now_s, timeout_s).select(F.col("id").alias("server_id")).distinct().withColumn("__gone", F.lit(True))
    j = databases.join(gone, "server_id", "left")
    out = {"server_id": F.when(F.col("__gone").isNull(), F.col("server_id")), "status": F.when(F.col("__gone").isNull(), F.col("status")).otherwise("inactive")}
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in databases.columns])


def release(servers: DataFrame, released: DataFrame) -> DataFrame:
    """Database counts less what was released, never below 0."""
    r = released.groupBy("id").agg(F.count("*").alias("__n"))
    return servers.join(r, "id", "left").withColumn("database_count", F.greatest(F.lit(0), F.col("database_count") - F.coalesce("__n", F.lit(0)))).drop("__n").select(*servers.columns)


def page(df: DataFrame, *order, limit: int = PAGE_DEFAULT, offset: int = 0) -> DataFrame:
    """One page in the given order; limits outside 1..200 fall back to the default or the cap."""
    n = PAGE_DEFAULT if limit <= 0 else min(limit, PAGE_MAX)
    return df.orderBy(*order).offset(max(0, offset)).limit(n)
