"""Queries of the tree engine's own operators over the tables of a sf directory, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy import model
from canopy.functions import ids
from canopy.operators import control, metrics, mutations, rolling, tree
from canopy.operators.query import TreeQuery, views_diff
from canopy.rules.compiler import utf16_length
from canopy.rules.engine import Rules, can_read, can_write
from canopy.session import epoch_seconds, placed, run_dir, table
from canopy.sources import rest
from canopy.streaming import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ordered, ranged and limited children ------------------------------------------------

def _children(name: str, src: str, key: str, q: TreeQuery, cols: list[str], sql: str) -> None:
    """A table as a collection: key column, child columns; the query's result rows."""

    def run(spark, sf):
        df = table(spark, sf, src).select(F.col(key).cast("string").alias("key"), *cols)
        return q.apply(df)

    run.__name__ = name
    query(sql)(run)


_Q = TreeQuery()
_P = "SELECT CAST(p_partkey AS VARCHAR) AS key, p_size FROM part "
_children("order_by_child_limit_first", "customer", "c_custkey", _Q.order_by_child("c_acctbal").limit_to_first(10), ["c_acctbal"], "SELECT CAST(c_custkey AS VARCHAR) AS key, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
_children("order_by_child_limit_last", "orders", "o_orderkey", _Q.order_by_child("o_totalprice").limit_to_last(10), ["o_totalprice"], "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")
_children("start_at_value", "part", "p_partkey", _Q.order_by_child("p_size").start_at(40), ["p_size"], _P + "WHERE p_size >= 40")
_children("start_at_with_key", "part", "p_partkey", _Q.order_by_child("p_size").start_at(25, "500"), ["p_size"], _P + "WHERE p_size > 25 OR (p_size = 25 AND p_partkey >= 500)")
_children("start_after_with_key", "part", "p_partkey", _Q.order_by_child("p_size").start_after(25, "500"), ["p_size"], _P + "WHERE p_size > 25 OR (p_size = 25 AND p_partkey > 500)")
_children("start_after_value", "part", "p_partkey", _Q.order_by_child("p_size").start_after(25), ["p_size"], _P + "WHERE p_size > 25")
_children("end_at_with_key", "part", "p_partkey", _Q.order_by_child("p_size").end_at(25, "500"), ["p_size"], _P + "WHERE p_size < 25 OR p_size IS NULL OR (p_size = 25 AND p_partkey <= 500)")
_children("end_before_with_key", "part", "p_partkey", _Q.order_by_child("p_size").end_before(25, "500"), ["p_size"], _P + "WHERE p_size < 25 OR p_size IS NULL OR (p_size = 25 AND p_partkey < 500)")
_children("range_then_limit", "part", "p_partkey", _Q.order_by_child("p_size").start_at(20).end_at(30).limit_to_first(25), ["p_size"], _P + "WHERE p_size BETWEEN 20 AND 30 ORDER BY p_size, p_partkey LIMIT 25")
_children("equal_to_child", "events", "event_id", _Q.order_by_child("event_type").equal_to("purchase").start_at("zzz"), ["event_type"], "SELECT CAST(event_id AS VARCHAR) AS key, event_type FROM events WHERE event_type = 'purchase'")
_children("equal_to_null", "sessions", "id", _Q.order_by_child("name").equal_to(None), ["name"], "SELECT id AS key, name FROM sessions WHERE name IS NULL")
_children("end_at_holds_missing", "database_metrics", "id", _Q.order_by_child("ccu").end_at(100), ["ccu"], "SELECT CAST(id AS VARCHAR) AS key, ccu FROM database_metrics WHERE ccu <= 100 OR ccu IS NULL")
_children("start_at_number_holds_strings", "sessions", "id", _Q.order_by_child("name").start_at(5), ["name"], "SELECT id AS key, name FROM sessions WHERE name IS NOT NULL")
_children("order_by_key_range", "orders", "o_orderkey", _Q.order_by_key().start_at("100").end_before("900"), ["o_orderstatus"], "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
_children("order_by_key_limit_last", "orders", "o_orderkey", _Q.order_by_key().limit_to_last(20), ["o_orderstatus"], "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus FROM orders ORDER BY o_orderkey DESC LIMIT 20")
_children("default_order_limit", "nation", "n_nationkey", _Q.limit_to_first(5), ["n_name"], "SELECT CAST(n_nationkey AS VARCHAR) AS key, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
_children("order_by_child_nested", "events", "event_id", _Q.order_by_child("props/k").start_at(90), ["event_type"], "SELECT CAST(event_id AS VARCHAR) AS key, event_type FROM events WHERE CAST(json_extract(props, '$.k') AS DOUBLE) >= 90")


def order_by_child_nested(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("key"), "event_type", F.concat(F.lit('{"props":'), "props", F.lit("}")).alias("value"))
    return _Q.order_by_child("props/k").start_at(90).apply(e, value="value").drop("value")


QUERIES["order_by_child_nested"] = order_by_child_nested


def _keys(spark, sf):
    c = table(spark, sf, "customer")
    key = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('k', c_custkey) WHEN 1 THEN concat('0', c_custkey) WHEN 2 THEN concat('-', c_custkey) ELSE cast(c_custkey * 1000003 as string) END")
    return c.select(key.alias("key"), "c_custkey")


_KEYS = "(SELECT CASE c_custkey % 4 WHEN 0 THEN 'k' || c_custkey WHEN 1 THEN '0' || c_custkey WHEN 2 THEN '-' || c_custkey ELSE CAST(c_custkey * 1000003 AS VARCHAR) END AS key, c_custkey FROM customer)"
_INT = "CASE WHEN regexp_matches(key, '^(0|-?[1-9][0-9]*)$') AND TRY_CAST(key AS BIGINT) BETWEEN -2147483648 AND 2147483647 THEN TRY_CAST(key AS BIGINT) END"


@query(f"SELECT key, CAST(ROW_NUMBER() OVER (ORDER BY {_INT} NULLS LAST, key) AS BIGINT) AS place FROM {_KEYS}")
def order_by_key_int_first(spark, sf):
    """The place of every key: integers numerically, then the others bytewise."""
    k = _keys(spark, sf).select("key", model.key_struct(F.col("key")).alias("k"))
    return placed(k, ["k"], "key-places").select("key", (F.col("place") + 1).alias("place"))


_MIXED = "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN '\"' || event_type || '\"' WHEN 3 THEN CAST(value AS VARCHAR) ELSE '{\"a\":1}' END"


def _mixed(spark, sf):
    e = table(spark, sf, "events")
    v = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'true' WHEN 2 THEN concat('\"', event_type, '\"') WHEN 3 THEN cast(value as string) ELSE '{\"a\":1}' END")
    return e.select(F.col("event_id").cast("string").alias("key"), v.alias("json"))


_RANKED = "(SELECT CAST(event_id AS VARCHAR) AS key, event_id, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN CASE WHEN value IS NULL THEN 0 ELSE 3 END ELSE 5 END AS r, CASE WHEN event_id % 5 = 3 THEN COALESCE(value, 0) ELSE 0 END AS n, CASE WHEN event_id % 5 = 2 THEN event_type ELSE '' END AS s FROM events)"


@query(f"SELECT key, r AS rank, CAST(n AS DOUBLE) AS num, s AS str, CAST(ROW_NUMBER() OVER (ORDER BY r, n, s, event_id) AS BIGINT) AS place FROM {_RANKED}")
def mixed_type_order(spark, sf):
    """Rank struct and place of every value in the order of mixed types, ties by key."""
    v = _mixed(spark, sf).select("key", model.sort_key(F.col("json")).alias("v"), model.key_struct(F.col("key")).alias("k"))
    return placed(v, ["v", "k"], "value-places").select("key", "v.*", (F.col("place") + 1).alias("place"))


@query(f"SELECT key FROM {_RANKED} WHERE r < 3 OR (r = 3 AND n <= 50)")
def cross_type_end_at(spark, sf):
    """An upper bound that is a number holds everything that ranks below numbers."""
    return TreeQuery().order_by_value().end_at(50).apply(_mixed(spark, sf), value="json").select("key")


@query(f"SELECT key FROM {_RANKED} WHERE r = 5")
def equal_to_object(spark, sf):
    return TreeQuery().order_by_value().equal_to({}).apply(_mixed(spark, sf), value="json").select("key")


@query("SELECT key, CASE WHEN a IS NULL THEN 'entered' WHEN b IS NULL THEN 'exited' ELSE 'stayed' END AS change FROM (SELECT CAST(c_custkey AS VARCHAR) AS key, 1 AS a FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 50) FULL JOIN (SELECT CAST(c_custkey AS VARCHAR) AS key, 1 AS b FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 50) USING (key)")
def view_enter_exit(spark, sf):
    """Keys that enter and leave a limited view between two states of its collection."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_acctbal", "c_mktsegment")
    q = TreeQuery().order_by_child("c_acctbal").limit_to_last(50)
    return views_diff(q.apply(c), q.apply(c.filter("c_mktsegment <> 'BUILDING'")))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, CAST(LAG(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS VARCHAR) AS previous FROM supplier")
def view_predecessor(spark, sf):
    """The previous child of each child, per collection."""
    from canopy.operators.query import predecessors

    children = table(spark, sf, "supplier").select("s_nationkey", F.col("s_suppkey").cast("string").alias("key"), "s_acctbal")
    return predecessors(children, ["s_nationkey"], TreeQuery().order_by_child("s_acctbal")).select("key", "previous")


# trees --------------------------------------------------------------------------------

def _nations(spark, sf):
    """The tree of regions and nations as leaves."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    base = F.concat_ws("/", F.lit("regions"), "r_name", F.lit("nations"), F.col("n_nationkey").cast("string"))
    leaf = j.select(F.lit("d").alias("db"), F.concat(base, F.lit("/name")).alias("path"), F.to_json(F.array("n_name")).alias("v")).withColumn("value", F.expr("substring(v, 2, length(v) - 2)")).drop("v")
    return leaf.unionByName(j.select(F.lit("d").alias("db"), F.concat(base, F.lit("/key")).alias("path"), F.col("n_nationkey").cast("string").alias("value")))


_NATIONS = "(SELECT 'regions/' || r_name || '/nations/' || n_nationkey AS base, * FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT base || '/name' AS path, '\"' || n_name || '\"' AS value FROM {_NATIONS} UNION ALL SELECT base || '/key', CAST(n_nationkey AS VARCHAR) FROM {_NATIONS}")
def flatten_leaves(spark, sf):
    """Assembled subtrees flattened again: every leaf comes back."""
    built = tree.assemble(_nations(spark, sf), levels=2).withColumnRenamed("path", "base")
    return tree.flatten_json(built, ["base"], "value").select(F.concat_ws("/", "base", "path").alias("path"), "value")


@query("SELECT r_name AS key, COUNT(*) * 2 AS leaves, CAST(SUM(octet_length(encode(n_name)) + 2 + length(CAST(n_nationkey AS VARCHAR))) AS BIGINT) AS bytes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def child_keys(spark, sf):
    return tree.child_keys(_nations(spark, sf), "regions").select("key", "leaves", "bytes")


_SZ = "12 + 1 + SUM(length(CAST(n_nationkey AS VARCHAR)) + 4 + 1 + 7 + 12 + 8 + octet_length(encode(n_name)) + 2)"


@query(f"SELECT r_name AS key, '{{\".sz\":' || CAST({_SZ} AS BIGINT) || '}}' AS value FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def shallow_sizes(spark, sf):
    """A shallow read of containers: their size by the estimator."""
    return tree.shallow(_nations(spark, sf), "regions").select("key", "value")


@query("SELECT r_name AS key, CAST(2 + COUNT(*) * 3 AS BIGINT) AS nodes, CAST(COUNT(*) * 2 AS BIGINT) AS fields FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def subtree_counts(spark, sf):
    """Nodes and fields of each subtree."""
    return tree.child_sizes(_nations(spark, sf), "regions").select("key", "nodes", "fields")


@query("SELECT 'name' AS key, '\"' || n_name || '\"' AS value FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'key', '3'")
def shallow_read(spark, sf):
    at = _nations(spark, sf).filter(F.col("path").contains("/nations/3/"))
    rel = at.withColumn("path", F.regexp_replace("path", "^.*/nations/3/", ""))
    return tree.shallow(rel).select("key", "value")


@query("SELECT DISTINCT r_name AS key, true AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def shallow_truncated(spark, sf):
    return tree.shallow_truncated(_nations(spark, sf), "regions").select("key", "value")


@query(f"SELECT substr(base, length('regions/') + 1) || '/name' AS path, '\"' || n_name || '\"' AS value FROM {_NATIONS} WHERE r_name = 'ASIA'")
def path_read(spark, sf):
    """Leaves below a path."""
    sub = tree.subtree(_nations(spark, sf), "/regions/ASIA/").filter(F.col("path").endswith("/name"))
    return sub.select(F.concat(F.lit("ASIA/"), "path").alias("path"), "value")


def _lines(spark, sf):
    li = table(spark, sf, "lineitem")
    path = F.concat_ws("/", F.lit("o"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return li.groupBy(path.alias("path")).agg(F.min("l_partkey").cast("string").alias("value")).select(F.lit("d").alias("db"), "path", "value")


@query("WITH k AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) SELECT 'o/' || l_orderkey AS parent, COUNT(*) AS children, CAST(MAX(l_linenumber) AS BIGINT) AS max_index, MAX(l_linenumber) < 2 * COUNT(*) AS is_array FROM k GROUP BY l_orderkey")
def array_rule(spark, sf):
    """Which containers read back as arrays: all keys integers, the largest below twice their number."""
    return tree.array_shape(_lines(spark, sf)).filter(F.col("parent").startswith("o/")).select("parent", "children", "max_index", "is_array")


@query("WITH k AS (SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS v FROM lineitem GROUP BY ALL), g AS (SELECT l_orderkey, MAX(l_linenumber) AS m, COUNT(*) AS c, MAP(list(l_linenumber), list(v)) AS kv FROM k GROUP BY 1) SELECT 'o/' || l_orderkey AS path, CASE WHEN m < 2 * c THEN '[' || array_to_string(list_transform(range(0, m + 1), lambda i: COALESCE(CAST(kv[i] AS VARCHAR), 'null')), ',') || ']' ELSE '{' || array_to_string(list_transform(list_sort(map_keys(kv)), lambda i: '\"' || i || '\":' || kv[i]), ',') || '}' END AS value FROM g")
def assemble_subtree(spark, sf):
    """Orders assembled to JSON: arrays with their gaps, else objects."""
    return tree.assemble(_lines(spark, sf), levels=2).select("path", "value")


@query()
def structural_fields(spark, sf):
    """Distinct field names of objects without collection keys, over all SET values."""
    w = table(spark, sf, "wal_entries").filter("op = 's'").select(F.concat_ws("/", "project_id", "database_id").alias("db"), F.col("entry_id").cast("string").alias("e"), "value")
    leaf = tree.flatten_json(w, ["db", "e"], "value").select("db", F.concat_ws("/", F.lit("e"), "e", "path").alias("path"), "value")
    return tree.structural_fields(leaf)


@query()
def render_values(spark, sf):
    """Every log value as it reads back once stored, with its size estimate and depth."""
    w = table(spark, sf, "wal_entries").filter("value is not null")
    r = w.select("entry_id", tree.render_json("value").alias("value"), tree.value_depth(F.col("value")).alias("depth"), tree.value_size(F.col("value")).alias("size"))
    return r.select("entry_id", "value", "depth", "size")


@query("SELECT event_id, sha256('{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}') AS hash FROM events WHERE props IS NOT NULL")
def native_hash(spark, sf):
    """SHA-256 of the canonical JSON text."""
    return table(spark, sf, "events").filter("props is not null").select("event_id", tree.native_hash("props").alias("hash"))


@query()
def sdk_hash(spark, sf):
    return table(spark, sf, "events").select("event_id", tree.sdk_hash("props").alias("hash"))


@query("SELECT doc_id, CAST(COALESCE(list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END)), 0) AS BIGINT) AS utf16 FROM documents WHERE text <> ''")
def utf16_units(spark, sf):
    """String length in UTF-16 code units."""
    return table(spark, sf, "documents").filter("text <> ''").select("doc_id", utf16_length(F.col("text")).cast("bigint").alias("utf16"))


_B64 = ids.ALPHABET  # fixed value


@query("SELECT entry_id, CAST(list_sum(list_transform(range(1, 9), lambda i: (strpos('" + _B64 + "', substr(k, i, 1)) - 1) * CAST(pow(64, 8 - i) AS BIGINT))) AS BIGINT) AS ms FROM (SELECT entry_id, regexp_extract(path, '(?:^|/)(-[A-Za-z0-9_-]{19})(?:/|$)', 1) AS k FROM wal_entries) WHERE k <> ''")
def push_id_time(spark, sf):
    """Milliseconds inside the push ids of log paths."""
    k = F.regexp_extract("path", r"(?:^|/)(-[A-Za-z0-9_-]{19})(?:/|$)", 1)
    return table(spark, sf, "wal_entries").select("entry_id", ids.push_id_millis(k).alias("ms")).filter("ms is not null")


@query("SELECT event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ms FROM events")
def push_id_roundtrip(spark, sf):
    """Ids made from times give the times back."""
    e = table(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("t"))
    return e.select("event_id", ids.push_id_millis(ids.push_id(F.col("t"), F.col("event_id"))).alias("ms"))


@query("SELECT db, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length(db) + 1), lambda i: CAST(unicode(substr(db, i, 1)) AS UBIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS BIGINT) AS fnv FROM (SELECT DISTINCT project_id || '/' || id AS db FROM project_databases)")
def routing(spark, sf):
    """The hash that picks the server of every database."""
    d = table(spark, sf, "project_databases").select(F.concat_ws("/", "project_id", "id").alias("db")).distinct()
    return d.select("db", ids.fnv1a32("db").alias("fnv"))


@query()
def core_routing(spark, sf):
    """Core of every database by its routing hash."""
    d = table(spark, sf, "project_databases").select(F.concat_ws("/", "project_id", "id").alias("db")).distinct()
    return d.select("db", ids.core_of(F.col("db"), 8).alias("core"))


@query("SELECT entry_id, rtrim(ltrim(path, '/'), '/') AS trimmed, '/' || rtrim(ltrim(path, '/'), '/') AS normalized, regexp_replace('/' || rtrim(ltrim(path, '/'), '/'), '^.*/', '') AS last FROM wal_entries WHERE rtrim(ltrim(path, '/'), '/') <> ''")
def path_functions(spark, sf):
    w = table(spark, sf, "wal_entries").withColumn("p", model.trimmed(F.col("path"))).filter("p <> ''")
    return w.select("entry_id", F.col("p").alias("trimmed"), model.normalized(F.col("path")).alias("normalized"), model.last_segment(F.col("path")).alias("last"))


@query("SELECT doc_id, octet_length(encode(text)) <= 768 AND NOT regexp_matches(text, '[$#\\[\\]/\\x00-\\x1f\\x7f]') AND strpos(substr(text, 2), '.') = 0 AND text <> '' AS valid FROM documents WHERE text IS NOT NULL")
def key_validation(spark, sf):
    """Whether a whole text could be a key."""
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", model.valid_key(F.col("text")).alias("valid"))


@query("SELECT entry_id, regexp_matches('/' || trim(path, '/'), '^/(rooms|notes)/[^/]+(/|$)') AS matched FROM wal_entries")
def volatile_pattern(spark, sf):
    """Paths that match ``rooms/*`` or ``notes/$id``, or lie below."""
    m = lambda p: model.matches_pattern(F.col("path"), F.lit(p))
    return table(spark, sf, "wal_entries").select("entry_id", (m("rooms/*") | m("notes/$id")).alias("matched"))


# writes -------------------------------------------------------------------------------

@query("SELECT event_id, CAST(SUM(CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(floor(value) AS BIGINT) END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS result FROM (SELECT *, SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)")
def increment_chain(spark, sf):
    """A counter per user: sign-ups set it to 0, all else adds."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_id").alias("seq"), F.floor("value").alias("delta"), F.when(F.col("event_type") == "signup", 0).alias("base"))
    return mutations.increments(e, ["user_id"]).select("event_id", F.col("result").cast("bigint").alias("result"))


@query("SELECT MIN(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def dedup_requests(spark, sf):
    """The first write of each (client, request)."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("user_id").alias("client"), F.col("event_type").alias("request_id"), F.col("event_id").alias("seq"))
    return mutations.dedup(e).select("event_id", "user_id", "event_type")


@query("WITH n AS (SELECT user_id, MIN(event_id) AS at FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT event_id FROM events e WHERE event_type <> 'purchase' OR NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = e.user_id AND n.at < e.event_id)")
def taint_filter(spark, sf):
    """Purchases that wait for a write of an event refused before are dropped."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("client"), F.col("event_id").alias("seq"), "event_type")
    pending = e.withColumn("pending", F.when(F.col("event_type") == "purchase", F.array(F.lit("error"))).otherwise(F.array().cast("array<string>")))
    nacked = e.filter("event_type = 'error'").groupBy("client").agg(F.min("seq").alias("seq")).withColumn("request_id", F.lit("error"))
    return mutations.untainted(pending, nacked).select("event_id")


@query("SELECT o_orderkey AS tx_id, COUNT(*) <= 1000 AND BOOL_AND(l_quantity <= 49) AS committed FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def tx_condition(spark, sf):
    """A transaction per order, that holds if a condition on each line's stored value holds."""
    li = table(spark, sf, "lineitem").withColumn("p", F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.col("l_extendedprice").cast("string")))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    li = li.join(o, "l_orderkey", "left_semi").groupBy("l_orderkey", "p").agg(F.max("l_quantity").alias("q"))
    ok = F.when(F.col("q") <= 49, "1").otherwise("2")
    leaf = li.select(F.lit("d").alias("db"), F.col("p").alias("path"), ok.alias("value"))
    ops = li.select(F.col("l_orderkey").alias("tx_id"), F.lit("d").alias("db"), F.lit(1).alias("seq"), F.lit("c").alias("op"), F.col("p").alias("path"), F.lit("1").alias("value"), F.lit(None).cast("string").alias("hash"))
    return mutations.transactions(ops, leaf).select("tx_id", "committed")


@query("SELECT entry_id, op, rtrim(ltrim(path, '/'), '/') AS path FROM (SELECT entry_id, CASE WHEN op = 's' AND (value IS NULL OR trim(value) = 'null') THEN 'd' ELSE op END AS op, path FROM wal_entries WHERE op <> 'u') UNION ALL SELECT entry_id, CASE WHEN json_type(value, '$.\"' || k || '\"') = 'NULL' THEN 'd' ELSE 's' END, trim(rtrim(ltrim(path, '/'), '/') || '/' || k, '/') FROM (SELECT entry_id, path, value, UNNEST(json_keys(value)) AS k FROM wal_entries WHERE op = 'u' AND json_valid(value))")
def expand_update(spark, sf):
    """UPDATE entries as one SET or DELETE per key; SET of null as DELETE."""
    return mutations.expand_update(table(spark, sf, "wal_entries")).select("entry_id", "op", "path")


@query("WITH m AS (SELECT entry_id, project_id, database_id, '/' || trim(path, '/') AS p FROM wal_entries), v AS (SELECT DISTINCT project_id, database_id, '/' || split_part(trim(path, '/'), '/', 1) AS v FROM wal_entries) SELECT m.entry_id, v.v AS view_path, CASE WHEN m.p = v.v THEN 'at' WHEN v.v = '/' OR starts_with(m.p, v.v || '/') THEN 'below' ELSE 'above' END AS relation FROM m JOIN v USING (project_id, database_id) WHERE m.p = v.v OR v.v = '/' OR m.p = '/' OR starts_with(m.p, v.v || '/') OR starts_with(v.v, m.p || '/')")
def mutation_view_match(spark, sf):
    """Log entries and the views of top-level collections on one line with them."""
    w = table(spark, sf, "wal_entries").select("entry_id", F.struct("project_id", "database_id").alias("db"), "path")
    v = w.select("db", F.concat(F.lit("/"), F.split(model.trimmed(F.col("path")), "/")[0]).alias("view_path")).distinct()
    m = mutations.match_views(w, v)
    return m.select("entry_id", F.concat(F.lit("/"), "v_path").alias("view_path"), "relation")


@query("SELECT CAST(user_id AS VARCHAR) AS path, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def state_at_with_deletes(spark, sf):
    """Events as a log: errors delete the user's node, all else sets it."""
    from canopy.operators import changefeed

    e = table(spark, sf, "events").select(
        F.lit("p").alias("project_id"), F.lit("d").alias("database_id"), F.col("event_id").alias("sequence"), F.lit(1).alias("line_no"), F.when(F.col("event_type") == "error", "d").otherwise("s").alias("op"), F.concat(F.lit("/"), "user_id").alias("path"), F.col("value").cast("string").alias("value")
    )
    s = changefeed.state_at(e)
    return s.select(F.expr("substring(path, 2)").alias("path"), F.col("value").cast("double").alias("value"))


@query()
def volatile_hourly(spark, sf):
    """Volatile writes coalesced to the last value of an hour."""
    return views.volatile_flush(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 3_600_000, "value", "event_id")


SQL["volatile_hourly"] = "SELECT user_id, event_type, CAST(epoch_us(ts) // 3600000000 * 3600000 AS BIGINT) AS flush_ms, arg_max(value, (ts, event_id)) AS value, COUNT(*) AS coalesced FROM events GROUP BY 1, 2, 3"
for _ms, _name in ((views.FAST_MS, "volatile_fast_flush"), (views.SLOW_MS, "volatile_slow_flush")):
    QUERIES[_name] = lambda spark, sf, ms=_ms: views.volatile_flush(table(spark, sf, "events"), ["event_type"], "ts", ms, "value", "event_id")
    SQL[_name] = f"SELECT event_type, CAST(epoch_us(ts) // {_ms * 1000} * {_ms} AS BIGINT) AS flush_ms, arg_max(value, (ts, event_id)) AS value, COUNT(*) AS coalesced FROM events GROUP BY 1, 2"


@query()
def live_view_events(spark, sf):
    """A stream of customer orders through live top-3 views, one view per nation."""
    at = run_dir(spark, "views")
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).select(F.lit("d").alias("db"), F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string")).alias("view_path"), F.lit("top").alias("query_id"), F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("value"))
    j.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(j.schema).parquet(f"{at}/in")
    return views.run_available(views.live_views(stream, {"top": TreeQuery().order_by_value().limit_to_last(3)}), at)


@query("WITH l AS (SELECT c_nationkey, o_custkey, arg_max(o_totalprice, o_orderkey) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY v DESC, o_custkey DESC) AS k FROM l) SELECT '/n/' || c_nationkey AS view_path, CAST(o_custkey AS VARCHAR) AS key, v AS value FROM r WHERE k <= 3")
def live_view_windows(spark, sf):
    """The top-3 windows that a client holds after all events of the live views."""
    e = live_view_events(spark, sf)
    one = F.create_map(F.expr("substring(rel_path, 2)"), F.nullif("data", F.lit("null")))
    said = e.select("view_path", "seq", "ord", F.explode(F.when(F.col("rel_path") == "/", F.from_json("data", "map<string,string>")).otherwise(one)).alias("key", "value"))
    now = said.groupBy("view_path", "key").agg(F.max_by(F.struct("value"), F.struct("seq", "ord")).alias("now"))
    return now.select("view_path", "key", F.col("now.value").cast("double").alias("value")).filter("value is not null")


@query("SELECT e.event_id, MIN(s.event_id) AS fired FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_type = 'signup' AND s.event_id > e.event_id WHERE e.event_type = 'click' GROUP BY 1")
def on_disconnect_fire(spark, sf):
    """Clicks register deferred writes; the user's next sign-up stands for the disconnect that fires them."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), "event_type")
    reg = e.filter("event_type = 'click'").select("client", "seq", F.lit("s").alias("op"), F.col("seq").cast("string").alias("path"), F.lit("1").alias("value"))
    gone = e.filter("event_type = 'signup'").select("client", "seq", F.lit(0).alias("ts_ms"))
    return mutations.on_disconnect(reg, gone).select(F.col("path").cast("bigint").alias("event_id"), F.col("seq").alias("fired"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'o' WHEN 'click' THEN 'u' WHEN 'error' THEN 'd' ELSE 's' END AS op, CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE props END AS value FROM events")
def rest_operations(spark, sf):
    """Events as REST requests, mapped to operations."""
    e = table(spark, sf, "events")
    method = F.create_map(*[F.lit(x) for x in ("view", "GET", "click", "PATCH", "error", "DELETE", "signup", "POST", "purchase", "PUT")])[F.col("event_type")]
    r = e.select(F.col("event_id").alias("request_id"), method.alias("method"), F.concat(F.lit("/u/"), "user_id", F.lit(".json")).alias("path"), F.col("props").alias("body"), F.lit(1_700_000_000_000).alias("ts_ms"), F.lit(None).cast("string").alias("if_match"))
    return rest.to_operations(r).select(F.col("request_id").alias("event_id"), "op", "value")


@query("SELECT event_id, 'event: put' || chr(10) || 'data: {\"path\":\"/u/' || user_id || '\",\"data\":' || props || '}' || chr(10) || chr(10) AS text FROM events WHERE props IS NOT NULL")
def sse_text(spark, sf):
    """Event-stream text of one put per event."""
    e = table(spark, sf, "events").filter("props is not null")
    return e.select("event_id", rest.sse(F.lit("put"), F.concat(F.lit("/u/"), "user_id"), F.col("props")).alias("text"))


@query()
def compaction(spark, sf):
    """A snapshot of the first log files with the rest applied on top."""
    from canopy.operators import changefeed
    from canopy.sources import wal

    feed = table(spark, sf, "wal_entries")
    return wal.compact(spark, changefeed.state_at(feed, 20), feed.filter("sequence > 20")).select("project_id", "database_id", "path", "value")


@query("SELECT project_id, database_id, lo + 1 AS missing_from, sequence - 1 AS missing_to FROM (SELECT project_id, database_id, sequence, LAG(sequence) OVER (PARTITION BY project_id, database_id ORDER BY sequence) AS lo FROM (SELECT DISTINCT project_id, database_id, sequence FROM wal_entries WHERE op = 'd')) WHERE sequence > lo + 1")
def log_gaps(spark, sf):
    """Log files without a delete between those that hold one, per database."""
    from canopy.sources import wal

    return wal.gaps(table(spark, sf, "wal_entries").filter("op = 'd'"), keys=("project_id", "database_id"))


_BUCKET = "LEAST(536870912, {tokens} + ({t} - {last}) // 15 * 67108864)"
_FIRST, _NEXT = "536870912", _BUCKET.format(tokens="s.tokens", t="w.t", last="s.last")


@query(f"WITH RECURSIVE w AS (SELECT entry_id, project_id || '/' || database_id AS db, CAST(epoch(received_at) AS BIGINT) AS t, COALESCE(octet_length(encode(value)), 0)::BIGINT * 1048576 AS n, ROW_NUMBER() OVER (PARTITION BY project_id, database_id ORDER BY CAST(epoch(received_at) AS BIGINT), entry_id) AS k FROM wal_entries), s AS (SELECT db, k, entry_id, n <= {_FIRST} AS allowed, CASE WHEN n <= {_FIRST} THEN {_FIRST} - n ELSE {_FIRST} END AS tokens, t AS last FROM w WHERE k = 1 UNION ALL SELECT w.db, w.k, w.entry_id, w.n <= {_NEXT}, {_NEXT} - CASE WHEN w.n <= {_NEXT} THEN w.n ELSE 0 END, s.last + (w.t - s.last) // 15 * 15 FROM s JOIN w ON w.db = s.db AND w.k = s.k + 1) SELECT entry_id, allowed FROM s")
def rate_limit(spark, sf):
    """Writes of each database against the token bucket, by the bytes of their values scaled up."""
    w = table(spark, sf, "wal_entries").select("entry_id", F.concat_ws("/", "project_id", "database_id").alias("db"), epoch_seconds(F.col("received_at")).alias("t"), (F.coalesce(F.octet_length("value"), F.lit(0)).cast("bigint") * (1 << 20)).alias("bytes"))
    return mutations.rate_limited(w, "db", "t", "bytes", ("entry_id",)).select("entry_id", "allowed")


@query("SELECT sha256('{' || string_agg('\"k' || p_partkey || '\":{\"p_name\":\"' || p_name || '\",\"p_size\":7}', ',' ORDER BY 'k' || p_partkey) || '}') AS hash FROM part WHERE p_size = 7")
def query_result(spark, sf):
    """The children that survive a query as one JSON object, compared by its canonical text's hash."""
    p = table(spark, sf, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.to_json(F.struct("p_size", "p_name")).alias("value"))
    one = TreeQuery().order_by_child("p_size").equal_to(7).result(p)
    return one.select(tree.native_hash("value").alias("hash"))


# rules --------------------------------------------------------------------------------

_RULES = {"rules": {"$id": {".read": "auth != null && (auth.uid === $id || $id.matches(/^.*7$/) || root.child('vip/' + $id).exists())"}}}


@query("SELECT c_custkey AS id, c_nationkey = 3 OR c_custkey % 10 = 7 OR c_acctbal > 9000 AS allowed FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey % 5 = 0")
def rules_read_filter(spark, sf):
    """Customers as readers of their own node, of nodes that end in 7, and of VIP nodes."""
    c = table(spark, sf, "customer")
    uid = F.when(F.col("c_nationkey") == 3, F.col("c_custkey").cast("string")).otherwise("nobody")
    auth = F.when(F.col("c_custkey") % 5 != 0, F.struct(uid.alias("uid"), F.lit("custom").alias("provider"), F.lit(None).cast("map<string,string>").alias("token")))
    reqs = c.select(F.col("c_custkey").alias("id"), F.lit("d").alias("db"), F.concat(F.lit("/"), F.col("c_custkey").cast("string")).alias("path"), auth.alias("auth"), F.lit(0.0).alias("now"))
    vip = c.filter("c_acctbal > 9000").select(F.lit("d").alias("db"), F.concat(F.lit("vip/"), F.col("c_custkey").cast("string")).alias("path"), F.lit("true").alias("value"))
    return can_read(reqs, vip, Rules(_RULES)).select("id", "allowed")


def _rule_fn(name: str, expr: str, sql: str) -> None:
    """One rule function over texts: ``.read`` on a node whose token carries the text."""

    def run(spark, sf):
        d = table(spark, sf, "documents").filter("text is not null")
        token = F.create_map(F.lit("t"), F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"))
        reqs = d.select(F.col("doc_id").alias("id"), F.lit("d").alias("db"), F.lit("/x").alias("path"), F.struct(F.lit("u").alias("uid"), F.lit("p").alias("provider"), token.alias("token")).alias("auth"), F.lit(0.0).alias("now"))
        empty = spark.createDataFrame([], "db string, path string, value string")
        return can_read(reqs, empty, Rules({"rules": {"x": {".read": expr}}})).select("id", "allowed")

    run.__name__ = name
    query(f"SELECT doc_id AS id, {sql} AS allowed FROM documents WHERE text IS NOT NULL")(run)


_rule_fn("rule_contains", "auth.token.t.contains('shard')", "contains(text, 'shard')")
_rule_fn("rule_begins_ends", "auth.token.t.beginsWith('The') || auth.token.t.endsWith('.')", "starts_with(text, 'The') OR ends_with(text, '.')")
_rule_fn("rule_matches", "auth.token.t.matches(/[0-9]{5}/)", "regexp_matches(text, '[0-9]{5}')")
_rule_fn("rule_replace_case", "auth.token.t.replace('e', '').toUpperCase().contains('TST')", "contains(upper(replace(text, 'e', '')), 'TST')")
_rule_fn("rule_compare", "auth.token.t > 'M' && auth.token.t != null", "text > 'M'")

# writes in order, and what views and rules make of them -----------------------------------

@query(SQL["increment_chain"])
def payload_increments(spark, sf):
    """A counter per user by increments inside the payloads of updates; sign-ups set it to 0."""
    n = F.coalesce(F.floor("value"), F.lit(0)).cast("string")
    value = F.when(F.col("event_type") == "signup", '{"n":0}').otherwise(F.concat(F.lit('{"n":{".sv":{"increment":'), n, F.lit("}}}")))
    w = table(spark, sf, "events").select(F.lit("d").alias("db"), F.col("event_id").alias("seq"), F.lit("u").alias("op"), F.concat(F.lit("/u/"), "user_id").alias("path"), value.alias("value"))
    empty = spark.createDataFrame([], "db string, path string, value string")
    r = mutations.resolve_increments(w, empty)
    return r.select(F.col("seq").alias("event_id"), F.get_json_object("value", "$.n").cast("bigint").alias("result"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN p IS NULL OR p = 'purchase' WHEN 'purchase' THEN COALESCE(p = 'click', false) ELSE true END AS committed FROM (SELECT *, LAG(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def transaction_chain(spark, sf):
    """A lock per user: clicks take it if it is free, purchases give it back if it is held, each after the ones before."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("tx_id"), F.concat(F.lit("d"), "user_id").alias("db"), F.col("event_id").alias("tx_seq"), "event_type")
    step = lambda seq, op, path, value: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), F.lit(path).alias("path"), F.lit(value).cast("string").alias("value"))
    steps = F.when(F.col("event_type") == "click", F.array(step(1, "c", "/lock/by", None), step(2, "s", "/lock", '{"by":1}'))).when(F.col("event_type") == "purchase", F.array(step(1, "c", "/lock", '{"by":1.0}'), step(2, "u", "/", '{"lock/by":null}'))).otherwise(F.array(step(1, "s", "/seen", "true")))
    ops = e.select("tx_id", "db", "tx_seq", F.inline(steps)).withColumn("hash", F.lit(None).cast("string"))
    empty = spark.createDataFrame([], "db string, path string, value string")
    return mutations.transactions_in_order(ops, empty).select(F.col("tx_id").alias("event_id"), "committed")


@query("SELECT client, seq, idx, path FROM (SELECT user_id AS client, fired AS seq, CAST(event_id AS VARCHAR) AS path, ROW_NUMBER() OVER (PARTITION BY user_id, fired ORDER BY event_id) AS idx FROM (SELECT *, MIN(CASE WHEN event_type = 'signup' AND user_id % 5 = 0 OR event_id % 1000 = 999 THEN event_id END) OVER (PARTITION BY user_id % 2 ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fired FROM (SELECT event_id, event_type, user_id % 2 AS user_id FROM events)) WHERE event_type <> 'signup' AND event_id % 1000 <> 999 AND fired IS NOT NULL) WHERE idx <= 100")
def on_disconnect_caps(spark, sf):
    """Two clients that register more than they may hold: a hundred fire, the rest is refused."""
    e = table(spark, sf, "events").select((F.col("user_id") % 2).alias("client"), F.col("event_id").alias("seq"), "event_type")
    gone = (F.col("seq") % 1000 == 999) | ((F.col("event_type") == "signup") & (F.col("client") % 5 == 0))
    reg = e.filter(~gone & (F.col("event_type") != "signup")).select("client", "seq", F.lit("s").alias("op"), F.col("seq").cast("string").alias("path"), F.lit("1").alias("value"))
    fired = mutations.on_disconnect(reg, e.filter(gone).select("client", "seq", F.lit(0).alias("ts_ms")))
    return fired.select("client", "seq", F.col("idx").cast("bigint").alias("idx"), "path")


_SEEN = "(SELECT o_orderkey AS seq, o_orderstatus AS st, c_nationkey AS n, o_custkey AS c, CAST(o_totalprice AS VARCHAR) AS p, m FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT c_nationkey AS mn, MIN(c_custkey) AS m FROM customer GROUP BY 1) ON mn = c_nationkey)"


@query(f"""SELECT seq, 'n/' || n AS view_path, CASE st WHEN 'O' THEN 'patch' ELSE 'put' END AS ev, CASE st WHEN 'O' THEN '/' ELSE '/' || c END AS rel_path, CASE st WHEN 'F' THEN '{{"p":' || p || '}}' WHEN 'O' THEN '{{"' || c || '/p":' || p || '}}' ELSE 'null' END AS data FROM {_SEEN}
UNION ALL SELECT seq, 'n/' || n || '/' || m, CASE st WHEN 'O' THEN 'patch' ELSE 'put' END, '/', CASE st WHEN 'P' THEN 'null' ELSE '{{"p":' || p || '}}' END FROM {_SEEN} WHERE c = m""")
def simple_view_events(spark, sf):
    """Sets, updates and deletes as views of a nation and of its first customer see them: at, below and above."""
    c = table(spark, sf, "customer")
    j = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    price, nation = F.col("o_totalprice").cast("string"), F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string"))
    own = F.concat(nation, F.lit("/"), F.col("o_custkey").cast("string"))
    st = F.col("o_orderstatus")
    value = F.when(st == "F", F.concat(F.lit('{"p":'), price, F.lit("}"))).when(st == "O", F.concat(F.lit('{"'), F.col("o_custkey").cast("string"), F.lit('/p":'), price, F.lit("}")))
    op = F.when(st == "F", "s").when(st == "O", "u").otherwise("d")
    m = j.select(F.lit("d").alias("db"), F.col("o_orderkey").alias("seq"), op.alias("op"), F.when(st == "O", nation).otherwise(own).alias("path"), value.alias("value"))
    firsts = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c")).select(F.lit("d").alias("db"), F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string"), F.lit("/"), F.col("c").cast("string")).alias("view_path"))
    views_ = firsts.unionByName(c.select(F.lit("d").alias("db"), F.concat(F.lit("/n/"), F.col("c_nationkey").cast("string")).alias("view_path")).distinct())
    return mutations.view_events(mutations.match_views(m, views_)).select("seq", F.col("v_path").alias("view_path"), "ev", "rel_path", "data")


_ORDER_RULES = {"rules": {"orders": {"$o": {".write": "!data.exists() || newData.child('total').val() >= data.child('total').val()", ".validate": "newData.hasChildren(['total','status'])", "status": {".validate": "newData.isString() && newData.val().length === 1"}}}}}


def _order_tree(o):
    base = F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"))
    quoted = F.concat(F.lit('"'), "o_orderstatus", F.lit('"'))
    return o.select(F.lit("d").alias("db"), F.inline(F.array(F.struct(F.concat(base, F.lit("/total")).alias("path"), F.col("o_totalprice").cast("string").alias("value")), F.struct(F.concat(base, F.lit("/status")).alias("path"), quoted.alias("value")))))


def _order_writes(o, op, value):
    auth = F.lit(None).cast("struct<uid: string, provider: string, token: map<string,string>>")
    return o.select(F.col("o_orderkey").alias("id"), F.lit("d").alias("db"), F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")).alias("path"), auth.alias("auth"), F.lit(0.0).alias("now"), F.lit(op).alias("op"), value.alias("value"))


@query("SELECT o_orderkey AS id, o_custkey % 3 > 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS allowed FROM orders")
def rules_write_set(spark, sf):
    """Orders replaced: totals may not fall, total and status must be there, a status has one letter."""
    o = table(spark, sf, "orders")
    total = (F.col("o_totalprice") + (F.col("o_custkey") % 3 - 1)).cast("string")
    status = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit(',"status":"'), F.when(F.col("o_orderkey") % 5 == 0, "XX").otherwise(F.col("o_orderstatus")), F.lit('"')))
    w = _order_writes(o, "s", F.concat(F.lit('{"total":'), total, status, F.lit("}")))
    return can_write(w, _order_tree(o), Rules(_ORDER_RULES)).select("id", "allowed")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN false WHEN o_orderkey % 5 = 0 THEN false ELSE o_custkey % 3 > 0 END AS allowed FROM orders")
def rules_write_update(spark, sf):
    """Orders updated: what the update leaves alone counts as it is stored; a status taken away or too long is refused."""
    o = table(spark, sf, "orders")
    total = (F.col("o_totalprice") + (F.col("o_custkey") % 3 - 1)).cast("string")
    more = F.when(F.col("o_orderkey") % 7 == 0, ',"status":null').when(F.col("o_orderkey") % 5 == 0, ',"status":"XX"').otherwise("")
    w = _order_writes(o, "u", F.concat(F.lit('{"total":'), total, more, F.lit("}")))
    return can_write(w, _order_tree(o), Rules(_ORDER_RULES)).select("id", "allowed")


@query("SELECT p_partkey AS id, p_size < 40 AND p_partkey % 4 <> 0 AS allowed FROM part")
def rules_update_keys(spark, sf):
    """Updates denied as a whole, whose keys are judged one by one."""
    rules = Rules({"rules": {"part": {"$p": {"size": {".write": "newData.val() < 40"}, "name": {".write": True}}}}})
    more = F.when(F.col("p_partkey") % 4 == 0, ',"other":1').otherwise("")
    value = F.concat(F.lit('{"name":"x","size":'), F.col("p_size").cast("string"), more, F.lit("}"))
    auth = F.lit(None).cast("struct<uid: string, provider: string, token: map<string,string>>")
    w = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.lit("d").alias("db"), F.concat(F.lit("/part/"), F.col("p_partkey").cast("string")).alias("path"), auth.alias("auth"), F.lit(0.0).alias("now"), F.lit("u").alias("op"), value.alias("value"))
    return can_write(w, spark.createDataFrame([], "db string, path string, value string"), rules).select("id", "allowed")


@query("SELECT event_id // 2000 AS sequence, CASE event_type WHEN 'error' THEN 'd' ELSE 's' END AS op, '/e/' || event_id AS path, CASE WHEN event_type <> 'error' THEN COALESCE(CAST(json(props) AS VARCHAR), 'null') END AS value FROM events")
def wal_roundtrip(spark, sf):
    """Events appended as log files and read back."""
    from canopy.sources import wal

    at = run_dir(spark, "log")
    e = table(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "d").otherwise("s")
    wal.append_log(e.select(F.expr("event_id div 2000").alias("sequence"), (F.col("event_id") % 2000 + 1).cast("int").alias("line_no"), op.alias("op"), F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("path"), F.col("props").alias("value")), at)
    return wal.read_log(spark, at).select("sequence", "op", "path", "value")


@query("SELECT event_id, '{' || chr(10) || '  \"k\": ' || CAST(json_extract(props, '$.k') AS VARCHAR) || chr(10) || '}' AS text FROM events WHERE props IS NOT NULL")
def rest_pretty(spark, sf):
    """JSON answers over several lines."""
    return table(spark, sf, "events").filter("props is not null").select("event_id", rest.formatted(F.col("props"), "pretty").alias("text"))


@query("WITH s AS (SELECT project_id, database_id, ts, id, CAST(epoch(ts) AS BIGINT) // 86400 * 86400 AS window_s, writes, ccu, p50_latency_us FROM database_metrics), g AS (SELECT project_id, database_id, window_s, CAST(SUM(COALESCE(writes, 0)) AS BIGINT) AS writes, arg_max_null(ccu, (ts, id)) AS last_ccu, MAX(ccu) AS top, CAST(FLOOR(SUM(p50_latency_us) / COUNT(p50_latency_us)) AS BIGINT) AS p50 FROM s GROUP BY 1, 2, 3), p AS (SELECT *, GREATEST(top, LAG(last_ccu) OVER (PARTITION BY project_id, database_id ORDER BY window_s)) AS peak_ccu FROM g) SELECT project_id, database_id, window_s, writes, last_ccu, p50, peak_ccu, CAST(0 AS BIGINT) AS p99 FROM p WHERE writes > 0")
def flush_rows(spark, sf):
    """A day's flush row per database: sums, last gauge, mean latency, and a peak that starts from the gauge before."""
    m = table(spark, sf, "database_metrics").select("project_id", "database_id", F.struct("ts", "id").alias("at"), "ts", "writes", "ccu", "p50_latency_us")
    return metrics.flush_rows(m, ["project_id", "database_id"], "ts", 86_400, ["writes"], [], "ccu", "p50_latency_us", order="at")


@query("SELECT CAST(user_id AS VARCHAR) AS path, arg_max(value, event_id) AS value FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def compaction_of_flat_log(spark, sf):
    """Events as a log: a snapshot of the first half with the rest applied on top."""
    from canopy.operators import changefeed
    from canopy.sources import wal

    e = table(spark, sf, "events").select(F.lit("p").alias("project_id"), F.lit("d").alias("database_id"), F.col("event_id").alias("sequence"), F.lit(1).alias("line_no"), F.when(F.col("event_type") == "error", "d").otherwise("s").alias("op"), F.concat(F.lit("/"), "user_id").alias("path"), F.col("value").cast("string").alias("value"))
    half = e.agg((F.max("sequence") / 2).cast("bigint")).first()[0] or 0
    at = wal.write_snapshot(changefeed.state_at(e, half), run_dir(spark, "snapshots"), half)
    done = wal.compact(spark, spark.read.parquet(at), e.filter(F.col("sequence") > half))
    return done.select(F.expr("substring(path, 2)").alias("path"), F.col("value").cast("double").alias("value"))


# metrics ------------------------------------------------------------------------------

_ROLLUP = ", ".join(f"CAST(SUM({c}) AS BIGINT) AS {c}" for c in metrics.COUNTERS)


@query(f"SELECT ts, project_id, {_ROLLUP}, ROUND(COALESCE(AVG(NULLIF(p50_latency_us, 0)), 0), 6) AS p50_latency_us, ROUND(COALESCE(AVG(NULLIF(p99_latency_us, 0)), 0), 6) AS p99_latency_us FROM database_metrics GROUP BY ts, project_id")
def metrics_rollup(spark, sf):
    """All database rows rolled up to (time, project), those without a data size too."""
    r = metrics.project_rollup(table(spark, sf, "database_metrics"))
    return r.select("ts", "project_id", *[F.col(c).cast("bigint").alias(c) for c in metrics.COUNTERS], F.round("p50_latency_us", 6).alias("p50_latency_us"), F.round("p99_latency_us", 6).alias("p99_latency_us"))


_TOTALS = ", ".join(f"CAST(COALESCE(SUM({c}), 0) AS BIGINT) AS total_{c}" for c in ("bytes_in", "bytes_out", "writes", "reads", "events_sent"))


@query(f"SELECT project_id, MAX(peak_ccu) AS peak_ccu, {_TOTALS}, CAST(COALESCE(SUM(CASE WHEN p50_latency_us > 0 THEN p50_latency_us END) // NULLIF(COUNT(CASE WHEN p50_latency_us > 0 THEN 1 END), 0), 0) AS BIGINT) AS avg_latency_us FROM database_metrics GROUP BY project_id")
def metrics_summary(spark, sf):
    """Dashboard totals per project."""
    s = metrics.summary(table(spark, sf, "database_metrics"), ["project_id"])
    return s.select("project_id", "peak_ccu", *[F.col(c).cast("bigint").alias(c) for c in s.columns if c.startswith("total_")], "avg_latency_us")


@query("SELECT project_id, CAST(epoch(ts) AS BIGINT) // 21600 * 21600 AS window_s, CAST(SUM(COALESCE(writes, 0)) AS BIGINT) AS writes, arg_max_null(data_size_bytes, (ts, database_id)) AS last_data_size_bytes, MAX(ccu) AS max_ccu FROM (SELECT project_id, database_id, ts, arg_max_null(writes, id) AS writes, arg_max_null(data_size_bytes, id) AS data_size_bytes, arg_max_null(ccu, id) AS ccu FROM database_metrics GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING SUM(COALESCE(writes, 0)) > 0")
def window_accumulate(spark, sf):
    """Six-hour windows per project over all its databases; of rows sent again the newest, of gauges at one time the last database's."""
    values = ["writes", "data_size_bytes", "ccu"]
    m = rolling.newest_rows(table(spark, sf, "database_metrics"), ["project_id", "database_id", "ts"], "id", values)
    return metrics.accumulate(m.withColumn("at", F.struct("ts", "database_id")), ["project_id"], "ts", 21_600, ["writes"], ["data_size_bytes"], ["ccu"], order="at")


def _percentiles(rounding):
    def run(spark, sf):
        return metrics.exact_percentiles(table(spark, sf, "database_metrics"), ["project_id"], "p50_latency_us", rounding=rounding)

    return run


for _name, _fn in (("percentile_floor", "floor"), ("percentile_round", "round")):
    QUERIES[_name] = _percentiles(_fn)
    SQL[_name] = "SELECT project_id, COUNT(*) AS n, " + ", ".join(f"list_sort(LIST(p50_latency_us))[CAST({_fn}((COUNT(*) - 1) * {p} / 100.0) AS BIGINT) + 1] AS p{p}" for p in (50, 90, 99)) + " FROM database_metrics WHERE p50_latency_us IS NOT NULL GROUP BY project_id"


@query("WITH w AS (SELECT *, CAST(epoch(ts) AS BIGINT) // 21600 AS win FROM database_metrics), a AS (SELECT project_id, win, SUM(p99_latency_us) // COUNT(p99_latency_us) AS m FROM w GROUP BY 1, 2 HAVING COUNT(p99_latency_us) > 0) SELECT id, CAST(m AS BIGINT) AS project_avg FROM w JOIN a USING (project_id, win) WHERE p99_latency_us >= 10000 AND events_sent >= 100 AND m > 0 AND p99_latency_us > 3 * m")
def anomaly_latency(spark, sf):
    """Rows with more than three times the latency of their project's window."""
    a = metrics.high_latency(table(spark, sf, "database_metrics"), "project_id", "database_id", "ts", "p99_latency_us", "events_sent", 21_600)
    return a.select("id", "project_avg")


@query("WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), c AS (SELECT user_id, event_type, MIN(t) AS t FROM e GROUP BY 1, 2 UNION ALL SELECT e.user_id, e.event_type, MIN(e.t) AS t FROM c JOIN e ON e.user_id = c.user_id AND e.event_type = c.event_type AND e.t >= c.t + 86400 GROUP BY 1, 2) SELECT user_id, event_type, t FROM c")
def event_cooldown(spark, sf):
    """Times at least a day apart at which a user's events of a type count."""
    e = table(spark, sf, "events").select("user_id", "event_type", epoch_seconds(F.col("ts")).alias("t"))
    return metrics.with_cooldown(e, ["user_id", "event_type"], "t", 86_400)


@query("SELECT DISTINCT project_id FROM database_metrics")
def project_ids(spark, sf):
    return table(spark, sf, "database_metrics").select("project_id").distinct()


@query("SELECT project_id, database_id, CAST(MAX(epoch(ts)) AS BIGINT) AS last_s FROM database_metrics GROUP BY 1, 2 HAVING MAX(epoch(ts)) < 1775000000 - 180")
def stale_databases(spark, sf):
    return metrics.stale(table(spark, sf, "database_metrics"), ["project_id", "database_id"], "ts", 1_775_000_000)


# control plane ------------------------------------------------------------------------

_NOW = 1_774_000_000
_SERVERS = f"(SELECT DISTINCT ON (id) * FROM servers WHERE last_heartbeat <= {_NOW} ORDER BY id, last_heartbeat DESC, database_count DESC)"
_HEALTHY = f"(SELECT * FROM {_SERVERS} WHERE status = 'active' AND last_heartbeat > {_NOW} - 40000)"


def _servers(spark, sf):
    return control.latest(table(spark, sf, "servers").filter(F.col("last_heartbeat") <= _NOW), ["id"], "last_heartbeat", "database_count")


def _healthy(spark, sf):
    return control.healthy(_servers(spark, sf), F.lit(_NOW), 40_000)


@query(f"SELECT id, hostname, last_heartbeat FROM {_HEALTHY}")
def healthy_servers(spark, sf):
    return _healthy(spark, sf).select("id", "hostname", "last_heartbeat")


@query(f"SELECT id FROM {_SERVERS} WHERE status = 'active' AND last_heartbeat <= {_NOW} - 3000")
def unhealthy_servers(spark, sf):
    return control.unhealthy(_servers(spark, sf), F.lit(_NOW), 3_000).select("id")


@query(f"SELECT d.project_id, d.id, CASE WHEN g.id IS NULL THEN d.server_id END AS server_id, CASE WHEN g.id IS NULL THEN d.status ELSE 'inactive' END AS status FROM (SELECT DISTINCT * FROM project_databases) d LEFT JOIN (SELECT id FROM {_SERVERS} WHERE status = 'active' AND last_heartbeat <= {_NOW} - 3000) g ON g.id = d.server_id")
def unhealthy_sweep(spark, sf):
    """Databases after those on servers that went silent have lost them."""
    return control.sweep(table(spark, sf, "project_databases").distinct(), _servers(spark, sf), F.lit(_NOW), 3_000).select("project_id", "id", "server_id", "status")


@query("SELECT COUNT(*) AS total FROM events")
def events_total(spark, sf):
    """The total beside a page of events."""
    return table(spark, sf, "events").agg(F.count("*").alias("total"))


@query(f"SELECT id, database_count FROM {_HEALTHY} ORDER BY database_count, id LIMIT 1")
def best_server(spark, sf):
    return control.best_server(_healthy(spark, sf)).select("id", "database_count")


@query(f"SELECT id, CAST(ROW_NUMBER() OVER (ORDER BY id) - 1 AS INT) AS idx, COUNT(*) OVER () AS total FROM {_HEALTHY}")
def assign_row_number(spark, sf):
    return control.numbered(_healthy(spark, sf))


_PROJECTS = "(SELECT id, arg_max(name, (config_version, updated_at)) AS name, MAX(config_version) AS config_version FROM projects GROUP BY id)"


@query(f"SELECT p.id AS project_id, p.name, p.config_version, d.id AS database_id, d.status AS database_status, s.hostname, s.ip_address FROM {_PROJECTS} p LEFT JOIN (SELECT DISTINCT * FROM project_databases) d ON d.project_id = p.id LEFT JOIN {_HEALTHY} s ON s.id = d.server_id")
def connect_left_join(spark, sf):
    """What a connection needs: project, its databases, their healthy servers."""
    p = control.latest(table(spark, sf, "projects").select("id", "name", "config_version", "updated_at"), ["id"], "config_version", "updated_at")
    out = control.connect_data(p, table(spark, sf, "project_databases").distinct(), _healthy(spark, sf))
    return out.select("project_id", "name", "config_version", "database_id", "database_status", "hostname", "ip_address")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100")
def events_page(spark, sf):
    """A page over all events."""
    return control.page(table(spark, sf, "events"), F.desc("ts"), "event_id", offset=100).select("event_id", "ts", "event_type")


@query("WITH d AS (SELECT DISTINCT * FROM project_databases), e AS (SELECT DISTINCT project_id, id FROM d WHERE status = 'evicting') SELECT d.project_id, d.id, CASE WHEN e.id IS NULL THEN d.server_id END AS server_id, CASE WHEN e.id IS NULL THEN d.status ELSE 'inactive' END AS status FROM d LEFT JOIN e ON e.project_id = d.project_id AND e.id = d.id WHERE e.id IS NULL OR d.ephemeral = 0")
def evict_databases(spark, sf):
    d = table(spark, sf, "project_databases").distinct()
    return control.evict(d, d.filter("status = 'evicting'")).select("project_id", "id", "server_id", "status")


@query(f"WITH h AS {_SERVERS} SELECT id, hostname, GREATEST(0, database_count - 25) AS database_count FROM h")
def release_clamp(spark, sf):
    s = _servers(spark, sf)
    gone = s.select("id").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(25)))).drop("n")
    return control.release(s, gone).select("id", "hostname", "database_count")


@query("WITH a AS (SELECT DISTINCT ON (id) * FROM servers ORDER BY id, last_heartbeat, database_count), b AS (SELECT DISTINCT ON (id) * FROM servers WHERE status = 'draining' ORDER BY id, last_heartbeat DESC, database_count DESC) SELECT COALESCE(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN a.status ELSE b.status END AS status, COALESCE(b.connection_count, a.connection_count) AS connection_count FROM a FULL JOIN b ON a.id = b.id")
def server_upsert(spark, sf):
    s = table(spark, sf, "servers")
    first = s.groupBy("id").agg(F.min_by(F.struct(*s.columns), F.struct("last_heartbeat", "database_count")).alias("r")).select("r.*")
    later = control.latest(s.filter("status = 'draining'"), ["id"], "last_heartbeat", "database_count")
    return control.upsert(first, later, ["id"], ("connection_count",)).select("id", "status", "connection_count")


@query()
def revenue_by_nation(spark, sf):
    """A plain roll-up, for the bench."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.groupBy("c_nationkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("revenue"), F.count("*").alias("orders"))


SQL["revenue_by_nation"] = "SELECT c_nationkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS revenue, COUNT(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)



