"""Headline queries over the test tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.functions.values import cut_column
from larkspur.operators import relational as R
from larkspur.plans.dialect import parse
from larkspur.plans.planner import join_condition
from larkspur.session import Engine
from larkspur.sources.generators import bulk_generate, csv_triples
from larkspur.sources.shared import shared_folder
from larkspur.streaming.triples import file_triples, last_per_key

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: The moment that the queries on expiring rows ask about.
NOW = 1_705_276_800

#: Dialect texts; each is its own oracle unless ORACLE says otherwise.
DIALECT = {
    "scan_all": "SELECT * FROM nation",
    "project_cols": "SELECT s_suppkey, s_name FROM supplier",
    "project_alias": "SELECT s_suppkey AS id, s_name AS supplier_name FROM supplier",
    "filter_eq": "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7",
    "filter_lt": "SELECT p_partkey, p_size FROM part WHERE p_size < 5",
    "filter_gt": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45.0",
    "filter_le": "SELECT p_partkey, p_size FROM part WHERE p_size <= 5",
    "filter_ge": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45",
    "filter_int_float_lit": "SELECT COUNT(*) AS cnt FROM lineitem WHERE l_linenumber >= 3.5",
    "filter_float": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0",
    "filter_str_eq": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'",
    "filter_str_range": "SELECT n_name FROM nation WHERE n_name < 'NATION_2'",
    "filter_kind_mismatch": "SELECT COUNT(*) AS cnt FROM orders WHERE o_orderkey = 'x'",
    "filter_null_literal": "SELECT o_orderkey FROM orders WHERE o_orderkey = NULL",
    "filter_qualified": "SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = 10",
    "where_and": "SELECT o_orderkey FROM orders WHERE o_custkey >= 100 AND o_custkey <= 110 AND o_orderstatus = 'F'",
    "where_or": "SELECT o_orderkey FROM orders WHERE o_orderkey = 1 OR o_orderkey = 2 OR o_orderkey = 3",
    "where_mixed": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'P' AND o_totalprice > 400000.0",
    "pk_lookup": "SELECT * FROM orders WHERE o_orderkey = 4242",
    "pk_lookup_miss": "SELECT o_orderkey FROM orders WHERE o_orderkey = -1",
    "count_star": "SELECT COUNT(*) AS cnt FROM lineitem",
    "count_where": "SELECT COUNT(*) AS cnt FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20",
    "count_empty": "SELECT COUNT(*) AS cnt FROM lineitem WHERE l_quantity > 1000000",
    "count_default_name": "SELECT COUNT(*) FROM region",
    "join_inner": "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey",
    "join_project": "SELECT c.c_name AS customer_name, o.o_orderkey AS order_id FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_where": "SELECT c.c_name, o.o_totalprice FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice >= 400000",
    "join_where_or": "SELECT c.c_custkey, o.o_orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 450000.0 OR o.o_orderkey <= 10",
    "join_int_widen": "SELECT s.s_name, n.n_name FROM supplier s INNER JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "join_bigint_int": "SELECT c_name, n_name FROM customer INNER JOIN nation ON c_custkey = n_nationkey",
    "join_int_float": "SELECT o_orderkey, l_linenumber FROM orders INNER JOIN lineitem ON o_custkey = l_quantity",
    "join_varchar": "SELECT a.n_nationkey AS l_key, b.n_nationkey AS r_key FROM nation a INNER JOIN nation b ON a.n_name = b.n_name",
    "join_on_flipped": "SELECT n_name, r_name FROM nation INNER JOIN region ON r_regionkey = n_regionkey",
    "join_alias_as": "SELECT n.n_name, r.r_name FROM nation AS n INNER JOIN region AS r ON n.n_regionkey = r.r_regionkey",
    "self_join": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a INNER JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "join_same_side": "SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON n.n_nationkey = n.n_regionkey",
    "join_select_star": "SELECT * FROM nation INNER JOIN region ON n_regionkey = r_regionkey",
    "join_empty": "SELECT c.c_name, o.o_totalprice FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 900000000",
}


def dialect(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = parse(text)
    names = {r.name for r in (used.table, used.join) if r}
    return lambda spark, sf_dir: Engine.over(spark, sf_dir, *names).sql(text, NOW)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with an expiry in epoch seconds."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("expires_at"))


def _engine_over_events(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine.over(spark, sf_dir, "customer")
    engine.catalog.register("e", _events(spark, sf_dir))
    return engine


def join_int_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("string").alias("k"))
    on = join_condition((nation["n_nationkey"], "int", "n_nationkey"), (region["k"], "str", "k"))
    return R.inner_join(nation, region, on).select("n_nationkey", "k")


def ttl_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine_over_events(spark, sf_dir).sql("SELECT event_id, expires_at FROM e", NOW)


def ttl_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine_over_events(spark, sf_dir).sql("SELECT COUNT(*) AS cnt FROM e", NOW)


def ttl_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine_over_events(spark, sf_dir).sql("SELECT e.event_id, c.c_name FROM e INNER JOIN customer c ON e.user_id = c.c_custkey WHERE e.event_type = 'click'", NOW)


def ttl_purge_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.purge_count(_events(spark, sf_dir), NOW)


def insert_values_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.exec("CREATE TABLE ship (hull INT PRIMARY KEY, name VARCHAR(12), draught FLOAT, port TEXT); INSERT INTO ship VALUES (7, 'Grey Heron', 4.25, 'Leith'), (3, 'Tern', 2, 'Cádiz'); INSERT INTO ship VALUES (5, 'a name far too long', -0.5, NULL)")
    return engine.sql("SELECT * FROM ship")


def null_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.exec("CREATE TABLE t (id INT, v INT, f FLOAT, n VARCHAR(3)); INSERT INTO t VALUES (1, NULL, NULL, NULL)")
    return engine.sql("SELECT * FROM t")


def _durable(spark: SparkSession) -> Engine:
    return Engine(spark, shared_folder(spark, "warehouse"))


def _reopened(engine: Engine) -> Engine:
    """Another engine over the same warehouse, which knows only what the log tells."""
    return Engine(engine.spark, engine.catalog.warehouse)


def insert_replay_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders through a durable, key-checked INSERT, read after the log was replayed."""
    engine = _durable(spark)
    engine.exec("CREATE TABLE o (o_orderkey DECIMAL PRIMARY KEY, o_custkey INT, o_totalprice FLOAT, o_orderpriority VARCHAR(6))")
    engine.catalog.insert_frame("o", spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))
    return _reopened(engine).sql("SELECT * FROM o")


def purge_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a purge leaves of all events, read at a time when none had expired."""
    engine = _durable(spark)
    engine.exec("CREATE TABLE e (event_id INT, event_type TEXT, expires_at DATETIME)")
    engine.catalog.insert_frame("e", _events(spark, sf_dir).select("event_id", "event_type", "expires_at"))
    engine.maintain(now=NOW)
    return _reopened(engine).sql("SELECT * FROM e", now=0)


def compact_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as two statements, rewritten as one batch."""
    engine = _durable(spark)
    engine.exec("CREATE TABLE party (name VARCHAR(32), nation INT, balance FLOAT)")
    for table, p in (("customer", "c"), ("supplier", "s")):
        engine.catalog.insert_frame("party", spark.read.parquet(f"{sf_dir}/{table}.parquet").select(f"{p}_name", f"{p}_nationkey", f"{p}_acctbal"))
    engine.catalog.compact(engine.catalog.get("party"))
    return _reopened(engine).sql("SELECT * FROM party")


def drop_create_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table dropped and made again with other columns, after replay."""
    engine = _durable(spark)
    engine.exec("CREATE TABLE r (a TEXT); INSERT INTO r VALUES ('x'); DROP TABLE R; DROP TABLE IF EXISTS r; CREATE TABLE r (k INT PRIMARY KEY NOT NULL, name VARCHAR(4))")
    engine.catalog.insert_frame("r", spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name"))
    return _reopened(engine).sql("SELECT * FROM r")


def bulk_users_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows and one INSERT whose fraction that table drops, after replay."""
    engine = _durable(spark)
    engine.exec("CREATE TABLE BIG_USERS (ID DECIMAL, NAME VARCHAR(64), EMAIL VARCHAR(64), BALANCE DECIMAL, EXPIRES_AT DECIMAL); BULK_INSERT BIG_USERS 1 5000; INSERT INTO BIG_USERS VALUES (-1, 'me', 'me@here', 12.9, 1893456000)")
    return _reopened(engine).sql("SELECT ID, NAME, EMAIL, BALANCE, EXPIRES_AT FROM BIG_USERS", NOW)


def join_float_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles join texts by how they are rendered."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    sizes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").cast("string").alias("k")).distinct()
    return R.inner_join(lines, sizes, join_condition((lines["l_quantity"], "float", "l_quantity"), (sizes["k"], "str", "k"))).select("l_orderkey", "k")


def varchar_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", cut_column(F.col("p_name"), 5).alias("nm"))


def pk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pk_violations(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select(F.concat_ws(",", "o_custkey", "o_orderkey", F.lit("7\n")).alias("value"))


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_triples(_order_lines(spark, sf_dir)).select(F.col("key").cast("long").alias("key"), "val1", "val2")


def csv_file_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long file per customer whose lines cut triples: two fields, then four, and so on."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first, second = (F.concat_ws(",", *c) for c in (("o_orderkey", "o_custkey"), (F.lit(9), "o_orderkey", "o_custkey", F.lit("8"))))
    lines = rows.select(F.explode(F.array(F.struct(F.lit(0).alias("n"), first.alias("value")), F.struct(F.lit(1).alias("n"), second.alias("value")))).alias("x"), "o_custkey", "o_orderkey")
    placed = lines.select("x.value", F.col("o_custkey").alias("file"), F.floor(F.col("o_orderkey") / 1000).alias("block"), (F.col("o_orderkey") * 2 + F.col("x.n")).alias("line"))
    return file_triples(placed).select(F.col("key").cast("long").alias("key"), "val1", "val2")


def csv_last_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_per_key(csv_triples(_order_lines(spark, sf_dir)).withColumn("seq", F.col("val1")), "seq").select(F.col("key").cast("long").alias("key"), "val1", "val2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: dialect(t) for k, t in DIALECT.items()} | {
        "join_int_text": join_int_text,
        "ttl_filter": ttl_filter,
        "ttl_count": ttl_count,
        "ttl_join": ttl_join,
        "ttl_purge_count": ttl_purge_count,
        "bulk_generate": lambda spark, sf_dir: bulk_generate(spark, 1, 20_000),
        "insert_values_roundtrip": insert_values_roundtrip,
        "insert_replay_roundtrip": insert_replay_roundtrip,
        "purge_roundtrip": purge_roundtrip,
        "compact_roundtrip": compact_roundtrip,
        "drop_create_roundtrip": drop_create_roundtrip,
        "bulk_users_roundtrip": bulk_users_roundtrip,
        "join_float_text": join_float_text,
        "csv_file_triples": csv_file_triples,
        "null_defaults": null_defaults,
        "varchar_truncate": varchar_truncate,
        "pk_violations": pk_violations,
        "csv_triples": csv_rows,
        "csv_last_per_key": csv_last_per_key,
    }


_EVENTS = "(SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS expires_at FROM events) e"
ORACLE = {
    "filter_kind_mismatch": "SELECT CAST(0 AS BIGINT) AS cnt",
    "count_default_name": 'SELECT COUNT(*) AS "COUNT(*)" FROM region',
    "join_int_text": "SELECT n_nationkey, k FROM nation INNER JOIN (SELECT CAST(r_regionkey AS VARCHAR) AS k FROM region) t ON CAST(n_nationkey AS VARCHAR) = k",
    "ttl_filter": f"SELECT event_id, expires_at FROM {_EVENTS} WHERE expires_at >= {NOW}",
    "ttl_count": f"SELECT COUNT(*) AS cnt FROM {_EVENTS} WHERE expires_at >= {NOW}",
    "ttl_join": f"SELECT e.event_id, c.c_name FROM {_EVENTS} INNER JOIN customer c ON e.user_id = c.c_custkey WHERE e.expires_at >= {NOW} AND e.event_type = 'click'",
    "ttl_purge_count": f"SELECT COUNT(*) AS removed FROM {_EVENTS} WHERE expires_at < {NOW}",
    "bulk_generate": "SELECT range AS id, 'user' || range AS name, 'user' || range || '@mail.com' AS email, 1000 + range % 10000 AS balance, CAST(1893456000 AS BIGINT) AS expires_at FROM range(1, 20001)",
    "insert_values_roundtrip": "SELECT * FROM (VALUES (7::BIGINT, 'Grey Heron', 4.25::DOUBLE, 'Leith'), (3, 'Tern', 2, 'Cádiz'), (5, 'a name far t', -0.5, '')) t(hull, name, draught, port)",
    "insert_replay_roundtrip": "SELECT o_orderkey, o_custkey, o_totalprice, substr(o_orderpriority, 1, 6) AS o_orderpriority FROM orders",
    "purge_roundtrip": f"SELECT event_id, event_type, expires_at FROM {_EVENTS} WHERE expires_at >= {NOW}",
    "compact_roundtrip": "SELECT c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier",
    "drop_create_roundtrip": "SELECT CAST(r_regionkey AS BIGINT) AS k, substr(r_name, 1, 4) AS name FROM region",
    "bulk_users_roundtrip": "SELECT range AS ID, 'user' || range AS NAME, 'user' || range || '@mail.com' AS EMAIL, 1000 + range % 10000 AS BALANCE, CAST(1893456000 AS BIGINT) AS EXPIRES_AT FROM range(1, 5001) UNION ALL SELECT -1, 'me', 'me@here', 12, 1893456000",
    "join_float_text": "SELECT l_orderkey, k FROM lineitem INNER JOIN (SELECT DISTINCT CAST(p_size AS VARCHAR) AS k FROM part) t ON printf('%.15g', l_quantity) = k",
    "csv_file_triples": "SELECT o_orderkey AS key, o_custkey AS val1, CAST(9 AS BIGINT) AS val2 FROM orders UNION ALL SELECT o_orderkey, o_custkey, 8 FROM orders",
    "null_defaults": "SELECT 1::BIGINT AS id, 0::BIGINT AS v, 0::DOUBLE AS f, '' AS n",
    "varchar_truncate": "SELECT p_partkey, substr(p_name, 1, 5) AS nm FROM part",
    "pk_violations": "SELECT l_orderkey, COUNT(*) AS cnt FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1",
    "csv_triples": "SELECT o_custkey AS key, o_orderkey AS val1, CAST(7 AS BIGINT) AS val2 FROM orders",
    "csv_last_per_key": "SELECT o_custkey AS key, max(o_orderkey) AS val1, CAST(7 AS BIGINT) AS val2 FROM orders GROUP BY o_custkey",
}


def oracle_sql() -> dict[str, str]:
    return DIALECT | ORACLE
