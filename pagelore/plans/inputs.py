"""Key relations derived from the driver tables, and the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators.keys import ordinal, ranked
from pagelore.runtime import table

#: Microseconds since the epoch, whatever the session's time zone.
MICROS = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

SQL = {
    "events_keys": "events_keys AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::BIGINT AS pos FROM (SELECT DISTINCT epoch_us(ts) AS key FROM events))",
    "orders_keys": "orders_keys AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::BIGINT AS pos FROM (SELECT DISTINCT o_orderkey AS key FROM orders))",
    "price_keys": "price_keys AS (SELECT key, (row_number() OVER (ORDER BY key) - 1)::BIGINT AS pos FROM (SELECT DISTINCT round(o_totalprice * 100)::BIGINT AS key FROM orders))",
    "event_probes": "event_probes AS (SELECT event_id AS query_idx, epoch_us(ts) + event_id % 2 AS key FROM events)",
    "line_probes": "line_probes AS (SELECT (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1)::BIGINT AS row_id, l_orderkey AS key FROM lineitem)",
    "event_ranges": "event_ranges AS (SELECT event_id AS query_idx, epoch_us(ts) AS lo, epoch_us(ts) + (event_id * 7919 % 97) * 600000000 AS hi FROM events)",
}


def micros(df: DataFrame):
    return df.select("*", F.expr(MICROS).cast("bigint").alias("key"))


def events_keys(spark: SparkSession, d: str) -> DataFrame:
    return ranked(micros(table(spark, d, "events").select("ts")).select("key"))


def orders_keys(spark, d):
    return ranked(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")))


def price_keys(spark, d):
    return ranked(table(spark, d, "orders").select(F.round(F.col("o_totalprice") * 100).cast("bigint").alias("key")))


def event_probes(spark, d):
    """Every key; those of odd events one off, so that they miss."""
    return micros(table(spark, d, "events").select("event_id", "ts")).select(F.col("event_id").alias("query_idx"), (F.col("key") + F.col("event_id") % 2).alias("key"))


def line_probes(spark, d):
    return ordinal(table(spark, d, "lineitem").select(*LINE_ORDER), LINE_ORDER, "row_id").select("row_id", F.col("l_orderkey").alias("key"))


def event_ranges(spark, d):
    e = micros(table(spark, d, "events").select("event_id", "ts"))
    return e.select(F.col("event_id").alias("query_idx"), F.col("key").alias("lo"), (F.col("key") + (F.col("event_id") * 7919 % 97) * 600_000_000).alias("hi"))
