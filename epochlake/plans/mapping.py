"""Ordinary tables as change logs: events, and orders with their line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changelog import max_appeared_epoch

#: Events of an epoch, and epochs at the end of the log that are not durable.
EPOCH_EVENTS, TAIL_EPOCHS = 100, 5

#: The same in SQL, as common table expressions that queries can go on from: log, and ld with the durable epoch e.
EVENTS_SQL = f"""
log AS (
  SELECT event_id % 4 AS channel, event_id AS seq,
    CAST(floor(event_id / {EPOCH_EVENTS}.0) AS BIGINT) + 1 AS snippet_epoch, CAST(floor(event_id / {EPOCH_EVENTS}.0) AS BIGINT) + 1 AS major,
    (event_id * 37) % 100 AS minor, user_id % 8 AS storage_id, user_id * 20 + event_id % 20 AS key,
    CASE WHEN event_id % 397 = 0 THEN 'clear_storage' WHEN event_type = 'error' THEN 'remove_entry'
      WHEN event_type = 'purchase' THEN 'normal_with_blob' ELSE 'normal_entry' END AS entry_type,
    value, event_id * 2 AS blob_a, event_id * 2 + 1 AS blob_b
  FROM events),
ld AS (SELECT max(snippet_epoch) - {TAIL_EPOCHS} AS e FROM log)"""


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log made from events, with the channel and seq of each entry; every 397th event clears its storage."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")
    epoch = (F.floor(F.col("event_id") / EPOCH_EVENTS) + 1).cast("long")
    kind = (
        F.when(F.col("event_id") % 397 == 0, "clear_storage").when(F.col("event_type") == "error", "remove_entry").when(F.col("event_type") == "purchase", "normal_with_blob").otherwise("normal_entry")
    )
    blobs = F.when(kind == "normal_with_blob", F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 1)).otherwise(F.array().cast("array<bigint>"))
    return e.select(
        (F.col("event_id") % 4).alias("channel"),
        F.col("event_id").alias("seq"),
        epoch.alias("snippet_epoch"),
        epoch.alias("major"),
        ((F.col("event_id") * 37) % 100).alias("minor"),
        (F.col("user_id") % 8).alias("storage_id"),
        (F.col("user_id") * 20 + F.col("event_id") % 20).alias("key"),
        kind.alias("entry_type"),
        "value",
        blobs.alias("blob_ids"),
    )


def durable_epoch_of(log: DataFrame) -> int:
    """The durable epoch of the mapped log: its last epochs are not."""
    return max_appeared_epoch(log).first()[0] - TAIL_EPOCHS


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a change log: an entry of the order's price on its date, then one for each line item, with its price, on the day
    it is shipped. An epoch is a day since 1970; a returned item removes the order."""
    day = lambda c: F.unix_date(F.to_date(c)).cast("long")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    placed = o.select(F.col("o_orderkey").alias("key"), day("o_orderdate").alias("snippet_epoch"), F.lit(0).cast("long").alias("minor"), F.lit("normal_entry").alias("entry_type"), F.col("o_totalprice").alias("value"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kind = F.when(F.col("l_returnflag") == "R", "remove_entry").otherwise("normal_entry")
    shipped = li.select(F.col("l_orderkey").alias("key"), day("l_shipdate").alias("snippet_epoch"), F.col("l_linenumber").cast("long").alias("minor"), kind.alias("entry_type"), F.col("l_extendedprice").alias("value"))
    both = placed.unionByName(shipped)
    return both.select((F.col("key") % 8).alias("storage_id"), "key", "snippet_epoch", F.col("snippet_epoch").alias("major"), "minor", "entry_type", "value")


ORDERS_SQL = """
olog AS (
  SELECT o_orderkey AS key, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS major, CAST(0 AS BIGINT) AS minor, 'normal_entry' AS entry_type, o_totalprice AS value FROM orders
  UNION ALL
  SELECT l_orderkey, CAST(epoch(l_shipdate) / 86400 AS BIGINT), CAST(l_linenumber AS BIGINT), CASE WHEN l_returnflag = 'R' THEN 'remove_entry' ELSE 'normal_entry' END, l_extendedprice FROM lineitem)"""
