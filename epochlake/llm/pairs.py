"""Texts laid beside each other for pairs of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist

#: Pairs of one text that one task verifies; keys that are broadcast to pick the texts, beyond which they are joined by a shuffle.
HUB_PAIRS, BROADCAST_KEYS = 500, 500_000


def paired_texts(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(a, b, ...) with text_a and text_b: those that texts(key, text) has under these keys, the smallest if several.

    pairs must be at rest (written), as it is read several times. Texts that no pair names aren't moved. A key of many pairs
    is dealt to many tasks, with a copy of its text for each.
    """
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    held = persist(texts.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")))

    def dealt(side: str, other: str, rows: DataFrame) -> DataFrame:
        hubs = pairs.groupBy(side).agg(F.count("*").alias("_n")).filter(F.col("_n") > HUB_PAIRS)
        hubs = persist(hubs.select(F.col(side).alias("_side"), F.ceil(F.col("_n") / HUB_PAIRS).cast("int").alias("_parts")))
        if hubs.count() <= BROADCAST_KEYS:
            hubs = F.broadcast(hubs)
        copies = held.join(hubs, F.col("key") == F.col("_side"), "left").select(F.col("key").alias("_key"), F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part"), F.col("text").alias(f"text_{side}"))
        salted = rows.join(hubs, F.col(side) == F.col("_side"), "left").withColumn("_of", F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts", "_side")
        return salted.join(copies, (F.col(side) == F.col("_key")) & (F.col("_of") == F.col("_part"))).drop("_of", "_part", "_key")

    return dealt("a", "b", dealt("b", "a", pairs))
