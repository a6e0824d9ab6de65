"""Which large objects a log still refers to, and which files of them may be deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import base_name, blob_id_of, is_blob_name
from ..functions.versions import unsigned, version, version_at
from .changelog import durable, latest, snapshot


def referenced(rows: DataFrame) -> DataFrame:
    """(blob_id): the distinct ids in blob_ids. Null and empty lists refer to nothing."""
    return rows.select(F.explode("blob_ids").alias("blob_id")).filter("blob_id is not null").distinct()


def ids_in_order(rows: DataFrame, *group: str) -> DataFrame:
    """(*group, blob_ids): the distinct ids of each group's rows, in unsigned order. For groups whose ids fit in one row."""
    each = rows.select(*group, F.explode("blob_ids").alias("id")).filter("id is not null")
    return each.groupBy(*group).agg(F.transform(F.array_sort(F.collect_set(unsigned("id"))), unsigned).alias("blob_ids"))


def max_blob_id(log: DataFrame, known: int = 0) -> DataFrame:
    """(max_blob_id): the largest id that any entry names, `known` at least; by it new ids are given. Unsigned order."""
    most = log.select(F.array_max(F.transform("blob_ids", unsigned)).alias("m")).agg(F.max("m").alias("m"))
    return most.select(unsigned(F.greatest(F.coalesce("m", unsigned(F.lit(0).cast("long"))), unsigned(F.lit(known).cast("long")))).alias("max_blob_id"))


def blob_files(files: DataFrame) -> DataFrame:
    """(blob_id, path) of the files(path) that are named as blobs are; others are left out."""
    name = base_name("path")
    return files.filter(is_blob_name(name)).select(blob_id_of(name).alias("blob_id"), "path")


def unreferenced(found: DataFrame, exempt: DataFrame, most: int) -> DataFrame:
    """(blob_id): ids of found(blob_id) up to `most`, itself included, that exempt(blob_id) doesn't hold, each once. Ids above
    `most` came after the snapshot was pinned and are let be."""
    candidates = found.select("blob_id").filter(unsigned("blob_id") <= unsigned(F.lit(most).cast("long")))
    return candidates.join(exempt.select("blob_id"), "blob_id", "left_anti").distinct()


def gc_at_startup(log: DataFrame, epoch: int, found: DataFrame, most: int) -> DataFrame:
    """Deletable ids when a log is opened: those that no newest entry refers to. Range deletes are ignored here, so that rows
    which they ended hold on to their objects until a compaction."""
    return unreferenced(found, referenced(latest(durable(log, epoch))), most)


def gc_exempt(log: DataFrame, boundary: tuple[int, int]) -> DataFrame:
    """(blob_id) that a compaction must keep: of puts with objects below the boundary version, those of each key's newest; and
    those of all at or above it, for readers may still see any of them. Later puts without objects and removes release
    nothing in the same pass."""
    puts = log.filter(F.col("entry_type") == "normal_with_blob")
    low = version() < version_at(*boundary)
    return referenced(latest(puts.filter(low))).unionByName(referenced(puts.filter(~low))).distinct()


def gc_at_compaction(log: DataFrame, epoch: int, boundary: tuple[int, int], found: DataFrame, most: int, compacted_epoch: int = 0) -> DataFrame:
    """Deletable ids at a compaction. None while the boundary is not beyond the epoch of the last one."""
    gone = unreferenced(found, gc_exempt(durable(log, epoch), boundary), most)
    return gone if boundary[0] > compacted_epoch else gone.limit(0)


def gc_exact(log: DataFrame, epoch: int, found: DataFrame, most: int) -> DataFrame:
    """Deletable ids if nobody reads anything but the live snapshot: more than the other two find."""
    return unreferenced(found, referenced(snapshot(log, epoch)), most)


def available(wanted: DataFrame, found: DataFrame, next_id: int) -> DataFrame:
    """wanted(blob_id, ...) whose file exists and whose id has been given already."""
    return wanted.filter(unsigned("blob_id") < unsigned(F.lit(next_id).cast("long"))).join(found.select("blob_id"), "blob_id", "left_semi")


def settle_pool(provisional: DataFrame, persistent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(released, left): provisional(blob_id) ids that no entry has made persistent, so their files go; and the persistent
    ones that this didn't consume."""
    released = provisional.join(persistent.select("blob_id"), "blob_id", "left_anti")
    left = persistent.join(provisional.select("blob_id"), "blob_id", "left_anti")
    return released, left
