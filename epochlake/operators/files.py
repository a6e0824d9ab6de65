"""Which files of a log directory a job reads, and what a backup copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ACTIVE_WAL_LENGTH, CATALOG, COMPACTED, EPOCH, MANIFEST_SUFFIX, is_blob_name, is_detached, is_epoch_file, is_wal


def snapshot_inputs(files: DataFrame, detached: DataFrame) -> DataFrame:
    """files(name) from which a snapshot's delta is read: all but the catalog, the compacted file and those compacted already."""
    return files.filter(~F.col("name").isin(CATALOG, COMPACTED)).join(detached.select("name"), "name", "left_anti")


def compaction_inputs(files: DataFrame, detached: DataFrame) -> DataFrame:
    """files(name) that a compaction reads: logs that are rotated or compacted, and not compacted before."""
    return files.filter(is_detached("name")).join(detached.select("name"), "name", "left_anti")


def detached_still_there(detached: DataFrame, files: DataFrame) -> DataFrame:
    """Names of a catalog that lie on disk still; the others are forgotten."""
    return detached.join(files.select("name"), "name", "left_semi")


def epoch_files(files: DataFrame) -> DataFrame:
    return files.filter(is_epoch_file("name"))


def backup_files(logs: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path) of a full backup: log files and blob files, each once."""
    return logs.select("path").unionByName(blobs.select("path")).distinct()


def backup_entries(files: DataFrame) -> DataFrame:
    """(path, destination, is_mutable, is_detached) of a detailed backup of files(name, path).

    Rotated logs and epoch files, the catalog and the blobs don't change any more; the manifest may. Logs and epoch files that
    are still written to, and files of other kinds, are left out.
    """
    name = F.col("name")
    manifest = name.endswith(MANIFEST_SUFFIX)
    fixed = is_wal("name") & (F.length(name) != ACTIVE_WAL_LENGTH) | name.startswith(EPOCH) & (F.length(name) > len(EPOCH)) | (name == CATALOG) | is_blob_name("name")
    return files.filter(manifest | fixed).select("path", name.alias("destination"), manifest.alias("is_mutable"), F.lit(False).alias("is_detached"))
