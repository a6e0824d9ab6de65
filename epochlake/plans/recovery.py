"""Opening a log directory: migration, input selection, base and delta, the snapshot, and large objects that nothing refers to."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import CATALOG, WAL_PREFIX
from ..functions.versions import key_sid
from ..operators import blobs, changelog, files
from ..sources.directory import BadDirectory, Catalog, Manifest
from ..sources.wal import durable_epoch, read_log
from .maintenance import COMPACTED_SUFFIX, detach, drop_rotated_epoch_files, settle_compaction

BACKUP_SUFFIX = ".back"


def migrate(path: str, manifest_name: str) -> tuple[int, int]:
    """Brings a mounted directory's manifest to the newest format: (version before, version now).

    The new manifest is written as backup first, then in its place, so that one of them is whole at any time; a directory whose
    manifest is missing or damaged takes the backup. BadDirectory if neither can be read, or for a version from the future.
    """
    name = os.path.join(path, manifest_name)

    def load(at: str) -> Manifest | None:
        try:
            with open(at, encoding="utf-8") as f:
                return Manifest.loads(f.read())
        except (OSError, BadDirectory):
            return None

    def store(at: str, manifest: Manifest) -> None:
        with open(f"{at}.tmp", "w", encoding="utf-8") as f:
            f.write(manifest.dumps())
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{at}.tmp", at)

    found, backup = load(name), load(name + BACKUP_SUFFIX)
    if found is None and backup is not None:
        os.replace(name + BACKUP_SUFFIX, name)
        found = backup
    if found is None:
        raise BadDirectory(f"no manifest can be read: {name}")
    fresh, _ = found.migrated()
    if fresh.persistent_format_version > found.persistent_format_version:
        store(name + BACKUP_SUFFIX, fresh)
        store(name, fresh)
    if os.path.exists(name + BACKUP_SUFFIX):
        os.unlink(name + BACKUP_SUFFIX)
    return found.persistent_format_version, fresh.persistent_format_version


def selected_logs(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(base, delta): the compacted files of a mounted directory, and the logs that are in none of them."""
    names = sorted(n for n in os.listdir(path) if n.startswith(WAL_PREFIX) and not n.endswith(".prev"))
    catalog = Catalog.read(path) if os.path.exists(os.path.join(path, CATALOG)) else Catalog()
    base = [n for n in names if n.endswith(COMPACTED_SUFFIX)]
    listing = spark.createDataFrame([(n,) for n in names if n not in base], "name string")
    gone = spark.createDataFrame([(n,) for n in sorted(catalog.detached)], "name string")
    return base, sorted(r.name for r in files.snapshot_inputs(listing, gone).collect())  # names of one directory's files


@dataclass(frozen=True)
class Recovered:
    """What opening a directory finds: the live rows, the newest entries by which objects are kept, and where epochs and ids go on."""

    rows: DataFrame
    kept_blobs: DataFrame
    durable_epoch: int
    max_epoch: int
    max_blob: int

    @property
    def next_blob(self) -> int:
        return self.max_blob + 1


def recover(spark: SparkSession, path: str, manifest_name: str | None = None, epoch: int | None = None) -> Recovered:
    """Opens a mounted log directory and gives its live rows at the durable epoch, or at `epoch`.

    In turn: a compaction that was broken off is ended or undone; the manifest, if it is named, is migrated, and logs of formats
    that are no longer appended to are set aside; epoch files that the newest one replaces are deleted; the compacted file is
    the base, and logs that are not in it are the delta. Only the delta is resolved by versions.
    """
    settle_compaction(path)
    if manifest_name is not None:
        before, now = migrate(path, manifest_name)
        if Manifest(before).migrated()[1] and before < now:
            detach(path)
    durable = durable_epoch(spark, path) if epoch is None else epoch
    drop_rotated_epoch_files(path)
    base, delta = selected_logs(spark, path)
    known = Catalog.read(path).max_blob if os.path.exists(os.path.join(path, CATALOG)) else 0
    log = read_log(spark, path, durable, files=delta)
    if base:
        old = read_log(spark, path, durable, files=base)
        rows = changelog.merge_base(changelog.snapshot(old, durable), log, durable)
        kept = blobs.referenced(changelog.latest(changelog.durable(log, durable))).unionByName(blobs.referenced(old)).distinct()
    else:
        rows = changelog.snapshot(log, durable)
        kept = blobs.referenced(changelog.latest(changelog.durable(log, durable)))
    ends = read_log(spark, path, durable, files=delta, columns=["snippet_epoch", "blob_ids"])
    most = ends.agg(F.greatest(F.coalesce(F.max("snippet_epoch"), F.lit(0)), F.lit(durable)).alias("e"), F.max(F.array_max("blob_ids")).alias("b")).first()
    return Recovered(rows, kept, durable, most.e, max(known, most.b or 0))


def garbage(found: DataFrame, recovered: Recovered) -> DataFrame:
    """(blob_id): files found(blob_id) that may be deleted when a directory is opened: ids given before, which no newest entry holds."""
    return blobs.unreferenced(found, recovered.kept_blobs, recovered.max_blob)


def write_snapshot(rows: DataFrame, to: str, parts: int | None = None) -> None:
    """Writes live rows as Parquet in the order of storage and key, each file with a range of them, so that scans from a key on skip files."""
    keyed = rows.withColumn("_sid", key_sid())
    dealt = keyed.repartitionByRange(parts, "_sid") if parts else keyed.repartitionByRange("_sid")
    dealt.sortWithinPartitions("_sid").drop("_sid").write.parquet(to)


