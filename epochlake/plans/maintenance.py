"""Jobs on whole log directories: inspect, repair, compact, back up, restore, rotate, collect large objects.

What a job decides comes from DataFrames; files are then moved or written on paths that the driver and all nodes mount. Repairs
are only ever made to a copy.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import ACTIVE_WAL_LENGTH, BLOB_DIRECTORIES, EPOCH, MANIFEST_SUFFIX, WAL_PREFIX, blob_path
from ..functions.versions import key_sid
from ..operators import blobs, changelog
from ..schema import PARSE_CODES
from ..sources.blob_store import stored_files
from ..sources.directory import BadDirectory, Catalog, Manifest
from ..sources.wal import append_durable, durable_epoch, read_log, register, scan_reports
from ..sources.wal_format import repaired

COMPACTED_SUFFIX, PENDING = ".compacted", "compaction_pending"
#: A file by which an online compaction is asked for.
REQUEST = os.path.join("ctrl", "start_compaction")

# Exit codes of inspections and repairs.
OK, AUTO_REPAIRABLE, UNREPAIRABLE, REPAIR_FAILED = 0, 1, 2, 16


def inspect(spark: SparkSession, path: str, epoch: int | None = None) -> DataFrame:
    """(durable_epoch, max_appeared_epoch, count_durable_wal_entries, status, rc) of a directory, one row.

    epoch takes the place of the durable one for deciding what counts. Entries that are counted are ordinary puts and removes.
    A directory without logs is OK.
    """
    durable = durable_epoch(spark, path)
    bound = durable if epoch is None else epoch
    worst = F.coalesce(F.max("parse_code"), F.lit(0))
    summed = scan_reports(spark, path, bound).agg(F.greatest(F.coalesce(F.max("max_epoch"), F.lit(0)), F.lit(bound)).cast("long").alias("max_appeared_epoch"), F.coalesce(F.sum("counted"), F.lit(0)).alias("count_durable_wal_entries"), worst.alias("code"))
    fine, mendable = F.col("code") == PARSE_CODES["ok"], F.col("code").isin(*[PARSE_CODES[c] for c in ("broken_after", "broken_after_marked", "nondurable_entries")])
    status = F.when(fine, "OK").when(mendable, "auto-repairable").otherwise("unrepairable")
    rc = F.when(fine, OK).when(mendable, AUTO_REPAIRABLE).otherwise(UNREPAIRABLE)
    return summed.select(F.lit(durable).cast("long").alias("durable_epoch"), "max_appeared_epoch", "count_durable_wal_entries", status.alias("status"), rc.alias("rc"))


def repair_plan(spark: SparkSession, path: str, epoch: int | None = None, cut: bool = False) -> DataFrame:
    """scan_report with the repairs of each log file, all set aside first, by marking or, for damaged tails, cutting."""
    return scan_reports(spark, path, epoch, "cut" if cut else "mark", assume_detached=True)


def repair(spark: SparkSession, path: str, to: str, epoch: int | None = None, cut: bool = False, now: int | None = None) -> tuple[str, int]:
    """Copies a directory to a new one, its logs set aside and mended: (status, rc). The original is not touched.

    Each file is copied and mended by the task that has it; only files with repairs are read whole.
    """
    plan = repair_plan(spark, path, epoch, cut).select("file", "parse_code", "repairs").persist()
    millis = int(time.time() * 1000) if now is None else now
    shutil.copytree(path, to, ignore=lambda d, names: [n for n in names if d == path and n.startswith(WAL_PREFIX)])

    def apply(rows) -> None:
        for r in rows:
            target = os.path.join(to, r.file if len(r.file) > ACTIVE_WAL_LENGTH else f"{r.file}.{millis:014d}.0")
            part = os.path.join(to, f".writing-{uuid.uuid4().hex}")  # another attempt of the task has another one
            if not r.repairs:
                shutil.copyfile(os.path.join(path, r.file), part)
            else:
                with open(os.path.join(path, r.file), "rb") as f:
                    data = repaired(f.read(), [(x.offset, x.action) for x in r.repairs])
                with open(part, "wb") as f:
                    f.write(data)
            os.replace(part, target)

    plan.foreachPartition(apply)
    code = plan.agg(F.coalesce(F.max("parse_code"), F.lit(0))).first()[0]
    plan.unpersist()
    if code == PARSE_CODES["ok"]:
        return "OK", OK
    if code in (PARSE_CODES["repaired"], PARSE_CODES["broken_after_marked"]):
        return "repaired", OK
    return "unrepairable", REPAIR_FAILED


def detach(path: str, skip_empty: bool = False, now: int | None = None) -> list[str]:
    """Sets all active logs of a directory aside, by a new name with the time; the new names."""
    millis, out = int(time.time() * 1000) if now is None else now, []
    for name in sorted(os.listdir(path)):
        if not name.startswith(WAL_PREFIX) or len(name) > ACTIVE_WAL_LENGTH or skip_empty and not os.path.getsize(os.path.join(path, name)):
            continue
        n = 0
        while os.path.exists(os.path.join(path, f"{name}.{millis:014d}.{n}")):
            n += 1
        os.rename(os.path.join(path, name), os.path.join(path, f"{name}.{millis:014d}.{n}"))
        out.append(f"{name}.{millis:014d}.{n}")
    return out


def rotate(path: str, epoch: int, now: int | None = None) -> list[str]:
    """Renames active logs and the epoch file, with the time and the epoch; a new epoch file starts with the durable epoch."""
    millis, out = int(time.time() * 1000) if now is None else now, []
    for name in sorted(os.listdir(path)):
        if name == EPOCH or name.startswith(WAL_PREFIX) and len(name) == ACTIVE_WAL_LENGTH:
            os.rename(os.path.join(path, name), os.path.join(path, f"{name}.{millis:014d}.{epoch}"))
            out.append(f"{name}.{millis:014d}.{epoch}")
    append_durable(path, epoch)
    return out


def drop_rotated_epoch_files(path: str) -> list[str]:
    """Deletes rotated epoch files, if the epoch file itself has an epoch."""
    main = os.path.join(path, EPOCH)
    if not os.path.exists(main) or not os.path.getsize(main):
        return []
    gone = [n for n in os.listdir(path) if n.startswith(EPOCH) and n != EPOCH]
    for n in gone:
        os.unlink(os.path.join(path, n))
    return gone


def write_compacted(rows: DataFrame, path: str, parts: int = 1) -> list[str]:
    """Writes live rows, in the order of their keys, as compacted files of the log format: one, as other readers of the format
    expect, or several, each with a range of keys. Readers of this library take any number."""
    register(rows.sparkSession)
    keyed = rows.withColumn("_sid", key_sid())
    # by a shuffle even for one file, so that the rows are resolved by many tasks and only written by one
    dealt = (keyed.repartition(1) if parts == 1 else keyed.repartitionByRange(parts, "_sid")).sortWithinPartitions("_sid").drop("_sid")
    os.makedirs(path, exist_ok=True)
    dealt.write.format("epochlog").mode("append").option("suffix", ".compacted").save(path)
    return sorted(n for n in os.listdir(path) if n.endswith(".compacted"))


def compact_directory(spark: SparkSession, path: str, to: str, epoch: int | None = None, parts: int = 1) -> Catalog:
    """Writes a compacted directory: the live rows at an epoch, with an epoch file of it and a catalog. The original stays."""
    durable = durable_epoch(spark, path) if epoch is None else epoch
    log = read_log(spark, path, durable)
    max_blob = blobs.max_blob_id(log).first()[0]
    names = write_compacted(changelog.compact(log, durable), to, parts)
    append_durable(to, durable)
    for n in os.listdir(path):
        if n.endswith(MANIFEST_SUFFIX):
            shutil.copyfile(os.path.join(path, n), os.path.join(to, n))
    catalog = Catalog(durable, max_blob, dict.fromkeys(names, 1))
    catalog.write(to)
    return catalog


def compact_offline(spark: SparkSession, path: str, epoch: int | None = None, parts: int = 1, work_dir: str | None = None, dry_run: bool = False, backup: bool = False, confirm: Callable[[str], bool] | None = None) -> Catalog | None:
    """Puts a compacted directory in the place of a mounted one; its catalog, or None if `confirm`, asked with the working folder, says no.

    The compacted directory is made beside the old one, or in `work_dir`, and takes its name when it is whole. With dry_run it
    is made and thrown away; with backup the old one stays under another name. A link in the directory's place is refused.
    """
    path = path.rstrip("/")
    if os.path.islink(path):
        raise BadDirectory(f"{path} is a link")
    beside = f"{path}.{int(time.time() * 1000):014d}"
    work = work_dir or f"{beside}.work"
    if os.path.isdir(work) and os.listdir(work):
        raise BadDirectory(f"{work} isn't empty")
    if confirm is not None and not confirm(work):
        return None
    try:
        catalog = compact_directory(spark, path, work, epoch, parts)
    except BaseException:
        shutil.rmtree(work, ignore_errors=True)
        raise
    if dry_run:
        shutil.rmtree(work)
        return catalog
    os.rename(path, f"{beside}.backup")
    os.rename(work, path)
    if not backup:
        shutil.rmtree(f"{beside}.backup")
    return catalog


def settle_compaction(path: str) -> None:
    """Ends or undoes an online compaction that was broken off: the catalog says whether the new compacted files count."""
    pending = os.path.join(path, PENDING)
    if not os.path.exists(pending):
        return
    with open(pending, encoding="utf-8") as f:
        token, epoch, *new = f.read().split()
    done = Catalog.read(path)
    before = [n for n in os.listdir(path) if n.endswith(f"{COMPACTED_SUFFIX}.prev")]
    if done.max_epoch == int(epoch) and set(done.files) == set(new):
        for n in before:
            os.unlink(os.path.join(path, n))
    else:
        for n in new:
            if os.path.exists(os.path.join(path, n)) and (f"{n}.prev" in before or n not in done.files):
                os.unlink(os.path.join(path, n))
        for n in before:
            os.replace(os.path.join(path, n), os.path.join(path, n.removesuffix(".prev")))
    shutil.rmtree(os.path.join(path, f"compaction_temp-{token}"), ignore_errors=True)
    os.unlink(pending)


def compact_online(spark: SparkSession, path: str, epoch: int, now: int | None = None, parts: int = 1, boundary: tuple[int, int] | None = None, blob_root: str | None = None) -> bool:
    """Rotates a directory's logs and merges those not compacted yet, with the compacted file, into a new one. False if there is
    nothing to do.

    The old compacted file stays until the catalog names the new one; settle_compaction, which is called first, ends or undoes
    what was broken off at any step. With a version boundary beyond the last compaction's epoch, and the folder of large
    objects, those that no reader can see any more are deleted at the end.
    """
    settle_compaction(path)
    catalog = Catalog.read(path)
    rotate(path, epoch, now)
    names = set(os.listdir(path))
    wanted = {n for n in names if n.startswith(WAL_PREFIX) and len(n) > ACTIVE_WAL_LENGTH and not n.endswith(".prev")} - catalog.detached
    if not wanted or wanted <= {n for n in names if n.endswith(COMPACTED_SUFFIX)}:
        return False
    log = read_log(spark, path, epoch, files=sorted(wanted))
    max_blob = max(catalog.max_blob, blobs.max_blob_id(read_log(spark, path, epoch, files=sorted(wanted), columns=["blob_ids"])).first()[0])
    gone = None
    if boundary is not None and blob_root is not None and boundary[0] > catalog.max_epoch:
        found = blobs.blob_files(stored_files(spark, blob_root))
        gone = blobs.gc_at_compaction(log, epoch, boundary, found, max_blob, catalog.max_epoch)
    token = uuid.uuid4().hex[:12]
    fresh = os.path.join(path, f"compaction_temp-{token}")
    written = write_compacted(changelog.compact(log, epoch), fresh, parts)
    if gone is not None:
        delete_blobs(gone, blob_root)  # decided by the logs, which are all still there
    with open(os.path.join(path, PENDING), "w", encoding="utf-8") as f:
        f.write(" ".join([token, str(epoch), *written]))
        f.flush()
        os.fsync(f.fileno())
    old = [n for n in names if n.endswith(COMPACTED_SUFFIX)]
    for n in old:
        os.replace(os.path.join(path, n), os.path.join(path, f"{n}.prev"))
    for n in written:
        os.replace(os.path.join(fresh, n), os.path.join(path, n))
    done = (catalog.detached & names) | (wanted - set(old))
    Catalog(epoch, max_blob, dict.fromkeys(written, 1), done).write(path)
    settle_compaction(path)
    return True


def request_compaction(path: str) -> None:
    """Asks whoever has a mounted directory open for an online compaction."""
    os.makedirs(os.path.join(path, os.path.dirname(REQUEST)), exist_ok=True)
    with open(os.path.join(path, REQUEST), "w", encoding="utf-8"):
        pass


def compact_if_asked(spark: SparkSession, path: str, epoch: int, **options) -> bool:
    """An online compaction if one was asked for; the request is taken back first, so that a later one counts anew."""
    try:
        os.unlink(os.path.join(path, REQUEST))
    except FileNotFoundError:
        return False
    return compact_online(spark, path, epoch, **options)


def delete_detached(path: str) -> list[str]:
    """Deletes logs that the catalog says are in the compacted file."""
    gone = sorted(n for n in Catalog.read(path).detached if os.path.exists(os.path.join(path, n)))
    for n in gone:
        os.unlink(os.path.join(path, n))
    return gone


def delete_blobs(ids: DataFrame, root: str) -> None:
    """Deletes the files of ids(blob_id) below a mounted folder, those of a folder by one task; missing ones are no error."""

    def run(rows) -> None:
        for r in rows:
            try:
                os.unlink(os.path.join(root, r.path))
            except FileNotFoundError:
                pass

    # by a number of tasks, as Spark would leave ids, which are short rows, to one
    tasks = min(BLOB_DIRECTORIES, 4 * ids.sparkSession.sparkContext.defaultParallelism)
    ids.select(blob_path("blob_id").alias("path")).repartition(tasks, F.substring("path", 1, 6)).foreachPartition(run)


def restore(source: str, to: str, entries: list[tuple[str, str]] | None = None, keep_source: bool = True) -> None:
    """Copies a backup into an empty directory: a whole one, or entries of (path, relative to source, destination).

    Refused (BadDirectory) without a manifest of a version that can be read, where a file is missing, and for a destination
    outside `to`.
    """
    if entries is None:
        entries = [(os.path.relpath(os.path.join(d, n), source),) * 2 for d, _, names in os.walk(source) for n in names]
    pairs = [(os.path.join(source, a), b) for a, b in entries]
    if not any(b.endswith(MANIFEST_SUFFIX) for _, b in pairs):
        raise BadDirectory("no manifest in the backup")
    root = os.path.realpath(to)
    for a, b in pairs:
        if not os.path.isfile(a):
            raise BadDirectory(f"not found: {a}")
        if os.path.commonpath([root, os.path.realpath(os.path.join(to, b))]) != root:
            raise BadDirectory(f"outside of the directory: {b}")
        if b.endswith(MANIFEST_SUFFIX):
            with open(a, encoding="utf-8") as f:
                Manifest.loads(f.read()).check()
    if os.path.isdir(to):
        for n in os.listdir(to):
            p = os.path.join(to, n)
            shutil.rmtree(p) if os.path.isdir(p) else os.unlink(p)
    for a, b in pairs:
        target = os.path.join(to, b)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        shutil.copyfile(a, target)
    if not keep_source:
        for a, _ in pairs:
            os.unlink(a)


def advance(boundary: tuple[int, int], to: tuple[int, int]) -> tuple[int, int]:
    """A version boundary may only rise."""
    if to < boundary:
        raise ValueError(f"the boundary may not go back from {boundary} to {to}")
    return to


@dataclass
class EpochTags:
    """Names for epochs, to travel to."""

    tags: dict[str, tuple[int, str]] = field(default_factory=dict)

    def register(self, name: str, epoch: int, comment: str = "") -> None:
        self.tags[name] = (epoch, comment)

    def find(self, name: str) -> int | None:
        found = self.tags.get(name)
        return found and found[0]

    def unregister(self, name: str) -> None:
        self.tags.pop(name, None)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, e, c) for n, (e, c) in sorted(self.tags.items())], "name string, epoch long, comment string")

