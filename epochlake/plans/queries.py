"""The registered queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import EPOCH, WAL_PREFIX, blob_id_of, blob_path, rotated_wal_name
from ..functions.tags import reference_tag
from ..functions.versions import u64_bytes, u64_of
from ..operators import blobs, changelog, files, progress
from ..sources.wal import log_files, read_log, register
from ..sources.wal_format import marker
from ..streaming.replica import Replica, visible
from . import maintenance
from .mapping import EVENTS_SQL, ORDERS_SQL, durable_epoch_of, events_log, orders_log

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: More common table expressions: durable entries d, cutoffs c, entries that no cutoff ends k, newest n, live l.
SNAPSHOT_SQL = (
    EVENTS_SQL
    + """,
d AS (SELECT log.* FROM log, ld WHERE snippet_epoch <= e),
c AS (SELECT storage_id, max(major * 1000 + minor) AS cut FROM d WHERE entry_type = 'clear_storage' GROUP BY storage_id),
k AS (SELECT d.* FROM d LEFT JOIN c USING (storage_id) WHERE entry_type <> 'clear_storage' AND (cut IS NULL OR major * 1000 + minor >= cut)),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY storage_id, key ORDER BY major DESC, minor DESC) AS nth FROM k) WHERE nth = 1),
l AS (SELECT * FROM n WHERE entry_type <> 'remove_entry')"""
)
KV = ["storage_id", "key", "major", "minor", "value"]
TAG_SECRET = bytes(range(16))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _found[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import job_queries  # noqa: F401 - registers more

    return dict(_found)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    log = events_log(spark, sf_dir)
    return log, durable_epoch_of(log)


def _work_dir(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares; a temporary one only where none is set and all is on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    return f"{named or tempfile.mkdtemp(prefix='epochlake-')}/{uuid.uuid4().hex}"


def _mounted_dir(spark: SparkSession) -> str:
    """A new folder for log files, by its path; the shared folder must be one that all nodes mount."""
    url = urlparse(_work_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"logs are written to mounted paths only, not to {url.scheme}://")
    os.makedirs(url.path)
    return url.path


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, major, minor, value FROM l")
def snapshot_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the rows that live at the durable epoch."""
    log, e = _log(spark, sf_dir)
    return changelog.snapshot(log, e).select(*KV)


@query(f"WITH {SNAPSHOT_SQL} SELECT seq, channel, snippet_epoch, entry_type FROM d")
def durable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.durable(log, e).select("seq", "channel", "snippet_epoch", "entry_type")


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, CAST(cut // 1000 AS BIGINT) AS cut_major, CAST(cut % 1000 AS BIGINT) AS cut_minor FROM c")
def storage_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.cutoffs(changelog.durable(log, e))


_LATEST = f"WITH {SNAPSHOT_SQL}, m AS (SELECT *, row_number() OVER (PARTITION BY storage_id, key ORDER BY major DESC, minor DESC) AS nth FROM d WHERE entry_type <> 'clear_storage') SELECT storage_id, key, major, minor, entry_type, value FROM m WHERE nth = 1"


@query(_LATEST)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.latest(changelog.durable(log, e)).select("storage_id", "key", "major", "minor", "entry_type", "value")


@query(_LATEST)
def latest_version_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.latest_by_window(changelog.durable(log, e)).select("storage_id", "key", "major", "minor", "entry_type", "value")


@query(f"WITH {SNAPSHOT_SQL} SELECT seq, storage_id, key, major, minor FROM k")
def range_delete_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    log = changelog.durable(log, e)
    points = log.filter(F.col("entry_type") != "clear_storage")
    return changelog.drop_cleared(points, changelog.cutoffs(log)).select("seq", "storage_id", "key", "major", "minor")


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, major, minor, entry_type FROM n")
def tombstones_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.snapshot(log, e, keep_tombstones=True).select("storage_id", "key", "major", "minor", "entry_type")


@query(
    f"""WITH {EVENTS_SQL}, caps AS (SELECT unnest([e // 4, e // 2, e]) AS cap FROM ld),
d AS (SELECT caps.cap, log.* FROM log, caps WHERE snippet_epoch <= cap),
c AS (SELECT cap, storage_id, max(major * 1000 + minor) AS cut FROM d WHERE entry_type = 'clear_storage' GROUP BY ALL),
n AS (SELECT d.*, row_number() OVER (PARTITION BY d.cap, d.storage_id, d.key ORDER BY major DESC, minor DESC) AS nth FROM d LEFT JOIN c ON d.cap = c.cap AND d.storage_id = c.storage_id WHERE entry_type <> 'clear_storage' AND (cut IS NULL OR major * 1000 + minor >= cut))
SELECT CAST(cap AS BIGINT) AS as_of, storage_id, key, value FROM n WHERE nth = 1 AND entry_type <> 'remove_entry'"""
)
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.snapshots_at(log, [e // 4, e // 2, e]).select("as_of", "storage_id", "key", "value")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    base = changelog.snapshot(log, e // 2)
    return changelog.merge_base(base, log.filter(F.col("snippet_epoch") > e // 2), e)


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, major, minor, value FROM l")
def base_delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select(*KV)


@query(f"WITH {SNAPSHOT_SQL} SELECT count(*) AS n_merged, count(*) AS n_direct, count(*) AS n_same FROM l")
def merge_equals_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir).select(*KV, F.lit(1).alias("m"), F.lit(0).alias("d"))
    direct = snapshot_live(spark, sf_dir).select(*KV, F.lit(0).alias("m"), F.lit(1).alias("d"))
    both = merged.unionByName(direct).groupBy(*KV).agg(F.sum("m").alias("m"), F.sum("d").alias("d"))
    return both.agg(F.sum("m").alias("n_merged"), F.sum("d").alias("n_direct"), F.sum(F.least("m", "d")).alias("n_same"))


@query(f"WITH {SNAPSHOT_SQL} SELECT CAST(0 AS BIGINT) AS snippet_epoch, storage_id, key, CAST(0 AS BIGINT) AS major, CAST(0 AS BIGINT) AS minor, entry_type, value FROM l")
def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.compact(log, e).select("snippet_epoch", "storage_id", "key", "major", "minor", "entry_type", "value")


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, value FROM l WHERE storage_id = 1 AND key = (SELECT min(key) FROM l WHERE storage_id = 1)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = snapshot_live(spark, sf_dir)
    key = rows.filter("storage_id = 1").agg(F.min("key")).first()[0]
    return changelog.point_lookup(rows, 1, key).select("storage_id", "key", "value")


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, value FROM l WHERE storage_id = 3 AND key > 1000 ORDER BY key")
def ordered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.ordered_scan(snapshot_live(spark, sf_dir), 3, 1000, inclusive=False).select("storage_id", "key", "value")


@query(f"WITH {SNAPSHOT_SQL} SELECT CAST(4 AS BIGINT) AS n_partitions, count(*) AS n_rows, count(DISTINCT (storage_id, key)) AS n_keys FROM l")
def partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four disjoint partitions that hold every row once."""
    parts = changelog.partitioned(snapshot_live(spark, sf_dir), 4).select("storage_id", "key", F.spark_partition_id().alias("part"))
    each = parts.groupBy("storage_id", "key").agg(F.count("*").alias("n"), F.min("part").alias("part"))
    return each.agg(F.count_distinct("part").alias("n_partitions"), F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"))


@query(f"WITH {EVENTS_SQL}, p AS (SELECT channel, seq, key, lag(key) OVER (PARTITION BY channel ORDER BY seq) AS previous_key FROM log) SELECT channel, seq, key, previous_key FROM p WHERE key < previous_key")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    bad = changelog.order_violations(log, "channel", "seq", F.col("key"))
    return bad.select("channel", "seq", "key", "previous_key")


@query(f"WITH {EVENTS_SQL} SELECT channel, seq * 2 + 1 AS position, snippet_epoch AS current_epoch FROM log")
def snippet_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries get their epoch back from the begin markers before them."""
    log = events_log(spark, sf_dir)
    entries = log.select("channel", (F.col("seq") * 2 + 1).alias("position"), "entry_type", F.lit(None).cast("long").alias("epoch"))
    begins = log.groupBy("channel", "snippet_epoch").agg((F.min("seq") * 2).alias("position"))
    begins = begins.select("channel", "position", F.lit("marker_begin").alias("entry_type"), F.col("snippet_epoch").alias("epoch"))
    filled = changelog.fill_snippets(entries.unionByName(begins), "channel", "position")
    return filled.filter(F.col("entry_type") != "marker_begin").select("channel", "position", "current_epoch")


@query(f"WITH {SNAPSHOT_SQL} SELECT count(*) FILTER (entry_type = 'normal_entry') AS n_puts, count(*) FILTER (entry_type = 'remove_entry') AS n_removes, count(*) AS n_entries FROM d")
def entry_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.entry_counts(changelog.durable(log, e))


@query(f"WITH {EVENTS_SQL} SELECT max(snippet_epoch) AS max_epoch FROM log")
def max_appeared_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return changelog.max_appeared_epoch(log, e)


@query(
    f"""WITH {EVENTS_SQL}, ch AS (SELECT channel, max(snippet_epoch) AS working, max(snippet_epoch) FILTER (snippet_epoch <= e - channel * 2) AS finished FROM log, ld GROUP BY channel),
w AS (SELECT least((SELECT max(snippet_epoch) FROM log), min(working - 1)) AS informed FROM ch WHERE working > coalesce(finished, 0))
SELECT informed, coalesce((SELECT max(finished) FROM ch, w WHERE finished <= w.informed), 0) AS recorded FROM w"""
)
def channel_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    channels = log.groupBy("channel").agg(F.max("snippet_epoch").alias("working"), F.max(F.when(F.col("snippet_epoch") <= e - F.col("channel") * 2, F.col("snippet_epoch"))).alias("finished"))
    return progress.watermark(channels, changelog.max_appeared_epoch(log).first()[0] + 1)


@query(f"WITH {SNAPSHOT_SQL} SELECT DISTINCT unnest([blob_a, blob_b]) AS blob_id FROM l WHERE entry_type = 'normal_with_blob'")
def blob_referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return blobs.referenced(changelog.snapshot(log, e))


@query(f"WITH {SNAPSHOT_SQL} SELECT max(blob_b) AS max_blob_id FROM d WHERE entry_type = 'normal_with_blob'")
def blob_max_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return blobs.max_blob_id(changelog.durable(log, e))


#: Blob files found on disk: the objects of all puts, durable or not.
_BLOB_FILES = "f AS (SELECT unnest([blob_a, blob_b]) AS blob_id FROM log WHERE entry_type = 'normal_with_blob')"


def _blob_files(log: DataFrame) -> DataFrame:
    return log.filter(F.col("entry_type") == "normal_with_blob").select(F.explode("blob_ids").alias("blob_id"))


def _max_durable_blob(log: DataFrame, e: int) -> int:
    return blobs.max_blob_id(changelog.durable(log, e)).first()[0]


@query(
    f"""WITH {SNAPSHOT_SQL}, {_BLOB_FILES}, m AS (SELECT *, row_number() OVER (PARTITION BY storage_id, key ORDER BY major DESC, minor DESC) AS nth FROM d WHERE entry_type <> 'clear_storage'),
r AS (SELECT unnest([blob_a, blob_b]) AS blob_id FROM m WHERE nth = 1 AND entry_type = 'normal_with_blob')
SELECT DISTINCT blob_id FROM f WHERE blob_id <= (SELECT max(blob_b) FROM d WHERE entry_type = 'normal_with_blob') AND blob_id NOT IN (SELECT blob_id FROM r)"""
)
def blob_gc_startup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return blobs.gc_at_startup(log, e, _blob_files(log), _max_durable_blob(log, e))


@query(
    f"""WITH {SNAPSHOT_SQL}, {_BLOB_FILES}, p AS (SELECT d.*, major < e // 2 AS low FROM d, ld WHERE entry_type = 'normal_with_blob'),
t AS (SELECT *, row_number() OVER (PARTITION BY low, storage_id, key ORDER BY major DESC, minor DESC) AS nth FROM p),
r AS (SELECT unnest([blob_a, blob_b]) AS blob_id FROM t WHERE NOT low OR nth = 1)
SELECT DISTINCT blob_id FROM f WHERE blob_id <= (SELECT max(blob_b) FROM d WHERE entry_type = 'normal_with_blob') AND blob_id NOT IN (SELECT blob_id FROM r)"""
)
def blob_gc_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return blobs.gc_at_compaction(log, e, (e // 2, 0), _blob_files(log), _max_durable_blob(log, e))


@query(
    f"""WITH {SNAPSHOT_SQL}, {_BLOB_FILES}, r AS (SELECT unnest([blob_a, blob_b]) AS blob_id FROM l WHERE entry_type = 'normal_with_blob')
SELECT DISTINCT blob_id FROM f WHERE blob_id <= (SELECT max(blob_b) FROM d WHERE entry_type = 'normal_with_blob') AND blob_id NOT IN (SELECT blob_id FROM r)"""
)
def blob_gc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return blobs.gc_exact(log, e, _blob_files(log), _max_durable_blob(log, e))


@query(f"WITH {SNAPSHOT_SQL}, {_BLOB_FILES} SELECT blob_id FROM f WHERE blob_id < (SELECT max(blob_b) + 1 FROM d WHERE entry_type = 'normal_with_blob') AND blob_id % 3 <> 0")
def blob_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    wanted = _blob_files(log)
    return blobs.available(wanted, wanted.filter("blob_id % 3 <> 0"), _max_durable_blob(log, e) + 1)


@query(f"WITH {EVENTS_SQL}, {_BLOB_FILES} SELECT blob_id FROM f WHERE blob_id % 5 = 0 AND blob_id % 2 = 1")
def blob_pool_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provisional objects that no entry made persistent."""
    ids = _blob_files(events_log(spark, sf_dir))
    return blobs.settle_pool(ids.filter("blob_id % 5 = 0"), ids.filter("blob_id % 2 = 0"))[0]


@query(f"WITH {EVENTS_SQL}, {_BLOB_FILES} SELECT blob_id, 'dir_' || lpad(CAST(blob_id % 100 AS VARCHAR), 2, '0') || '/' || lpad(lower(to_hex(blob_id)), 16, '0') || '.blob' AS path, blob_id AS parsed_id FROM f")
def blob_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _blob_files(events_log(spark, sf_dir)).select("blob_id", blob_path("blob_id").alias("path"))
    return paths.select("blob_id", "path", blob_id_of(F.regexp_extract("path", "([^/]*)$", 1)).alias("parsed_id"))


#: A directory's files: rotated logs of even epochs by channel, an active log of each, and the other files there are.
_FILES = """w AS (SELECT DISTINCT channel, snippet_epoch FROM log),
fs AS (SELECT printf('pwal_%04d.%014d.%d', channel, snippet_epoch * 1000, snippet_epoch) AS name FROM w WHERE snippet_epoch % 2 = 0
  UNION ALL SELECT DISTINCT printf('pwal_%04d', channel) FROM w
  UNION ALL SELECT unnest(['epoch', 'epoch.00000000001000.1', 'compaction_catalog', 'pwal_0000.compacted', 'x-manifest.json', '00000000000003e9.blob', 'notes.txt'])),
det AS (SELECT printf('pwal_%04d.%014d.%d', channel, snippet_epoch * 1000, snippet_epoch) AS name FROM w WHERE snippet_epoch % 6 = 0 OR snippet_epoch % 6 = 1)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    snippets = events_log(spark, sf_dir).select("channel", "snippet_epoch").distinct()
    name = rotated_wal_name("channel", F.col("snippet_epoch") * 1000, "snippet_epoch").alias("name")
    active = snippets.select(F.format_string("pwal_%04d", "channel").alias("name")).distinct()
    others = spark.createDataFrame([(n,) for n in ("epoch", "epoch.00000000001000.1", "compaction_catalog", "pwal_0000.compacted", "x-manifest.json", "00000000000003e9.blob", "notes.txt")], "name string")
    listing = snippets.filter("snippet_epoch % 2 = 0").select(name).unionByName(active).unionByName(others)
    return listing, snippets.filter("snippet_epoch % 6 in (0, 1)").select(name)


@query(f"WITH {EVENTS_SQL}, {_FILES} SELECT name FROM fs WHERE name NOT IN ('compaction_catalog', 'pwal_0000.compacted') AND name NOT IN (SELECT name FROM det)")
def file_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.snapshot_inputs(*_files(spark, sf_dir))


@query(f"WITH {EVENTS_SQL}, {_FILES} SELECT name FROM fs WHERE name LIKE 'pwal\\_%' ESCAPE '\\' AND length(name) > 9 AND name NOT IN (SELECT name FROM det)")
def compaction_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.compaction_inputs(*_files(spark, sf_dir))


@query(f"WITH {EVENTS_SQL}, {_FILES} SELECT name FROM det WHERE name IN (SELECT name FROM fs)")
def detached_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, detached = _files(spark, sf_dir)
    return files.detached_still_there(detached, listing)


@query(
    f"""WITH {EVENTS_SQL}, {_FILES} SELECT '/log/' || name AS path, name AS destination, name LIKE '%-manifest.json' AS is_mutable, false AS is_detached FROM fs
WHERE name LIKE '%-manifest.json' OR name = 'compaction_catalog' OR (name LIKE 'pwal\\_%' ESCAPE '\\' AND length(name) <> 9) OR (name LIKE 'epoch%' AND length(name) > 5) OR regexp_matches(name, '^[0-9A-Fa-f]{{16}}[.]blob$')"""
)
def backup_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing, _ = _files(spark, sf_dir)
    return files.backup_entries(listing.withColumn("path", F.concat(F.lit("/log/"), "name")))


@query(f"WITH {EVENTS_SQL}, {_FILES}, b AS (SELECT name FROM fs UNION SELECT name FROM det) SELECT '/log/' || name AS path FROM b")
def backup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full backup: the union of two listings, each file once."""
    listing, detached = _files(spark, sf_dir)
    path = F.concat(F.lit("/log/"), "name").alias("path")
    return files.backup_files(listing.select(path), detached.select(path))


_HMAC = "unhex(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message}))))"


def _tag_sql() -> str:
    le = lambda c: "||".join(f"substr(lpad(to_hex({c}), 16, '0'), {i}, 2)" for i in range(15, 0, -2))
    key = TAG_SECRET.ljust(64, b"\0")
    inner, outer = (bytes(k ^ p for k in key).hex() for p in (0x36, 0x5C))
    digest = _HMAC.format(outer=outer, inner=inner, message=f"unhex({le('blob_id')}||{le('7')})")
    h = f"hex({digest})"
    big = "||".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2))
    return f"WITH {EVENTS_SQL}, {_BLOB_FILES} SELECT blob_id, lower({big}) AS tag FROM f"


@query(_tag_sql())
def reference_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HMAC-SHA256 tags of objects, in hexadecimal, under a fixed secret and transaction."""
    ids = _blob_files(events_log(spark, sf_dir))
    return ids.select("blob_id", F.lower(F.lpad(F.hex(reference_tag("blob_id", F.lit(7).cast("long"), TAG_SECRET)), 16, "0")).alias("tag"))


@query(f"WITH {SNAPSHOT_SQL} SELECT seq, storage_id, key, snippet_epoch FROM log, ld WHERE snippet_epoch <= e // 2")
def replica_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, e = _log(spark, sf_dir)
    return visible(log, e // 2).select("seq", "storage_id", "key", "snippet_epoch")


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, major, minor, value FROM l")
def replica_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events applied to a replica by Structured Streaming, committed, and read: the live snapshot."""
    log, e = _log(spark, sf_dir)
    work = _work_dir(spark)
    log.write.parquet(f"{work}/changes")
    replica = Replica(spark, f"{work}/replica")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 4).parquet(f"{work}/changes")
    replica.start(stream, f"{work}/checkpoint").awaitTermination()
    replica.commit(e)
    return replica.read().select(*KV)


def wal_rows(log: DataFrame) -> DataFrame:
    """An events log in the schema of log files."""
    return log.select(
        F.lit(None).cast("string").alias("file"),
        F.col("seq").alias("offset"),
        F.lit(0).alias("snippet_no"),
        "snippet_epoch",
        F.lit("valid").alias("snippet_state"),
        "entry_type",
        "storage_id",
        u64_bytes("key").alias("key"),
        "major",
        "minor",
        F.col("value").cast("string").cast("binary").alias("value"),
        "blob_ids",
    )


def write_wal(log: DataFrame, path: str) -> None:
    """Appends an events log to a mounted folder in the binary format, each key's entries in one file."""
    register(log.sparkSession)
    wal_rows(log).repartition("storage_id", "key").sortWithinPartitions("offset").write.format("epochlog").mode("append").save(path)


def set_durable(path: str, epoch: int) -> None:
    with open(f"{path}/{EPOCH}", "wb") as f:
        f.write(marker("marker_durable", epoch))


def _as_wal(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The events log in the binary format in a new mounted folder, its tail not durable; (path, durable epoch)."""
    log, e = _log(spark, sf_dir)
    path = _mounted_dir(spark)
    write_wal(log, path)
    set_durable(path, e)
    return path, e


def plain(rows: DataFrame) -> DataFrame:
    """Rows that were read from binary logs, with the key and the value that the events had."""
    return rows.withColumn("key", u64_of("key")).withColumn("value", F.col("value").cast("string").cast("double"))


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, major, minor, value FROM l")
def wal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as binary logs, read back, and resolved: the live snapshot."""
    path, e = _as_wal(spark, sf_dir)
    live = changelog.snapshot(read_log(spark, f"file://{path}"), e)
    return plain(live).select(*KV)


@query(f"WITH {SNAPSHOT_SQL} SELECT (SELECT e FROM ld) AS durable_epoch, (SELECT max(snippet_epoch) FROM log) AS max_appeared_epoch, count(*) AS count_durable_wal_entries, 'auto-repairable' AS status, 1 AS rc FROM d WHERE entry_type IN ('normal_entry', 'remove_entry')")
def wal_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as binary logs with a tail that isn't durable, inspected."""
    path, _ = _as_wal(spark, sf_dir)
    return maintenance.inspect(spark, f"file://{path}")


@query(f"WITH {EVENTS_SQL} SELECT count(DISTINCT storage_id) AS n_storages, count(*) AS n_entries FROM log")
def wal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as binary logs, and all entries counted by the data source."""
    path, _ = _as_wal(spark, sf_dir)
    entries = spark.read.format("epochlog").load(path)
    if not log_files(spark, f"file://{path}", f"{WAL_PREFIX}*", content=False).count():
        raise RuntimeError("no log was written")
    return entries.agg(F.count_distinct("storage_id").alias("n_storages"), F.count("*").alias("n_entries"))


@query(
    f"""WITH {ORDERS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY major DESC, minor DESC) AS nth FROM olog WHERE major <= 10500)
SELECT key, major, minor, value FROM n WHERE nth = 1 AND entry_type <> 'remove_entry'"""
)
def orders_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their newest line item as of a day, those with a return as newest gone.

    Lines of an order may share day and number. The SQL leaves open which of them is the newest (DuckDB's answer changes from run
    to run); here it is a return, or else the one of the highest price."""
    log = orders_log(spark, sf_dir)
    return changelog.live(changelog.latest(changelog.as_of(log, 10500))).select("key", "major", "minor", "value")
