"""More registered queries: jobs on whole directories, files of all kinds, and expressions, each with its SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import MANIFEST_SUFFIX, base_name, blob_path, endpoint, parent, rotated_parts, rotated_wal_name, without_trailing_separators
from ..functions.text import ascii_preview, escaped, hex_preview
from ..functions.versions import display, key_sid, split_key_sid, u32_bytes, u64_bytes, u64_of, unsigned
from ..operators import blobs, changelog, files
from ..sources.blob_store import BlobPool, copy_blobs, stored_files
from ..sources.directory import Catalog, Manifest, catalog_rows, manifests, set_up
from ..sources.wal import append_durable, dump, dump_lines, durable_epoch, log_files, read_log, scan_reports, strict_entries
from . import maintenance, recovery
from .mapping import EVENTS_SQL, durable_epoch_of, events_log
from .queries import _BLOB_FILES, _FILES, SNAPSHOT_SQL, _as_wal, _blob_files, _files, _log, _mounted_dir, plain, query, set_durable, wal_rows, write_wal
from .store import CompactionOptions, Configuration, Store

LIVE = ["storage_id", "key", "value"]
MANIFEST = f"x{MANIFEST_SUFFIX}"
_LIVE_SQL = f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, value FROM l"


def _little(c: str) -> str:
    """SQL for the hexadecimal digits of a long's little-endian bytes."""
    return "(" + "||".join(f"substr(lpad(to_hex({c}), 16, '0'), {i}, 2)" for i in range(15, 0, -2)) + ")"


# ---- reading


@query(f"WITH {EVENTS_SQL} SELECT entry_type, snippet_epoch AS epoch, storage_id, count(*) AS n FROM log GROUP BY ALL")
def wal_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the binary logs, markers aside, counted by type, epoch and storage."""
    path, _ = _as_wal(spark, sf_dir)
    entries = dump(spark, f"file://{path}").filter(~F.col("entry_type").startswith("marker"))
    return entries.groupBy("entry_type", "epoch", "storage_id").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL} SELECT count(*) AS n_entries, true AS paired FROM log")
def wal_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound logs by a reading that refuses all others; their markers come in pairs."""
    path, _ = _as_wal(spark, sf_dir)
    return strict_entries(spark, f"file://{path}").agg(F.sum("entries").alias("n_entries"), F.every(F.col("markers") % 2 == 0).alias("paired"))


@query(f"WITH {EVENTS_SQL}, {_BLOB_FILES}, s AS (SELECT DISTINCT storage_id, unnest([blob_a, blob_b]) AS b FROM log WHERE entry_type = 'normal_with_blob') SELECT storage_id, CAST(list(b ORDER BY b) AS VARCHAR) AS ids FROM s GROUP BY storage_id")
def blob_ids_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blobs.ids_in_order(events_log(spark, sf_dir), "storage_id")
    return found.select("storage_id", F.concat(F.lit("["), F.array_join(F.transform("blob_ids", lambda x: x.cast("string")), ", "), F.lit("]")).alias("ids"))


@query(f"WITH {EVENTS_SQL}, {_FILES} SELECT DISTINCT '/log/a/' || name AS path, name, '/log/a' AS folder FROM fs")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/log/a/"), F.col("name"), F.lit("//"))
    clean = without_trailing_separators(path)
    return _files(spark, sf_dir)[0].select(clean.alias("path"), base_name(clean).alias("name"), parent(path).alias("folder"))


@query(f"WITH {EVENTS_SQL} SELECT entry_type || ' epoch=' || snippet_epoch || ' storage_id=' || storage_id AS line, count(*) AS n FROM log WHERE entry_type = 'clear_storage' GROUP BY ALL")
def wal_dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _as_wal(spark, sf_dir)
    lines = dump_lines(dump(spark, f"file://{path}"))
    return lines.filter(F.col("line").startswith("clear_storage")).groupBy("line").agg(F.count("*").alias("n"))


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, major, minor FROM d WHERE entry_type <> 'clear_storage'")
def wal_without_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A start-up policy: what isn't durable is skipped while the logs are read."""
    path, _ = _as_wal(spark, sf_dir)
    rows = read_log(spark, f"file://{path}", on_nondurable="skip").filter(F.col("entry_type") != "clear_storage")
    return rows.select("storage_id", u64_of("key").alias("key"), "major", "minor")


@query(f"WITH {EVENTS_SQL} SELECT count(*) AS n_each, count(*) AS n_all FROM log")
def wal_explicit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files read two lists at a time hold what the directory holds."""
    path, e = _as_wal(spark, sf_dir)
    names = sorted(n for n in os.listdir(path) if n.startswith("pwal_"))
    parts = [read_log(spark, f"file://{path}", e, files=part) for part in (names[::2], names[1::2])]
    each = parts[0].unionByName(parts[1]).agg(F.count("*").alias("n_each"))
    return each.crossJoin(F.broadcast(read_log(spark, f"file://{path}", e).agg(F.count("*").alias("n_all"))))  # one row beside one


@query(f"WITH {SNAPSHOT_SQL} SELECT (SELECT count(*) FROM d) AS n_entries, count(*) AS n_counted, (SELECT max(snippet_epoch) FROM log) AS max_epoch FROM d WHERE entry_type IN ('normal_entry', 'remove_entry')")
def wal_scan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _as_wal(spark, sf_dir)
    return scan_reports(spark, f"file://{path}").agg(F.sum("entries").alias("n_entries"), F.sum("counted").alias("n_counted"), F.max("max_epoch").alias("max_epoch"))


@query(f"WITH {EVENTS_SQL}, {_FILES} SELECT name FROM fs WHERE name LIKE 'epoch%'")
def epoch_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.epoch_files(_files(spark, sf_dir)[0])


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT storage_id, key FROM log")
def checked_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in order, each once; a key out of order would be an error."""
    rows = events_log(spark, sf_dir).select("storage_id", "key")
    return changelog.checked_order(rows, "storage_id", "key", F.col("key"))


@query(f"WITH {EVENTS_SQL}, {_BLOB_FILES} SELECT blob_id, '/blob/dir_' || lpad(CAST(blob_id % 100 AS VARCHAR), 2, '0') || '/' || lpad(lower(to_hex(blob_id)), 16, '0') || '.blob' AS path FROM f")
def blob_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by the paths of their files, among files of other names."""
    ids = _blob_files(events_log(spark, sf_dir))
    paths = ids.select(F.concat(F.lit("/blob/"), blob_path("blob_id")).alias("path"))
    others = ids.select(F.concat(F.lit("/blob/tmp/"), F.col("blob_id").cast("string"), F.lit(".blob")).alias("path"))
    return blobs.blob_files(paths.unionByName(others))


@query("SELECT 'x-manifest.json' AS name, '1.1' AS format_version, 7 AS persistent_format_version, true AS supported, 1 AS version_before")
def manifest_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory of the oldest format after its migration."""
    path = _mounted_dir(spark)
    with open(os.path.join(path, MANIFEST), "w", encoding="utf-8") as f:
        f.write(Manifest(1, "1.0").dumps())
    before, _ = recovery.migrate(path, MANIFEST)
    found = manifests(spark, f"file://{path}").filter(F.length("instance_uuid") == 36)
    return found.select("name", "format_version", "persistent_format_version", "supported", F.lit(before).alias("version_before"))


@query("SELECT 1 AS n_manifests, true AS empty_epoch, 0 AS max_epoch, 7 AS version")
def directory_set_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new directory, set up twice."""
    path = os.path.join(_mounted_dir(spark), "log")
    first, again = set_up(path, MANIFEST), set_up(path, MANIFEST)
    names = os.listdir(path)
    row = (sum(n.endswith(MANIFEST_SUFFIX) for n in names) if first == again else 0, os.path.getsize(os.path.join(path, "epoch")) == 0, Catalog.read(path).max_epoch, again.persistent_format_version)
    return spark.createDataFrame([row], "n_manifests int, empty_epoch boolean, max_epoch int, version int")


@query(
    f"""WITH {EVENTS_SQL}, {_FILES} SELECT 'DETACHED_PWAL' AS kind, name, NULL::BIGINT AS number FROM det UNION ALL SELECT 'COMPACTED_FILE', 'pwal_0000.compacted', 1
UNION ALL SELECT 'MAX_EPOCH_ID', NULL, e FROM ld UNION ALL SELECT 'MAX_BLOB_ID', NULL, max(blob_b) FROM log"""
)
def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog that was written, as rows."""
    log, e = _log(spark, sf_dir)
    path = _mounted_dir(spark)
    names = {r.name for r in _files(spark, sf_dir)[1].collect()}  # of one directory
    Catalog(e, log.agg(F.max(F.col("seq") * 2 + 1)).first()[0], {"pwal_0000.compacted": 1}, names).write(path)
    return catalog_rows(spark, f"file://{path}")


@query(f"WITH {EVENTS_SQL} SELECT e AS durable_epoch FROM ld")
def epoch_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The durable epoch after more epochs than an epoch file keeps."""
    e, path = durable_epoch_of(events_log(spark, sf_dir)), _mounted_dir(spark)
    for epoch in range(max(1, e - 150), e + 1):
        append_durable(path, epoch)
    return spark.createDataFrame([(durable_epoch(spark, f"file://{path}"),)], "durable_epoch long")


# ---- entries of other kinds and states

_DROPS_SQL = SNAPSHOT_SQL.replace("CASE WHEN event_id % 397 = 0 THEN 'clear_storage'", "CASE WHEN event_id % 401 = 0 THEN 'add_storage' WHEN event_id % 794 = 0 THEN 'remove_storage' WHEN event_id % 397 = 0 THEN 'clear_storage'").replace("entry_type = 'clear_storage'", "entry_type IN ('clear_storage', 'remove_storage')").replace("WHERE entry_type <> 'clear_storage' AND", "WHERE entry_type NOT IN ('clear_storage', 'remove_storage', 'add_storage') AND")


@query(f"WITH {_DROPS_SQL} SELECT storage_id, key, major, minor, value FROM l")
def storages_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which storages are added and dropped, too: a drop ends rows as a clearing does, an addition nothing."""
    log = events_log(spark, sf_dir)
    kind = F.when(F.col("seq") % 401 == 0, "add_storage").when(F.col("seq") % 794 == 0, "remove_storage").otherwise(F.col("entry_type"))
    return changelog.snapshot(log.withColumn("entry_type", kind), durable_epoch_of(log)).select("storage_id", "key", "major", "minor", "value")


@query(f"WITH {SNAPSHOT_SQL.replace('WHERE snippet_epoch <= e),', 'WHERE snippet_epoch <= e AND snippet_epoch % 7 <> 0),')} SELECT storage_id, key, major, minor, value FROM l")
def invalidated_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows of a log in which every seventh epoch was invalidated."""
    log = events_log(spark, sf_dir)
    state = F.when(F.col("snippet_epoch") % 7 == 0, "invalidated").otherwise("valid")
    return changelog.snapshot(log.withColumn("snippet_state", state), durable_epoch_of(log)).select("storage_id", "key", "major", "minor", "value")


# ---- order


@query(f"WITH {SNAPSHOT_SQL} SELECT key, CAST(row_number() OVER (ORDER BY key) AS INTEGER) AS place FROM l WHERE storage_id = 3 AND key >= 1000")
def ordered_scan_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places that a scan gives its rows in, one storage's."""
    log, e = _log(spark, sf_dir)
    rows = changelog.ordered_scan(changelog.snapshot(log, e), 3, 1000).withColumn("at", F.monotonically_increasing_id())
    return rows.select("key", F.row_number().over(Window.partitionBy("storage_id").orderBy("at")).alias("place"))


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, CAST(row_number() OVER (PARTITION BY storage_id ORDER BY {_little('key')}) AS INTEGER) AS place FROM l")
def compacted_file_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of rows in a compacted file, of each storage: the order of the keys' bytes."""
    path, e = _as_wal(spark, sf_dir)
    to = os.path.join(_mounted_dir(spark), "to")
    maintenance.write_compacted(changelog.compact(read_log(spark, f"file://{path}", e), e), to)
    rows = read_log(spark, f"file://{to}", e)
    return rows.select("storage_id", u64_of("key").alias("key"), F.row_number().over(Window.partitionBy("storage_id").orderBy("file", "offset")).alias("place"))


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, CAST(row_number() OVER (PARTITION BY storage_id ORDER BY CAST(key AS VARCHAR)) AS INTEGER) AS place FROM l")
def snapshot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that was written in the order of storage and key, by the places of its rows."""
    log, e = _log(spark, sf_dir)
    to = f"{_mounted_dir(spark)}/snapshot"
    recovery.write_snapshot(changelog.snapshot(log, e).select("storage_id", F.col("key").cast("string").alias("key"), "value"), f"file://{to}")
    rows = spark.read.parquet(f"file://{to}").withColumns({"file": F.col("_metadata.file_name"), "at": F.col("_metadata.row_index")})
    return rows.select("storage_id", F.col("key").cast("long").alias("key"), F.row_number().over(Window.partitionBy("storage_id").orderBy("file", "at")).alias("place"))


# ---- expressions


@query(
    f"""WITH {EVENTS_SQL} SELECT seq, CAST(18446744073709551616::HUGEINT - seq - 1 AS VARCHAR) AS shown, {_little('key')} AS u64, substr({_little('key')}, 1, 8) AS u32, key AS back, storage_id AS sid_storage,
row_number() OVER (ORDER BY CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN seq % 2 = 0 THEN seq ELSE -seq END) AS nth FROM log"""
)
def unsigned_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longs as unsigned integers: shown, as bytes, back, and in order."""
    log = events_log(spark, sf_dir)
    mixed = F.when(F.col("seq") % 2 == 0, F.col("seq")).otherwise(-F.col("seq"))
    sid = split_key_sid(key_sid("storage_id", u64_bytes("key")))
    ranked = log.select("seq", "key", "storage_id", unsigned(mixed).alias("order"), sid.alias("sid"))
    below = ranked.groupBy("order").agg(F.count("*").alias("n"))
    nth = below.select("order", F.sum("n").over(Window.orderBy("order")).cast("long").alias("nth"))
    return ranked.join(nth, "order").select(
        "seq", display(-F.col("seq") - 1).cast("string").alias("shown"), F.hex(u64_bytes("key")).alias("u64"), F.hex(u32_bytes("key")).alias("u32"), u64_of("sid.key").alias("back"), F.col("sid.storage_id").alias("sid_storage"), "nth"
    )


@query(
    """SELECT c_custkey, regexp_replace(replace(substr(c_name, 1, 20), ' ', '_'), '[^!-~]', '.', 'g') || CASE WHEN strlen(c_name) > 20 THEN '...' ELSE '' END AS ascii,
lower(hex(substr(c_name, 1, 20))) || CASE WHEN strlen(c_name) > 20 THEN '...' ELSE '' END AS hexed, c_name AS plain, '\\x00' || lower(hex(c_name)) AS with_zero, 'host' || c_custkey AS host, CAST(c_custkey % 65536 AS INTEGER) AS port FROM customer"""
)
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as previews and escaped, and endpoints taken apart."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", F.col("c_name").cast("binary").alias("b"))
    address = endpoint(F.concat(F.lit("tcp://host"), F.col("c_custkey").cast("string"), F.lit(":"), (F.col("c_custkey") % 65536).cast("string")))
    return rows.select("c_custkey", ascii_preview("b").alias("ascii"), hex_preview("b").alias("hexed"), escaped("b").alias("plain"), escaped(F.concat(F.unhex(F.lit("00")), F.col("b"))).alias("with_zero"), address["host"].alias("host"), address["port"].alias("port"))


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT channel, snippet_epoch * 1000 AS millis, snippet_epoch AS epoch FROM log")
def rotated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippets = events_log(spark, sf_dir).select("channel", "snippet_epoch").distinct()
    parts = rotated_parts(rotated_wal_name("channel", F.col("snippet_epoch") * 1000, "snippet_epoch"))
    return snippets.select(parts.alias("p")).select("p.*")


# ---- jobs


def _two_parts(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A directory that was compacted online halfway and written to afterwards."""
    log, e = _log(spark, sf_dir)
    path = _mounted_dir(spark)
    set_up(path, MANIFEST)
    write_wal(log.filter(F.col("snippet_epoch") <= e // 2), path)
    set_durable(path, e // 2)
    maintenance.compact_online(spark, path, e // 2, now=1)
    write_wal(log.filter(F.col("snippet_epoch") > e // 2), path)
    set_durable(path, e)
    return path, e


@query(_LIVE_SQL)
def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory with a compacted file and later logs, opened."""
    path, _ = _two_parts(spark, sf_dir)
    return plain(recovery.recover(spark, path, MANIFEST).rows).select(*LIVE)


@query(f"WITH {SNAPSHOT_SQL} SELECT e AS durable_epoch, (SELECT max(snippet_epoch) FROM log) AS max_epoch, (SELECT max(blob_b) + 1 FROM log WHERE entry_type = 'normal_with_blob') AS next_blob FROM ld")
def recovered_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a directory's epochs and object ids go on when it is opened."""
    path, _ = _as_wal(spark, sf_dir)
    found = recovery.recover(spark, path)
    return spark.createDataFrame([(found.durable_epoch, found.max_epoch, found.next_blob)], "durable_epoch long, max_epoch long, next_blob long")


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, value FROM l")
def compacted_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory compacted online twice, the logs that went into it deleted, and read."""
    path, e = _two_parts(spark, sf_dir)
    maintenance.request_compaction(path)
    if not maintenance.compact_if_asked(spark, path, e, now=2, parts=3) or maintenance.compact_if_asked(spark, path, e):
        raise RuntimeError("a request is to be served once")
    maintenance.delete_detached(path)
    return plain(read_log(spark, f"file://{path}", e)).select(*LIVE)


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, value FROM l")
def compacted_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory compacted in its place, after a dry run that leaves it alone."""
    path, e = _as_wal(spark, sf_dir)
    before = sorted(os.listdir(path))
    maintenance.compact_offline(spark, path, dry_run=True)
    if sorted(os.listdir(path)) != before:
        raise RuntimeError("a dry run changed the directory")
    maintenance.compact_offline(spark, path, backup=True)
    return plain(read_log(spark, f"file://{path}", e)).select(*LIVE)


@query(f"WITH {SNAPSHOT_SQL} SELECT (SELECT e FROM ld) AS durable_epoch, count(*) AS count_durable_wal_entries, 'OK' AS status, 0 AS rc FROM d WHERE entry_type IN ('normal_entry', 'remove_entry')")
def repaired_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of a directory, its tail marked, inspected."""
    path, _ = _as_wal(spark, sf_dir)
    to = os.path.join(_mounted_dir(spark), "to")
    if maintenance.repair(spark, path, to, now=5) != ("repaired", 0):
        raise RuntimeError("the directory is to be mended")
    return maintenance.inspect(spark, f"file://{to}").select("durable_epoch", "count_durable_wal_entries", "status", "rc")


@query(f"WITH {EVENTS_SQL} SELECT count(*) AS n_entries, e AS durable_epoch, true AS all_rotated FROM log, ld GROUP BY e")
def rotated_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory after its logs were set aside."""
    path, e = _as_wal(spark, sf_dir)
    done = maintenance.rotate(path, e, now=7)
    maintenance.drop_rotated_epoch_files(path)
    rows = read_log(spark, f"file://{path}")
    ok = all(n in done for n in os.listdir(path) if n.startswith("pwal_"))
    return rows.agg(F.count("*").alias("n_entries")).select("n_entries", F.lit(durable_epoch(spark, f"file://{path}")).cast("long").alias("durable_epoch"), F.lit(ok).alias("all_rotated"))


@query(f"WITH {SNAPSHOT_SQL} SELECT storage_id, key, major, minor, value FROM l")
def restored_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backup of a directory, restored elsewhere, resolved."""
    path, e = _as_wal(spark, sf_dir)
    set_up(path, MANIFEST)
    maintenance.rotate(path, e, now=9)
    listing = log_files(spark, f"file://{path}", content=False)
    entries = [(r.destination, r.destination) for r in files.backup_entries(listing).collect()]  # of one directory
    to = os.path.join(_mounted_dir(spark), "to")
    maintenance.restore(path, to, entries)
    append_durable(to, e)
    return plain(changelog.snapshot(read_log(spark, f"file://{to}"), e)).select("storage_id", "key", "major", "minor", "value")


@query(_LIVE_SQL)
def store_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store that is opened, written to twice, compacted in between, shut down and opened again."""
    log, e = _log(spark, sf_dir)
    rows = wal_rows(log)
    configuration = Configuration(os.path.join(_mounted_dir(spark), "log"))
    first = Store(spark, configuration)
    first.ready()
    first.write(rows.filter(F.col("snippet_epoch") <= e // 2))
    first.compact(CompactionOptions(parts=2))
    first.write(rows.filter((F.col("snippet_epoch") > e // 2) & (F.col("snippet_epoch") <= e)))
    first.shutdown()
    again = Store(spark, configuration)
    found = again.ready()
    again.shutdown()
    return plain(found.rows).select(*LIVE)


@query(
    f"""WITH {SNAPSHOT_SQL}, {_BLOB_FILES}, p AS (SELECT d.*, major < e // 2 AS low FROM d, ld WHERE entry_type = 'normal_with_blob'),
t AS (SELECT *, row_number() OVER (PARTITION BY low, storage_id, key ORDER BY major DESC, minor DESC) AS nth FROM p),
r AS (SELECT unnest([blob_a, blob_b]) AS blob_id FROM t WHERE NOT low OR nth = 1)
SELECT DISTINCT blob_id FROM f WHERE blob_id % 10 = 0 AND NOT (blob_id <= (SELECT max(blob_b) FROM log WHERE entry_type = 'normal_with_blob') AND blob_id NOT IN (SELECT blob_id FROM r))"""
)
def blobs_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of objects that an online compaction leaves, of every tenth id."""
    path, e = _as_wal(spark, sf_dir)
    set_up(path, MANIFEST)
    root = _mounted_dir(spark)
    ids = _blob_files(events_log(spark, sf_dir)).filter("blob_id % 10 = 0").select(blob_path("blob_id").alias("path"))

    def make(rows) -> None:
        for r in rows:
            os.makedirs(os.path.dirname(os.path.join(root, r.path)), exist_ok=True)
            with open(os.path.join(root, r.path), "wb") as f:
                f.write(b"x")

    ids.foreachPartition(make)
    maintenance.compact_online(spark, path, e, now=3, boundary=(e // 2, 0), blob_root=root)
    return blobs.blob_files(stored_files(spark, root)).select("blob_id")


@query(
    f"""WITH {SNAPSHOT_SQL}, {_BLOB_FILES}, m AS (SELECT *, row_number() OVER (PARTITION BY storage_id, key ORDER BY major DESC, minor DESC) AS nth FROM d WHERE entry_type <> 'clear_storage'),
r AS (SELECT unnest([blob_a, blob_b]) AS blob_id FROM m WHERE nth = 1 AND entry_type = 'normal_with_blob')
SELECT DISTINCT blob_id FROM f WHERE blob_id NOT IN (SELECT blob_id FROM r)"""
)
def garbage_when_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that may go when a directory is opened."""
    path, _ = _as_wal(spark, sf_dir)
    return recovery.garbage(_blob_files(events_log(spark, sf_dir)), recovery.recover(spark, path))


@query("SELECT * FROM (VALUES (1::BIGINT, true, true), (2, false, false), (3, true, true), (4, false, false)) v(blob_id, kept, copied)")
def blob_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of a pool, two made persistent before it was released, and copies of their files."""
    root, to = _mounted_dir(spark), _mounted_dir(spark)
    numbers = iter(range(1, 100))
    pool = BlobPool(root, lambda: next(numbers))
    first = pool.register_data(b"content")
    with open(os.path.join(root, "source"), "wb") as f:
        f.write(b"of a file")
    pool.register_file(os.path.join(root, "source"))
    pool.duplicate(first)
    pool.register_file(os.path.join(root, "source"), temporary=True)
    pool.release({1, 3})
    ids = spark.createDataFrame([(i,) for i in range(1, 5)], "blob_id long")
    kept = blobs.blob_files(log_files(spark, f"file://{root}/dir_*", "*.blob", content=False)).select(F.col("blob_id").alias("id"))
    return copy_blobs(ids, root, to).join(F.broadcast(kept), F.col("blob_id") == F.col("id"), "left").select("blob_id", F.col("id").isNotNull().alias("kept"), "copied")


@query(f"WITH {EVENTS_SQL} SELECT * FROM (SELECT 'half' AS name, e // 2 AS epoch, 'halfway' AS comment FROM ld UNION ALL SELECT 'whole', e, '' FROM ld)")
def epoch_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = durable_epoch_of(events_log(spark, sf_dir))
    tags = maintenance.EpochTags()
    for name, epoch, comment in (("whole", e, ""), ("half", e, ""), ("half", e // 2, "halfway"), ("gone", 1, "")):
        tags.register(name, epoch, comment)
    tags.unregister("gone")
    return tags.table(spark)
