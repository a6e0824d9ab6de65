import os

import pytest

from epochlake.operators import blobs, changelog
from epochlake.plans import maintenance
from epochlake.sources.directory import BadDirectory, Catalog, Manifest, catalog_rows, manifests, set_up
from epochlake.sources.wal import append_durable, durable_epoch, read_log, register
from epochlake.sources.wal_format import DamagedLog
from tests.logs import FILES, begin, change_log, durable_file, end, pairs, put


@pytest.fixture
def directory(tmp_path):
    """Makes a log directory of the given files; its path."""

    def make(durable=0x100, **files):
        path = tmp_path / f"log{len(list(tmp_path.iterdir()))}"
        set_up(str(path), "x-manifest.json")
        (path / "epoch").write_bytes(durable_file(durable))
        for name, data in files.items():
            (path / name).write_bytes(data)
        return str(path)

    return make


def read(path):
    return {n: open(os.path.join(path, n), "rb").read() for n in sorted(os.listdir(path)) if n.startswith("pwal")}


def test_read_log(spark, directory):
    path = directory(pwal_0000=FILES["normal2"], pwal_0001=FILES["nondurable"])
    log = read_log(spark, path)
    assert log.count() == 3 and durable_epoch(spark, path) == 0x100
    assert read_log(spark, path, files=["pwal_0001"]).count() == 0
    assert read_log(spark, path, most_epoch=0xF0).count() == 1
    assert read_log(spark, path, columns=["key", "major"]).columns == ["key", "major"]
    bad = directory(pwal_0000=FILES["normal2"], pwal_0001=FILES["entry_then_zerofill"])
    with pytest.raises(Exception, match="DamagedLog"):
        read_log(spark, bad).count()
    assert read_log(spark, bad, on_damage="skip").count() == 4


def test_data_source_pushes_the_epoch_down(spark, directory):
    path = directory(pwal_0000=FILES["normal2"], pwal_0001=begin(0x101) + put())
    register(spark)
    df = spark.read.format("epochlog").load(path)
    assert df.count() == 4
    low = df.filter("snippet_epoch <= 241")
    assert low.count() == 2 and "241" not in low._jdf.queryExecution().executedPlan().toString()
    assert spark.read.format("epochlog").option("onNondurable", "skip").load(path).count() == 3
    assert spark.read.format("epochlog").load(directory()).count() == 0


def test_write_and_read_back(spark, directory):
    path = directory(durable=1)
    register(spark)
    log = change_log(spark, [(0, 3, "put", 1, "a", "x", (3, 0)), (0, 3, "put", 1, "b", "y", (3, 1), [7, 8]), (0, 4, "del", 1, "a", None, (4, 0)), (0, 4, "truncate", 2, None, None, (4, 1))])
    log.coalesce(1).write.format("epochlog").mode("append").save(path)
    back = read_log(spark, path)
    assert durable_epoch(spark, path) == 4 and pairs(changelog.snapshot(back, 4)) == {"1/b": "y"}
    columns = ["snippet_epoch", "entry_type", "storage_id", "key", "major", "minor", "value", "blob_ids"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, log.select(columns).collect()))


@pytest.mark.parametrize("name,status,rc", [("normal", "OK", 0), ("nondurable", "auto-repairable", 1), ("truncated_epoch_header", "unrepairable", 2)])
def test_inspect(spark, directory, name, status, rc):
    got = maintenance.inspect(spark, directory(pwal_0000=FILES[name])).first()
    assert (got.status, got.rc, got.durable_epoch) == (status, rc, 0x100)


def test_inspect_nothing(spark, directory):
    got = maintenance.inspect(spark, directory()).first()
    assert (got.status, got.count_durable_wal_entries, got.max_appeared_epoch) == ("OK", 0, 0x100)


def test_repair_a_copy(spark, directory, tmp_path):
    path = directory(pwal_0000=FILES["zerofill"], pwal_0001=FILES["normal2"])
    before = read(path)
    assert maintenance.repair(spark, path, str(tmp_path / "a"), now=5) == ("repaired", 0)
    assert read(path) == before
    mended = read(str(tmp_path / "a"))
    assert mended["pwal_0000.00000000000005.0"] == FILES["zerofill"][:9] + b"\x06" + FILES["zerofill"][10:] and mended["pwal_0001.00000000000005.0"] == FILES["normal2"]
    assert maintenance.repair(spark, str(tmp_path / "a"), str(tmp_path / "b"), now=6) == ("OK", 0) and read(str(tmp_path / "b")) == mended
    assert maintenance.repair(spark, path, str(tmp_path / "c"), cut=True, now=5)[0] == "repaired"
    assert read(str(tmp_path / "c"))["pwal_0000.00000000000005.0"] == FILES["zerofill"][:9]
    bad = directory(pwal_0000=FILES["truncated_epoch_header"])
    assert maintenance.repair(spark, bad, str(tmp_path / "d"), now=5) == ("unrepairable", 16)
    assert read(str(tmp_path / "d"))["pwal_0000.00000000000005.0"] == FILES["truncated_epoch_header"]


def test_compact_directory(spark, directory, tmp_path):
    log = begin(0xF0) + b"".join(put(k, b"0", major=0xF0) for k in (b"A", b"B", b"C"))
    more = begin(0xF1) + put(b"A", b"1", major=0xF1) + begin(0xF2) + put(b"D", b"1", major=0xF2, blobs=[77]) + begin(0x101) + put(b"A", b"late", major=0x101)
    path = directory(pwal_0000=log, pwal_0001=more)
    to = str(tmp_path / "compacted")
    catalog = maintenance.compact_directory(spark, path, to)
    assert (catalog.max_epoch, catalog.max_blob, Catalog.read(to)) == (0x100, 77, catalog)
    wanted = begin(0) + b"".join(put(k, v, major=0, minor=0, blobs=b) for k, v, b in ((b"A", b"1", ()), (b"B", b"0", ()), (b"C", b"0", ()), (b"D", b"1", [77]))) + end(0)
    assert read(to) == {"pwal_0000.compacted": wanted}
    rows = changelog.snapshot(read_log(spark, to), durable_epoch(spark, to))
    assert {k.split("/")[1]: v for k, v in pairs(rows).items()} == {"A": "1", "B": "0", "C": "0", "D": "1"}


def test_compact_online(spark, directory):
    path = directory(pwal_0000=begin(1) + put(b"a", b"1", major=1) + put(b"b", b"1", major=1))
    live = lambda: {k.split("/")[1]: v for k, v in pairs(changelog.snapshot(read_log(spark, path, files=[n for n in os.listdir(path) if n not in Catalog.read(path).detached]), 9)).items()}
    assert maintenance.compact_online(spark, path, 2, now=1)
    assert live() == {"a": "1", "b": "1"}
    open(os.path.join(path, "pwal_0000"), "wb").write(begin(3) + put(b"a", b"2", major=3))
    append_durable(path, 3)
    assert live() == {"a": "2", "b": "1"}
    assert maintenance.compact_online(spark, path, 4, now=2) and live() == {"a": "2", "b": "1"}
    assert not maintenance.compact_online(spark, path, 5, now=3)
    assert len(maintenance.delete_detached(path)) == 2 and live() == {"a": "2", "b": "1"}


def test_rotate_detach_and_epoch_files(directory):
    path = directory(pwal_0000=FILES["normal"], pwal_0001=b"")
    assert maintenance.detach(path, skip_empty=True, now=1) == ["pwal_0000.00000000000001.0"]
    assert maintenance.rotate(path, 7, now=2) == ["epoch.00000000000002.7", "pwal_0001.00000000000002.7"]
    assert maintenance.drop_rotated_epoch_files(path) == ["epoch.00000000000002.7"] and open(os.path.join(path, "epoch"), "rb").read() == durable_file(7)


def test_restore(directory, tmp_path):
    path, to = directory(pwal_0000=FILES["normal"]), str(tmp_path / "restored")
    maintenance.restore(path, to)
    assert read(to) == read(path) and sorted(os.listdir(to)) == sorted(os.listdir(path))
    maintenance.restore(path, to, [("x-manifest.json", "x-manifest.json"), ("pwal_0000", "pwal_0000.1")])
    assert sorted(os.listdir(to)) == ["pwal_0000.1", "x-manifest.json"]
    for entries in ([("pwal_0000", "pwal_0000")], [("x-manifest.json", "x-manifest.json"), ("none", "none")], [("x-manifest.json", "../x-manifest.json")]):
        with pytest.raises(BadDirectory):
            maintenance.restore(path, to, entries)


def test_manifest(spark, directory):
    assert Manifest.loads('{"format_version":"1.0","persistent_format_version":1}').migrated()[1]
    assert not Manifest.new().migrated()[1]
    with pytest.raises(BadDirectory):
        Manifest.loads('{"format_version":"1.1","persistent_format_version":8,"instance_uuid":"u"}').check()
    for bad in ("", "[]", "{}", '{"format_version":"1.1","persistent_format_version":7}', '{"format_version":1,"persistent_format_version":7,"instance_uuid":"u"}'):
        with pytest.raises(BadDirectory):
            Manifest.loads(bad)
    assert [r.supported for r in manifests(spark, directory()).collect()] == [True]


def test_catalog(spark, directory):
    path = directory()
    whole = Catalog(7, 2002, {"pwal_0000.compacted": 1}, {"pwal_0000.01732800000000.0"})
    assert Catalog.loads(whole.dumps()) == whole
    for bad in ("", whole.dumps().replace("FOOTER", "X"), whole.dumps().replace("MAX_EPOCH_ID 7\n", ""), whole.dumps().replace("2002", "x"), whole.dumps().replace("DETACHED_PWAL", "OTHER")):
        with pytest.raises(BadDirectory):
            Catalog.loads(bad)
    whole.write(path)
    assert Catalog.read(path) == whole and {(r.kind, r.number) for r in catalog_rows(spark, path).collect()} == {("COMPACTED_FILE", 1), ("DETACHED_PWAL", None), ("MAX_EPOCH_ID", 7), ("MAX_BLOB_ID", 2002)}
    Catalog(8).write(path)
    open(os.path.join(path, "compaction_catalog"), "w").write("broken")
    assert Catalog.read(path) == whole


def test_blob_files_and_tags(spark, tmp_path):
    for i in (7, 8, 107):
        p = tmp_path / f"dir_{i % 100:02d}" / f"{i:016x}.blob"
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"x")
    (tmp_path / "dir_07" / "notes.txt").write_bytes(b"x")
    found = lambda: blobs.blob_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path"))
    assert sorted(r.blob_id for r in found().collect()) == [7, 8, 107]
    maintenance.delete_blobs(spark.createDataFrame([(8,), (9,)], "blob_id long"), str(tmp_path))
    assert sorted(r.blob_id for r in found().collect()) == [7, 107]
    tags = maintenance.EpochTags()
    tags.register("before", 5, "c")
    assert tags.find("before") == 5 and tags.find("none") is None and tags.table(spark).count() == 1
    tags.unregister("before")
    assert tags.table(spark).count() == 0
    assert maintenance.advance((1, 2), (1, 3)) == (1, 3)
    with pytest.raises(ValueError):
        maintenance.advance((1, 2), (1, 1))
    assert issubclass(DamagedLog, Exception)


def test_listing_and_deleting_objects_takes_no_more_tasks_for_more_of_them(spark, tmp_path):
    from epochlake.sources.blob_store import stored_files

    assert stored_files(spark, str(tmp_path / "none")).count() == 0
    for i in range(300):
        p = tmp_path / f"dir_{i % 3:02d}" / f"{i * 100 + i % 3:016x}.blob"
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"" if i == 5 else b"x")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / f"{1:016x}.blob").write_bytes(b"x")
    found = blobs.blob_files(stored_files(spark, str(tmp_path)))
    assert found.rdd.getNumPartitions() <= 3 and sorted(r.blob_id for r in found.collect()) == [i * 100 + i % 3 for i in range(300)]
    path = os.path.join(str(tmp_path), "log")
    set_up(path, "x-manifest.json")
    open(os.path.join(path, "pwal_0000"), "wb").write(begin(1) + put(b"a", b"1", major=1, blobs=[0, 10_000_000]))
    assert maintenance.compact_online(spark, path, 1, now=1, boundary=(1, 0), blob_root=str(tmp_path))
    assert [r.blob_id for r in found.collect()] == [0]  # the empty one went, too


def test_a_log_is_written_from_arrow_batches(spark, tmp_path):
    from pyspark.sql.datasource import DataSourceArrowWriter

    from epochlake.schema import CHANGE_LOG
    from epochlake.sources.wal import LogWriter

    assert issubclass(LogWriter, DataSourceArrowWriter)
    register(spark)
    row = ("x", 0, 0, -1, "valid", "normal_with_blob", -2, bytearray(b"k"), -3, None, None, [1, -4])
    gone = ("x", 1, 0, -1, "valid", "clear_storage", 5, None, 6, 7, None, None)
    spark.createDataFrame([row, gone], CHANGE_LOG).coalesce(1).write.format("epochlog").mode("append").save(str(tmp_path))
    got = read_log(spark, str(tmp_path)).drop("file", "offset", "snippet_no").orderBy("entry_type").collect()
    assert [tuple(r) for r in got] == [(-1, "valid", "clear_storage", 5, None, 6, 7, None, []), (-1, "valid", "normal_with_blob", -2, b"k", -3, 0, b"", [1, -4])]
