import os

import pytest

from epochlake.operators import changelog
from epochlake.plans import maintenance, recovery
from epochlake.sources.blob_store import BadBlob, BlobPool
from epochlake.sources.directory import BadDirectory, Catalog, Manifest, set_up
from epochlake.sources.wal import append_durable, dump, dump_lines, read_log
from tests.logs import begin, end, put

NAME = "x-manifest.json"


def log_dir(path, files, epoch):
    set_up(str(path), NAME)
    for name, data in files.items():
        (path / name).write_bytes(data)
    append_durable(str(path), epoch)
    return str(path)


def keys(rows):
    return sorted((bytes(r.key), bytes(r.value)) for r in rows.collect())


def snippet(epoch, *entries):
    return begin(epoch) + b"".join(entries) + end(epoch)


def two_part(spark, path):
    d = log_dir(path, {"pwal_0000": snippet(3, put(b"a", b"1", major=3), put(b"b", b"1", major=3))}, 3)
    assert maintenance.compact_online(spark, d, 3, now=1)
    (path / "pwal_0001").write_bytes(snippet(5, put(b"a", b"2", major=5), put(b"c", b"2", major=5)) + snippet(9, put(b"z", b"9", major=9)))
    append_durable(d, 5)
    return d


def test_recover_merges_base_and_delta(spark, tmp_path):
    d = two_part(spark, tmp_path / "log")
    base, delta = recovery.selected_logs(spark, d)
    assert base == ["pwal_0000.compacted"] and delta == ["pwal_0001"]
    found = recovery.recover(spark, d, NAME)
    assert keys(found.rows) == [(b"a", b"2"), (b"b", b"1"), (b"c", b"2")]
    assert (found.durable_epoch, found.max_epoch, found.next_blob) == (5, 9, 1)
    assert keys(recovery.recover(spark, d, epoch=9).rows)[-1] == (b"z", b"9")


@pytest.mark.parametrize("broken_at", ["before", "moved", "between", "named"])
def test_an_online_compaction_that_was_broken_off(spark, tmp_path, broken_at, monkeypatch):
    d = two_part(spark, tmp_path / "log")
    want = keys(recovery.recover(spark, d).rows)

    class Stop(Exception):
        pass

    replace, write, count = os.replace, Catalog.write, [0]

    def stopping(a, b):
        if str(a).endswith(".compacted") and str(b).startswith(d):
            count[0] += 1
            if broken_at == "before" or broken_at == "moved" and count[0] == 2:
                raise Stop
        replace(a, b)

    def no_catalog(self, path):
        if broken_at == "named":
            write(self, path)
        raise Stop

    monkeypatch.setattr(maintenance.os, "replace", stopping)
    if broken_at in ("between", "named"):
        monkeypatch.setattr(Catalog, "write", no_catalog)
    with pytest.raises(Stop):
        maintenance.compact_online(spark, d, 5, now=2)
    monkeypatch.undo()
    assert keys(recovery.recover(spark, d).rows) == want
    assert not [n for n in os.listdir(d) if n.endswith(".prev") or n.startswith("compaction_")] or set(os.listdir(d)) >= {"compaction_catalog"}
    assert not [n for n in os.listdir(d) if n.endswith(".prev") or n == maintenance.PENDING]
    assert maintenance.compact_online(spark, d, 5, now=3) == (broken_at != "named")
    assert keys(recovery.recover(spark, d).rows) == want


def test_offline_compaction_options(spark, tmp_path):
    d = two_part(spark, tmp_path / "log")
    before = sorted(os.listdir(d))
    assert maintenance.compact_offline(spark, d, confirm=lambda work: False) is None and sorted(os.listdir(d)) == before
    maintenance.compact_offline(spark, d, dry_run=True, work_dir=str(tmp_path / "work"))
    assert sorted(os.listdir(d)) == before and not (tmp_path / "work").exists()
    (tmp_path / "full").mkdir()
    (tmp_path / "full" / "file").write_text("")
    with pytest.raises(BadDirectory):
        maintenance.compact_offline(spark, d, work_dir=str(tmp_path / "full"))
    (tmp_path / "link").symlink_to(d)
    with pytest.raises(BadDirectory):
        maintenance.compact_offline(spark, str(tmp_path / "link"))
    want = keys(changelog.snapshot(read_log(spark, d, 5), 5))
    maintenance.compact_offline(spark, d, 5, backup=True)
    assert keys(read_log(spark, d)) == want and Catalog.read(d).max_epoch == 5
    assert len([n for n in os.listdir(tmp_path) if n.endswith(".backup")]) == 1


def test_migration(tmp_path):
    name = tmp_path / NAME
    name.write_text(Manifest(4, "1.1", "id").dumps())
    assert recovery.migrate(str(tmp_path), NAME) == (4, 7)
    assert Manifest.loads(name.read_text()) == Manifest(7, "1.1", "id") and os.listdir(tmp_path) == [NAME]
    os.rename(name, f"{name}.back")
    name.write_text("{")  # damaged: the backup takes its place
    assert recovery.migrate(str(tmp_path), NAME) == (7, 7) and os.listdir(tmp_path) == [NAME]
    name.write_text(Manifest(8).dumps())
    with pytest.raises(BadDirectory):
        recovery.migrate(str(tmp_path), NAME)
    name.unlink()
    with pytest.raises(BadDirectory):
        recovery.migrate(str(tmp_path), NAME)


def test_old_formats_are_set_aside_when_opened(spark, tmp_path):
    d = log_dir(tmp_path / "log", {"pwal_0000": snippet(3, put(b"a", b"1"))}, 3)
    (tmp_path / "log" / NAME).write_text(Manifest(5, "1.1", "id").dumps())
    assert keys(recovery.recover(spark, d, NAME).rows) == [(b"a", b"1")]
    assert "pwal_0000" not in os.listdir(d)


def test_pool_of_objects(tmp_path):
    numbers = iter(range(7, 50))
    pool = BlobPool(str(tmp_path), lambda: next(numbers))
    source = tmp_path / "source"
    source.write_bytes(b"file")
    a, b, c = pool.register_data(b"data"), pool.register_file(str(source)), pool.duplicate(7)
    assert (a, b, c) == (7, 8, 9) and pool.find(9).path.read_bytes() == b"data" and source.exists()
    assert pool.register_file(str(source), temporary=True) == 10 and not source.exists()
    with pytest.raises(BadBlob):
        pool.register_file(str(source))
    with pytest.raises(BadBlob):
        pool.duplicate(99)
    persistent = {8, 9, 1000}
    assert pool.release(persistent) == [7, 10] and persistent == {1000}
    assert [bool(pool.find(i)) for i in range(7, 11)] == [False, True, True, False]
    with pytest.raises(BadBlob):
        pool.register_data(b"late")


def test_dump_ends_with_what_cannot_be_read(spark, tmp_path):
    d = log_dir(tmp_path / "log", {"pwal_0000": snippet(3, put(b"k y", b"v\x00")) + put()[:9], "pwal_0001": b"\x00"}, 3)
    rows = sorted(tuple(r) for r in dump(spark, d).select("file", "entry_type", "epoch_id", "epoch").collect())
    assert [r[1] for r in rows if r[0] == "pwal_0000"] == ["marker_begin", "marker_end", "normal_entry", "torn"] and ("pwal_0001", "unknown", None, None) in rows
    lines = [r.line for r in dump_lines(dump(spark, d)).orderBy("file", "offset").collect()]
    assert lines[0] == "marker_begin epoch_id=3" and lines[1].endswith(" key=k_y value=v.")


def test_too_many_logs_are_refused(spark, tmp_path):
    d = log_dir(tmp_path / "log", {"pwal_9999": snippet(3, put())}, 3)
    maintenance.register(spark)
    with pytest.raises(Exception, match="rotate first"):
        read_log(spark, d, 3).write.format("epochlog").mode("append").save(d)
    assert sorted(n for n in os.listdir(d) if "writing" in n or n.startswith("pwal")) == ["pwal_9999"]


def test_snapshots_at_equal_one_at_a_time(spark):
    from epochlake.plans.mapping import events_log

    log = events_log(spark, "/root/testdata/sf0.001") if os.path.isdir("/root/testdata/sf0.001") else pytest.skip("no test tables")
    got = sorted(map(tuple, changelog.snapshots_at(log, [2, 5]).select("as_of", "storage_id", "key", "value").collect()))
    want = sorted((e, *r) for e in (2, 5) for r in changelog.snapshot(changelog.as_of(log, e), e).select("storage_id", "key", "value").collect())
    assert got == want
