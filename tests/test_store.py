import warnings

import pytest

from epochlake.plans.store import READY, SHUT, CompactionOptions, Configuration, Store
from epochlake.sources.directory import BadDirectory
from tests.logs import change_log, pairs


def store(spark, path):
    return Store(spark, Configuration(str(path / "log"), blob_root=str(path / "blobs")))


def test_a_store_from_its_opening_to_its_end(spark, tmp_path):
    s = store(spark, tmp_path)
    with pytest.raises(RuntimeError):
        s.write(change_log(spark, [(0, 1, "put", 1, "a", "x", (1, 0))]))
    assert s.ready().rows.count() == 0 and s.state == READY
    with pytest.raises(BadDirectory):
        store(spark, tmp_path).ready()
    assert s.write(change_log(spark, [(0, 1, "put", 1, "a", "x", (1, 0)), (0, 1, "put", 1, "b", "x", (1, 1))])) == 1
    s.tags.register("first", 1)
    with pytest.raises(ValueError):
        s.write(change_log(spark, [(0, 1, "put", 1, "c", "x", (1, 2))]))
    s.write(change_log(spark, [(0, 2, "put", 1, "a", "y", (2, 0)), (0, 3, "del", 1, "b", None, (3, 0)), (1, 3, "put", 2, "o", "v", (3, 1), [1])]))
    assert pairs(s.snapshot()) == {"1/a": "y", "2/o": "v"} and pairs(s.snapshot("first")) == {"1/a": "x", "1/b": "x"}
    with pytest.raises(KeyError):
        s.snapshot("no tag")
    assert s.compact(CompactionOptions(2)) and not s.compact()
    assert s.switch_epoch(9) == 9
    s.write(change_log(spark, [(0, 10, "put", 1, "z", "w", (10, 0))]))
    assert pairs(s.snapshot()) == {"1/a": "y", "2/o": "v", "1/z": "w"}
    assert [bytes(r.key) for r in s.scan(1, bytearray(b"a"), inclusive=False).collect()] == [b"z"]
    with pytest.warns(UserWarning):
        assert s.switch_epoch(4) == 10
    s.shutdown()
    assert s.state == SHUT and [r.kind for r in s.events.table(spark).orderBy("at").collect()] == ["wal_started", "wal_stored", "wal_stored", "wal_compacted", "wal_compacted", "wal_stored"]
    with pytest.warns(UserWarning):
        s.snapshot()

    again = store(spark, tmp_path)
    found = again.ready()
    assert pairs(found.rows) == {"1/a": "y", "2/o": "v", "1/z": "w"} and (found.durable_epoch, found.next_blob) == (10, 2)
    pool = again.pool()
    assert pool.register_data(b"new") == 2
    again.drop_garbage(spark.createDataFrame([(1,), (2,)], "blob_id long"), found)
    assert pool.find(2)  # given after the store was opened
    again.shutdown()


def test_configuration():
    with pytest.raises(ValueError):
        Configuration("")
    with pytest.raises(ValueError):
        Configuration("x", parallelism=0)
    assert CompactionOptions(boundary=(1, 0)).collects and not CompactionOptions().collects


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    s = store(spark, tmp_path)
    s.ready()
    rows = change_log(spark, [(0, k, "put", k % 3, f"k{k}", "x", (k, 0)) for k in range(1, 40)])
    bad = rows.withColumn("value", F.when(F.col("snippet_epoch") == 30, F.raise_error(F.lit("no value")).cast("binary")).otherwise(F.col("value")))
    with warnings.catch_warnings(), pytest.raises(Exception, match="no value"):
        s.write(bad)
    assert s.snapshot().count() == 0 and s.durable_epoch == 0
    assert not [n for n in __import__("os").listdir(tmp_path / "log") if "writing" in n]
    s.write(rows)
    assert s.snapshot().count() == 39
    s.shutdown()


@pytest.mark.parametrize("wait", [True, False])
def test_a_replica_follows_the_store(spark, tmp_path, wait):
    from epochlake.streaming.replica import Replica

    replica = Replica(spark, str(tmp_path / "replica"))
    s = Store(spark, Configuration(str(tmp_path / "log")), replica, wait)
    s.ready()
    for epoch in (1, 2, 3):
        s.write(change_log(spark, [(0, epoch, "put", 1, "a", f"v{epoch}", (epoch, 0)), (0, epoch, "put", 1, f"k{epoch}", "x", (epoch, 1))]))
    s.settle()
    assert replica.committed() == 3 and pairs(replica.read()) == pairs(s.snapshot()) == {"1/a": "v3", "1/k1": "x", "1/k2": "x", "1/k3": "x"}
    s.replica.apply = lambda rows, epoch: 1 / 0
    with pytest.raises(ZeroDivisionError):
        s.write(change_log(spark, [(0, 4, "put", 1, "z", "w", (4, 0))]))
        s.settle()
    assert s.replica is None and s.snapshot().count() == 5 and replica.committed() == 3
    s.shutdown()


def test_a_write_is_dealt_to_all_files_even_of_one_storage(spark, tmp_path):
    import os

    s = Store(spark, Configuration(str(tmp_path / "log"), parallelism=4))
    s.ready()
    s.write(change_log(spark, [(0, 1 + k // 100, "put", 1, f"k{k % 100}", f"v{k}", (k, 0)) for k in range(300)]))
    sizes = [os.path.getsize(tmp_path / "log" / n) for n in os.listdir(tmp_path / "log") if n.startswith("pwal_")]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)
    assert pairs(s.snapshot()) == {f"1/k{k}": f"v{k + 200}" for k in range(100)}
    s.shutdown()
