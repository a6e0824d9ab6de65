import pytest
from pyspark.sql import functions as F

from epochlake.functions.versions import key_sid, unsigned
from epochlake.operators import blobs, changelog
from epochlake.operators.bounds import with_previous
from tests.logs import change_log, pairs

PUTS = [(0, 1, "put", 42, "42-100", "v1", (100, 4)), (0, 1, "put", 43, "43-100", "v2", (100, 4))]
CASES = {
    "delete": ([(0, 1, "put", 42, k, "v" + k, (100, 4)) for k in ("k1", "k2", "k3")] + [(0, 1, "del", 42, "k2", None, (128, 0))], {"42/k1": "vk1", "42/k3": "vk3"}),
    "drop": ([*PUTS, (0, 1, "drop", 42, None, None, (110, 4))], {"43/43-100": "v2"}),
    "truncate then insert": ([*PUTS, (0, 1, "truncate", 42, None, None, (110, 4)), (0, 1, "put", 42, "42-120", "v3", (120, 4))], {"43/43-100": "v2", "42/42-120": "v3"}),
    "at the cutoff": ([*PUTS, (0, 1, "truncate", 42, None, None, (100, 4))], {"42/42-100": "v1", "43/43-100": "v2"}),
    "adding does nothing": ([*PUTS, (0, 1, "add", 42, None, None, (110, 4))], {"42/42-100": "v1", "43/43-100": "v2"}),
    "restart": ([(0, 1, "put", 2, "k", "v", (1, 0)), (0, 3, "put", 2, "k", "v2", (2, 0))], {"2/k": "v2"}),
    "long transactions": ([(0, 1, "put", 2, "k", "old", (1, 5)), (0, 1, "put", 2, "k", "new", (1, -(2**63)))], {"2/k": "new"}),
    "ties: the last wins": ([(0, 1, "put", 2, "k", "a", (1, 0)), (0, 1, "put", 2, "k", "b", (1, 0))], {"2/k": "b"}),
    "not durable": ([(0, 1, "put", 2, "k", "v", (1, 0)), (0, 11, "put", 2, "k", "late", (2, 0))], {"2/k": "v"}),
    "empty": ([], {}),
}


@pytest.mark.parametrize("name", CASES)
def test_snapshot(spark, name):
    rows, wanted = CASES[name]
    log = change_log(spark, rows)
    assert pairs(changelog.snapshot(log, 10)) == wanted
    assert pairs(changelog.live(changelog.latest_by_window(changelog.drop_cleared(changelog.durable(log, 10), changelog.cutoffs(log))))) == wanted
    # a base from any earlier epoch and the rest as delta come to the same, where no version is below the base's
    if name not in ("at the cutoff", "drop", "truncate then insert"):
        merged = changelog.merge_base(changelog.snapshot(log.filter("snippet_epoch <= 1"), 1), log.filter("snippet_epoch > 1"), 10)
        assert pairs(merged) == wanted


def test_offline_compaction(spark):
    log = change_log(spark, [(0, 0xF0, "put", 1, k, "0", (0xF0, 7)) for k in "ABC"] + [(1, 0xF1, "put", 1, "A", "1", (0xF1, 7)), (1, 0xF2, "del", 1, "C", None, (0xF2, 7))])
    rows = changelog.compact(log, 0x100)
    assert pairs(rows) == {"1/A": "1", "1/B": "0"}
    assert {(r.major, r.minor, r.snippet_epoch) for r in rows.collect()} == {(0, 0, 0)}


def test_tombstones_over_a_base(spark):
    before = change_log(spark, [(0, 1, "put", 1, "key1", "a", (1, 0)), (0, 1, "del", 1, "key1", None, (1, 1)), (0, 1, "del", 1, "key4", None, (1, 0)), (1, 1, "put", 2, "key2", "b", (1, 0)), (2, 1, "del", 1, "key3", None, (1, 0)), (2, 1, "put", 1, "key3", "c", (1, 3))])
    after = change_log(spark, [(0, 2, "put", 1, "key11", "a", (2, 0)), (0, 2, "del", 1, "key11", None, (2, 1)), (0, 2, "del", 1, "key41", None, (2, 0)), (1, 2, "put", 2, "key21", "b", (2, 0)), (2, 2, "del", 1, "key31", None, (2, 0)), (2, 2, "put", 1, "key31", "c", (2, 3))])
    merged = changelog.merge_base(changelog.compact(before, 1), after, 2)
    assert [bytes(r.key).decode() for r in changelog.in_key_order(merged).collect()] == ["key3", "key31", "key2", "key21"]


def test_delta_wins_without_regard_to_versions(spark):
    base = changelog.snapshot(change_log(spark, [(0, 1, "put", 1, "a", "base", (50, 0)), (0, 1, "put", 1, "b", "base", (50, 0)), (0, 1, "put", 2, "c", "base", (50, 0))]), 1)
    delta = change_log(spark, [(0, 2, "put", 1, "a", "delta", (2, 0)), (0, 2, "del", 1, "b", None, (2, 0)), (0, 2, "truncate", 2, None, None, (2, 0))])
    assert pairs(changelog.merge_base(base, delta, 2)) == {"1/a": "delta"}


def test_time_travel_and_file_order(spark):
    log = change_log(spark, [(c, e, "put", e % 3, f"k{e % 5}", f"{e}", (e, c)) for e in range(1, 20) for c in range(2)] + [(0, 12, "truncate", 1, None, None, (12, 0))])
    for e in (0, 5, 12, 19):
        assert pairs(changelog.snapshot(log, e)) == pairs(changelog.snapshot(changelog.as_of(log.orderBy(F.desc("offset")), e), e))
    assert not changelog.snapshot(log, 0).collect()


def test_unsigned_order(spark):
    values = [1, 5, -(2**63), -1]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "v long")
    assert [r.v for r in df.orderBy(unsigned("v")).collect()] == values


def test_key_order_is_by_bytes(spark):
    rows = spark.createDataFrame([(256, b"a"), (1, b"b"), (1, b"a"), (0, b"\x80")], "storage_id long, key binary")
    assert [(r.storage_id, bytes(r.key)) for r in rows.orderBy(key_sid()).collect()] == [(0, b"\x80"), (256, b"a"), (1, b"a"), (1, b"b")]


def test_ordered_reads(spark):
    rows = spark.createDataFrame([("f", i, bytes([k])) for i, k in enumerate([1, 2, 2, 5])], "file string, offset long, k binary")
    assert [r.offset for r in changelog.checked_order(rows, "file", "offset", F.col("k")).orderBy("offset").collect()] == [0, 1, 3]
    bad = rows.unionByName(spark.createDataFrame([("f", 9, b"\x03")], rows.schema))
    assert [r.offset for r in changelog.order_violations(bad, "file", "offset", F.col("k")).collect()] == [9]
    with pytest.raises(Exception, match="out of order"):
        changelog.checked_order(bad, "file", "offset", F.col("k")).collect()


def test_lookups(spark):
    rows = changelog.snapshot(change_log(spark, [(0, 1, "put", 1, k, k, (1, 0)) for k in "abc"] + [(0, 1, "put", 2, "b", "x", (1, 0))]), 1)
    assert pairs(changelog.point_lookup(rows, 1, b"b")) == {"1/b": "b"}
    assert not changelog.point_lookup(rows, 3, b"b").collect()
    assert [bytes(r.key) for r in changelog.ordered_scan(rows, 1, b"b").collect()] == [b"b", b"c"]
    assert [bytes(r.key) for r in changelog.ordered_scan(rows, 1, b"b", inclusive=False).collect()] == [b"c"]
    assert changelog.partitioned(rows, 3).rdd.getNumPartitions() == 3
    with pytest.raises(ValueError):
        changelog.partitioned(rows, 0)


def test_with_previous_over_many_spans(spark):
    rows = spark.createDataFrame([(g, i * 3, i if i % 4 else None) for g in "ab" for i in range(50)], "g string, o long, v int")
    for span in (1, 7, 10_000):
        got = {(r.g, r.o): r.p for r in with_previous(rows, "g", "o", F.col("v"), "p", span).collect()}
        assert all(got[g, i * 3] == (i - 1 if i and (i - 1) % 4 else None) for g in "ab" for i in range(50))
        got = {(r.g, r.o): r.p for r in with_previous(rows, "g", "o", F.col("v"), "p", span, last_known=True).collect()}
        assert all(got[g, i * 3] == (i if i % 4 else i - 1 if i else None) for g in "ab" for i in range(50))


def blob_log(spark):
    return change_log(
        spark,
        [
            (0, 1, "put", 1, "blob_key1", "a", (1, 0), [1001, 1002]),
            (0, 1, "put", 1, "blob_key2", "b", (1, 1), [1003]),
            (0, 1, "put", 1, "noblob_key1", "c", (1, 2)),
            (0, 1, "put", 1, "noblob_key2", "d", (1, 3)),
            (0, 2, "put", 1, "blob_key1", "e", (2, 0), [2001, 2002]),
            (0, 2, "put", 1, "noblob_key1", "f", (2, 1)),
        ],
    )


def test_blob_collection(spark):
    log = blob_log(spark)
    found = spark.createDataFrame([(i,) for i in (1001, 1002, 1003, 2001, 2002, 9999)], "blob_id long")
    ids = lambda df: sorted(r.blob_id for r in df.collect())
    assert blobs.max_blob_id(log).first()[0] == 2002 and blobs.max_blob_id(log, 5000).first()[0] == 5000
    assert ids(blobs.gc_at_compaction(log, 2, (3, 0), found, 2002)) == [1001, 1002]
    assert ids(blobs.gc_at_compaction(log, 2, (1, 0), found, 2002)) == []  # readers may still see all
    assert ids(blobs.gc_at_compaction(log, 2, (3, 0), found, 2002, compacted_epoch=3)) == []
    assert ids(blobs.gc_at_startup(log, 2, found, 2002)) == [1001, 1002]
    cleared = log.unionByName(change_log(spark, [(0, 2, "truncate", 1, None, None, (9, 0))]))
    assert ids(blobs.gc_at_startup(cleared, 2, found, 2002)) == [1001, 1002]
    assert ids(blobs.gc_exact(cleared, 2, found, 2002)) == [1001, 1002, 1003, 2001, 2002]
    assert ids(blobs.available(found, found.filter("blob_id <> 1003"), 2002)) == [1001, 1002, 2001]
    released, left = blobs.settle_pool(found.filter("blob_id > 2000"), found.filter("blob_id < 2002"))
    assert (ids(released), ids(left)) == ([2002, 9999], [1001, 1002, 1003])


@pytest.mark.parametrize("kinds", [("normal_entry", "remove_entry"), ("normal_entry", "normal_entry")])
def test_equal_versions_without_places_do_not_depend_on_the_order_of_rows(spark, kinds):
    rows = [(1, 7, 5, 5, 2, kinds[0], 10.0), (1, 7, 5, 5, 2, kinds[1], 20.0), (1, 7, 5, 5, 1, "normal_entry", 90.0)]
    schema = "storage_id long, key long, snippet_epoch long, major long, minor long, entry_type string, value double"
    for given in (rows, rows[::-1]):
        log = spark.createDataFrame(given, schema).coalesce(1)
        for newest in (changelog.latest(log), changelog.latest_by_window(log)):
            assert [(r.entry_type, r.value) for r in newest.collect()] == [(kinds[1], 20.0)]
        assert changelog.snapshots_at(log, [5]).count() == (kinds[1] == "normal_entry")
