import hashlib
import hmac
import struct

from pyspark.sql import functions as F

from epochlake.functions import names, text
from epochlake.functions.tags import reference_tag, reference_tag_of
from epochlake.functions.versions import display, key_sid, signed, split_key_sid, u32_bytes, u64_bytes, u64_of


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_integers(spark):
    for v in (0, 1, 255, 2**40 + 7, 2**63, 2**64 - 1):
        c = F.lit(signed(v)).cast("long")
        assert bytes(one(spark, u64_bytes(c))) == struct.pack("<Q", v)
        assert one(spark, u64_of(u64_bytes(c))) == signed(v)
        assert int(one(spark, display(c))) == v
    assert bytes(one(spark, u32_bytes(F.lit(2**32 - 2)))) == struct.pack("<I", 2**32 - 2)
    assert one(spark, u64_of(F.lit(b"1234567"))) is None
    parts = one(spark, split_key_sid(key_sid(F.lit(7).cast("long"), F.lit(b"k\x00y"))))
    assert (parts.storage_id, bytes(parts.key)) == (7, b"k\x00y")


def test_blob_names(spark):
    for v in (0, 5, 99, 100, 2**32 + 1, 2**63 + 12, 2**64 - 1):
        path = one(spark, names.blob_path(F.lit(signed(v)).cast("long")))
        assert path == f"dir_{v % 100:02d}/{v:016x}.blob"
        assert one(spark, names.blob_id_of(names.base_name(F.lit(path)))) == signed(v)
    for bad in ("00.blob", "0123456789abcdeg.blob", "0123456789abcdef.blob2", ""):
        assert not one(spark, names.is_blob_name(F.lit(bad))) and one(spark, names.blob_id_of(F.lit(bad))) is None


def test_log_names(spark):
    name = one(spark, names.rotated_wal_name(F.lit(3), F.lit(1732800000000), F.lit(12)))
    assert name == "pwal_0003.01732800000000.12"
    assert tuple(one(spark, names.rotated_parts(F.lit(name)))) == (3, 1732800000000, 12)
    assert tuple(one(spark, names.rotated_parts(F.lit("pwal_0003")))) == (None, None, None)
    assert one(spark, names.is_detached(F.lit(name))) and not one(spark, names.is_detached(F.lit("pwal_0003")))
    assert not one(spark, names.is_wal(F.lit("epoch")))
    assert tuple(one(spark, names.endpoint(F.lit("tcp://host:1234")))) == ("host", 1234)
    assert tuple(one(spark, names.endpoint(F.lit("http://host:1234")))) == (None, None)


def test_previews(spark):
    assert one(spark, text.ascii_preview(F.lit(b"a b\x00\xff~"))) == "a_b..~"
    assert one(spark, text.ascii_preview(F.lit(b"x" * 21))) == "x" * 20 + "..."
    assert one(spark, text.hex_preview(F.lit(b"\x01\xab"))) == "01ab"
    assert one(spark, text.escaped(F.lit("grün".encode()))) == "grün"
    assert one(spark, text.escaped(F.lit(b"\xff\x00"))) == "\\xff00"


def test_tags(spark):
    for secret in (bytes(range(16)), b"k" * 100):
        for blob in (0, 12345, 2**64 - 1):
            wanted = struct.unpack("<Q", hmac.new(secret, struct.pack("<QQ", blob, 9), hashlib.sha256).digest()[:8])[0]
            assert reference_tag_of(blob, 9, secret) == wanted
            assert one(spark, reference_tag(F.lit(signed(blob)).cast("long"), F.lit(9).cast("long"), secret)) == signed(wanted)


def test_folders_of_paths(spark):
    from epochlake.functions.names import parent, without_trailing_separators

    rows = spark.createDataFrame([(p,) for p in ("/a/b//", "a", "/a", "//", "a/b/c", "/")], "p string")
    got = [tuple(r) for r in rows.select(without_trailing_separators("p"), parent("p")).collect()]
    assert got == [("/a/b", "/a"), ("a", ""), ("/a", "/"), ("/", "/"), ("a/b/c", "a/b"), ("/", "/")]
