"""Log files and change logs for tests."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from epochlake.schema import CHANGE_LOG
from epochlake.sources.wal_format import entry, marker

STORAGE, MAJOR, MINOR = (int.from_bytes(x, "little") for x in (b"storage1", b"vermajor", b"verminor"))


def put(key: bytes = b"1234", value: bytes = b"1234", storage: int = STORAGE, major: int = MAJOR, minor: int = MINOR, blobs=()) -> bytes:
    return entry("normal_with_blob" if blobs else "normal_entry", storage, key, major, minor, value, blobs)


def begin(epoch: int) -> bytes:
    return marker("marker_begin", epoch)


def end(epoch: int) -> bytes:
    return marker("marker_end", epoch)


def invalid(epoch: int) -> bytes:
    return marker("marker_invalidated_begin", epoch)


E = put()
STRAY = bytes.fromhex("0120000000") + b"storage1" + b"1234" + b"vermajor" + b"verminor" + b"1234"

FILES = {
    "normal": begin(0xFF) + begin(0x100),
    "normal2": begin(0xF0) + E + begin(0xF1) + put(b"1235") + begin(0x100) + put(b"1236"),
    "nondurable": begin(0xFF) + begin(0x101),
    "repaired_nondurable": begin(0xF0) + E + invalid(0xF1) + put(b"1235") + begin(0x100) + put(b"1236"),
    "zerofill": begin(0xFF) + begin(0x101) + bytes(9),
    "truncated_normal_entry": begin(0xFF) + begin(0x101) + E[:9],
    "truncated_epoch_header": begin(0xFF) + E + begin(0x101)[:8],
    "truncated_invalidated_normal_entry": begin(0xFF) + invalid(0x101) + E[:9],
    "truncated_invalidated_epoch_header": begin(0xFF) + E + invalid(0x101)[:8],
    "allzero": bytes(9),
    "marker_end_only": begin(0x100) + E + end(0x100),
    "end_then_entry": begin(0x100) + E + end(0x100) + STRAY,
    "end_then_begin": begin(0x100) + E + end(0x100) + begin(0x101) + E + end(0x101),
    "end_then_invalid": begin(0x100) + E + end(0x100) + invalid(0x101) + E + end(0x101),
    "end_then_short_entry": begin(0x100) + E + end(0x100) + bytes.fromhex("01200000"),
    "short_end_only": begin(0x100) + E + end(0x100)[:8],
    "begin_partial_zerofill": begin(0x100)[:7] + bytes(1),
    "begin_then_zerofill": begin(0x100) + bytes(9),
    "entry_partial_zerofill": begin(0x100) + bytes.fromhex("01040000000400") + bytes(2),
    "entry_then_zerofill": begin(0x100) + E + bytes(9),
    "end_partial_zerofill": begin(0x100) + E + bytes.fromhex("0301010000") + bytes(1),
}


def durable_file(*epochs: int) -> bytes:
    return b"".join(marker("marker_durable", e) for e in epochs)


def u64(text: bytes) -> int:
    return struct.unpack("<Q", text)[0]


def change_log(spark, rows):
    """Rows (channel, snippet epoch, kind, storage, key, value, (major, minor)[, objects]); offsets by place."""
    kinds = {"put": "normal_entry", "del": "remove_entry", "truncate": "clear_storage", "drop": "remove_storage", "add": "add_storage"}
    out = []
    for i, (channel, epoch, kind, storage, key, value, version, *objects) in enumerate(rows):
        name = "normal_with_blob" if objects else kinds[kind]
        out.append((f"pwal_{channel:04d}", i, i, epoch, "valid", name, storage, key if key is None else key.encode(), *version, value if value is None else value.encode(), objects[0] if objects else []))
    # as an Arrow table: the rows then need no Python worker
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(CHANGE_LOG.names, r, strict=True)) for r in out], schema=to_arrow_schema(CHANGE_LOG)), CHANGE_LOG)


def pairs(df):
    """{storage/key: value} of a snapshot."""
    return {f"{r.storage_id}/{bytes(r.key).decode()}": bytes(r.value).decode() for r in df.collect()}
