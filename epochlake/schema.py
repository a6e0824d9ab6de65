"""The change log's schemas, the names of its entry types, and the codes of a damaged log."""

from __future__ import annotations

from pyspark.sql import types as T

# The entry types of the log format by their code.
ENTRY_TYPES = {
    1: "normal_entry",
    2: "marker_begin",
    3: "marker_end",
    4: "marker_durable",
    5: "remove_entry",
    6: "marker_invalidated_begin",
    7: "clear_storage",
    8: "add_storage",
    9: "remove_storage",
    10: "normal_with_blob",
}

# What reading a log file can come to, by severity.
PARSE_CODES = {
    "ok": 0x00,
    "repaired": 0x01,
    "broken_after_marked": 0x11,
    "nondurable_entries": 0x40,
    "broken_after": 0x41,
    "corrupted_durable_entries": 0x42,
    "unexpected": 0x81,
    "failed": 0xFF,
}

PUTS = ("normal_entry", "normal_with_blob")
REMOVE = "remove_entry"
#: Both end the life of every row of a storage that is older.
CLEARS = ("clear_storage", "remove_storage")
#: Entries that carry a key.
POINTS = (*PUTS, REMOVE)

VALID, NONDURABLE, INVALIDATED = "valid", "nondurable", "invalidated"

CHANGE_LOG = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("snippet_no", T.IntegerType()),
        T.StructField("snippet_epoch", T.LongType()),
        T.StructField("snippet_state", T.StringType()),
        T.StructField("entry_type", T.StringType()),
        T.StructField("storage_id", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("major", T.LongType()),
        T.StructField("minor", T.LongType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("blob_ids", T.ArrayType(T.LongType())),
    ]
)

SCAN_REPORT = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("parse_code", T.IntegerType()),
        T.StructField("parse_offset", T.LongType()),
        T.StructField("max_epoch", T.LongType()),
        T.StructField("entries", T.LongType()),
        T.StructField("counted", T.LongType()),
        T.StructField("modified", T.BooleanType()),
    ]
)
