"""Expressions on file names, paths and ids of a log directory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import ColumnOrName, _col

# Names in a log directory.
EPOCH, MANIFEST_SUFFIX, CATALOG, COMPACTED = "epoch", "-manifest.json", "compaction_catalog", "pwal_0000.compacted"
WAL_PREFIX, ACTIVE_WAL_LENGTH = "pwal_", 9
BLOB_DIRECTORIES = 100
BLOB_NAME = "^[0-9A-Fa-f]{16}[.]blob$"


def base_name(path: ColumnOrName) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def without_trailing_separators(path: ColumnOrName) -> Column:
    """The path without slashes at its end; the root stays."""
    return F.when(_col(path).rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(_col(path), "/+$", ""))


def parent(path: ColumnOrName) -> Column:
    """The folder that a path lies in; empty for a name alone."""
    clean = without_trailing_separators(path)
    return F.when(clean.rlike("^/[^/]*$"), F.lit("/")).otherwise(F.regexp_replace(F.regexp_replace(clean, "[^/]*$", ""), "/+$", ""))


def is_wal(name: ColumnOrName) -> Column:
    return _col(name).startswith(WAL_PREFIX)


def is_detached(name: ColumnOrName) -> Column:
    """Whether a log file has been put aside: its name is longer than an active one's."""
    return is_wal(name) & (F.length(_col(name)) > ACTIVE_WAL_LENGTH)


def is_epoch_file(name: ColumnOrName) -> Column:
    return _col(name).startswith(EPOCH)


def rotated_wal_name(channel: ColumnOrName, millis: ColumnOrName, epoch: ColumnOrName) -> Column:
    """pwal_NNNN.<14 digits of milliseconds>.<epoch>"""
    return F.format_string("pwal_%04d.%014d.%d", _col(channel).cast("long"), _col(millis).cast("long"), _col(epoch).cast("long"))


def rotated_parts(name: ColumnOrName) -> Column:
    """struct(channel, millis, epoch) of a rotated log's name; nulls if it isn't one."""
    pattern = r"^pwal_(\d{4})\.(\d{14})\.(\d+)$"
    return F.struct(*[F.when(_col(name).rlike(pattern), F.regexp_extract(_col(name), pattern, i)).cast("long").alias(n) for i, n in enumerate(("channel", "millis", "epoch"), 1)])


def blob_path(blob_id: ColumnOrName) -> Column:
    """Where a blob lies below the blob folder: dir_NN/<16 hex digits>.blob, NN its id mod 100 (unsigned)."""
    c = _col(blob_id)
    # 2^64 is 16 mod 100
    part = F.when(c < 0, F.pmod(F.pmod(c, F.lit(BLOB_DIRECTORIES)) + F.lit((1 << 64) % BLOB_DIRECTORIES), F.lit(BLOB_DIRECTORIES))).otherwise(F.pmod(c, F.lit(BLOB_DIRECTORIES)))
    return F.concat(F.lit("dir_"), F.lpad(part.cast("string"), 2, "0"), F.lit("/"), F.lpad(F.lower(F.hex(c)), 16, "0"), F.lit(".blob"))


def is_blob_name(name: ColumnOrName) -> Column:
    return _col(name).rlike(BLOB_NAME)


def blob_id_of(name: ColumnOrName) -> Column:
    """The id in a blob file's name, as a long of the same bits; null if it isn't such a name."""
    digit = lambda a: F.conv(F.substring(_col(name), a, 8), 16, 10).cast("long")
    return F.when(is_blob_name(name), F.shiftleft(digit(1), 32).bitwiseOR(digit(9)))


def endpoint(address: ColumnOrName) -> Column:
    """struct(host, port) of tcp://host:port; nulls for anything else."""
    pattern = r"^tcp://([^:]+):(\d+)$"
    ok = _col(address).rlike(pattern)
    return F.struct(F.when(ok, F.regexp_extract(_col(address), pattern, 1)).alias("host"), F.when(ok, F.regexp_extract(_col(address), pattern, 2)).cast("int").alias("port"))
