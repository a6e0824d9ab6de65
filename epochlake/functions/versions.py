"""Expressions on versions and keys: unsigned order, version structs, sort keys, little-endian integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unsigned(c: ColumnOrName) -> Column:
    """A long whose signed order is the unsigned order of the long c. Null stays null."""
    return _col(c).bitwiseXOR(F.lit(-(1 << 63)))


def version(major: ColumnOrName = "major", minor: ColumnOrName = "minor") -> Column:
    """A struct that orders as write versions do: by major, then minor, both unsigned."""
    return F.struct(unsigned(major).alias("major"), unsigned(minor).alias("minor"))


def version_at(major: int, minor: int = 0) -> Column:
    """A constant to compare with version(); major and minor from 0 to 2^64 - 1."""
    return version(F.lit(signed(major)), F.lit(signed(minor)))


def signed(value: int) -> int:
    """The long with the bits of an unsigned 64-bit integer."""
    if not 0 <= value < 1 << 64:
        raise ValueError(f"{value} is no unsigned 64-bit integer")
    return value - (1 << 64) if value >> 63 else value


def display(c: ColumnOrName) -> Column:
    """The unsigned value of a long as decimal(20,0)."""
    c = _col(c)
    wide = c.cast("decimal(20,0)")
    return F.when(c < 0, (wide + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(wide)


def u64_bytes(c: ColumnOrName) -> Column:
    """The eight little-endian bytes of a long."""
    return _little(F.lpad(F.hex(_col(c)), 16, "0"), 8)


def u32_bytes(c: ColumnOrName) -> Column:
    """The four little-endian bytes of a number from 0 to 2^32 - 1."""
    return _little(F.lpad(F.hex(_col(c).cast("long")), 8, "0"), 4)


def _little(digits: Column, n: int) -> Column:
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(n - 1, -1, -1)]))


def u64_of(b: ColumnOrName, at: int = 0) -> Column:
    """The long in the eight little-endian bytes of a binary from byte `at`; null where they don't exist."""
    b = _col(b)
    digits = F.hex(b)
    big = F.concat(*[F.substring(digits, 2 * (at + i) + 1, 2) for i in range(7, -1, -1)])
    high, low = F.conv(F.substring(big, 1, 8), 16, 10).cast("long"), F.conv(F.substring(big, 9, 8), 16, 10).cast("long")
    return F.when(F.octet_length(b) >= at + 8, F.shiftleft(high, 32).bitwiseOR(low))


def key_sid(storage: ColumnOrName = "storage_id", key: ColumnOrName = "key") -> Column:
    """The binary by which a snapshot is ordered: the storage's eight little-endian bytes, then the key."""
    return F.concat(u64_bytes(storage), _col(key).cast("binary"))


def split_key_sid(c: ColumnOrName) -> Column:
    """struct(storage_id, key) of a key_sid."""
    c = _col(c)
    return F.struct(u64_of(c).alias("storage_id"), F.substring(c, 9, 1 << 30).alias("key"))
