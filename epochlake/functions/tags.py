"""Reference tags of blobs: the first eight bytes of an HMAC-SHA256 over the blob's id and a transaction's."""

from __future__ import annotations

import hashlib
import hmac
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import ColumnOrName, _col, u64_bytes, u64_of

BLOCK, TAG_BYTES = 64, 8


def reference_tag(blob_id: ColumnOrName, transaction_id: ColumnOrName, secret: bytes) -> Column:
    """The tag as a long, of the two ids as 16 little-endian bytes. Built from sha2, so it stays in the JVM."""
    key = (hashlib.sha256(secret).digest() if len(secret) > BLOCK else secret).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    message = F.concat(u64_bytes(_col(blob_id)), u64_bytes(_col(transaction_id)))
    digest = F.unhex(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256))
    return u64_of(digest)


def reference_tag_of(blob_id: int, transaction_id: int, secret: bytes) -> int:
    """The same for one blob, unsigned; ids are unsigned 64-bit integers."""
    digest = hmac.new(secret, struct.pack("<QQ", blob_id, transaction_id), hashlib.sha256).digest()
    return struct.unpack("<Q", digest[:TAG_BYTES])[0]
