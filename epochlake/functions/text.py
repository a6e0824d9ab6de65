"""Printable forms of keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .versions import ColumnOrName, _col

PREVIEW_BYTES = 20


def _latin(b: Column) -> Column:
    return F.decode(b, "ISO-8859-1")


def ascii_preview(b: ColumnOrName, most: int = PREVIEW_BYTES) -> Column:
    """The first bytes as ASCII: a space as _, what can't be printed as a dot; ... if there are more."""
    b = _col(b)
    head = F.regexp_replace(F.translate(_latin(F.substring(b, 1, most)), " ", "_"), r"[^\x21-\x7e]", ".")
    return F.concat(head, F.when(F.octet_length(b) > most, F.lit("...")).otherwise(F.lit("")))


def hex_preview(b: ColumnOrName, most: int = PREVIEW_BYTES) -> Column:
    """The first bytes in lower hexadecimal; ... if there are more."""
    b = _col(b)
    return F.concat(F.lower(F.hex(F.substring(b, 1, most))), F.when(F.octet_length(b) > most, F.lit("...")).otherwise(F.lit("")))


def escaped(b: ColumnOrName) -> Column:
    r"""Text as it is where it is UTF-8 without control characters, else hexadecimal after \x."""
    b = _col(b)
    text = b.cast("string")
    plain = F.is_valid_utf8(text) & ~text.rlike(r"[\x00-\x1f\x7f]")
    return F.when(plain, text).otherwise(F.concat(F.lit("\\x"), F.lower(F.hex(b))))
