"""Key encodings whose byte order is the order wanted. Spark compares BINARY bytewise, and a prefix before what it begins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a stored row has besides its key and value, and the longest key.
HEADER, LONGEST = 8, 2999
#: Separates the parts of a composite key of text; no UTF-8 text has this byte.
PART, HIGH = b"\xfe", b"\xff"


def integer_key(n: Column, width: int = 8) -> Column:
    """A non-negative whole number as `width` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def composite_key(*parts: Column) -> Column:
    """Text parts joined so that the order is by the first part, then the next."""
    out = [F.encode(parts[0], "UTF-8")]
    for p in parts[1:]:
        out += [F.lit(PART), F.encode(p, "UTF-8")]
    return F.concat(*out)


def map_key(map_id: Column, key: Column) -> Column:
    """A record's key within one table of many maps: four big-endian bytes of the map's id, then the key."""
    return F.concat(integer_key(map_id, 4), key)


def stamped_key(key: Column, seq: Column) -> Column:
    return F.concat(key, F.lit(b"\x00"), integer_key(seq))


def stamp_of(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, -8, 8)), 16, 10).cast("long")


def row_bytes(key: Column, value: Column) -> Column:
    return (F.lit(HEADER) + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def valid_key(key: Column) -> Column:
    return F.octet_length(key) <= LONGEST
