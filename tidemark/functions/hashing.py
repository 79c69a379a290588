"""Hashes of a key's text as columns, each in [0, 1) or an integer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The golden ratio's fraction, the customary factor of multiplicative hashing.
GOLDEN = 0.6180339887498949
TWO_32 = 4294967296.0


def md5_bits(key: Column, part: int = 0) -> Column:
    """32 bits of the MD5: part 0 is bytes 0 to 3, part 1 bytes 4 to 7."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1 + 8 * part, 8), 16, 10).cast("long")


def md5_unit(key: Column, part: int = 0) -> Column:
    return md5_bits(key, part).cast("double") / F.lit(TWO_32)


def crc32_unit(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")).cast("double") / F.lit(TWO_32)


def java_hash(key: Column) -> Column:
    """The 32-bit polynomial hash of a text with base 31, signed; characters beyond U+FFFF count as one unit."""
    chars = F.split(key.cast("string"), "")
    codes = F.aggregate(chars, F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise(F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32))))
    return F.when(codes >= 1 << 31, codes - (1 << 32)).otherwise(codes)


def mult_unit(key: Column, factor: float = GOLDEN) -> Column:
    """The fraction of the masked text hash times ``factor``."""
    return F.pmod(java_hash(key).bitwiseAND(F.lit(0x0FFFFFFF).cast("long")).cast("double") * F.lit(factor), F.lit(1.0))


def bucket(unit: Column, n: int = 100) -> Column:
    """Equal ranges 0 to n - 1; values outside [0, 1) fall in 0."""
    return F.when((unit >= 0) & (unit < 1), F.floor(unit * n)).otherwise(0).cast("int")
