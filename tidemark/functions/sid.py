"""Subsample ids: 1 to b for rows that are in a subsample, 0 for the others."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.hashing import md5_unit


def assign_sid(key: Column, b: int = 100, share: float = 0.1, salt: str = "sid") -> Column:
    """A deterministic draw: a ``share`` of keys is dealt evenly to ``b`` subsamples."""
    u, v = md5_unit(key), md5_unit(F.concat(key.cast("string"), F.lit("|" + salt)))
    return F.when(u < share, F.floor(v * b) + 1).otherwise(0).cast("int")


def combine_sid(sids: Sequence[Column], b: int = 100, mode: str = "corrected") -> Column:
    """The id of a joined row from those of its parts; 0 if one part is in no subsample.

    Each id is a digit of base sqrt(b) after division by sqrt(b); the digits' number is scaled back to 1 to b.
    ``reference`` adds 1 before scaling, which for three parts and more also yields 0 and b + 1 values.
    """
    s, k = isqrt(b), len(sids)
    if s * s != b:
        raise ValueError("b must be a square")
    if k == 1:
        return sids[0].cast("int")
    digits = F.lit(0).cast("long")
    for i, sid in enumerate(sids):
        digits = digits + F.floor((sid - 1) / s) * (s ** (k - 1 - i))
    scale = s ** (k - 2)
    value = F.floor(digits / scale) + 1 if mode == "corrected" else F.floor((digits + 1) / scale)
    zero = F.lit(False)
    for sid in sids:
        zero = zero | (F.coalesce(sid, F.lit(0)) == 0)
    return F.when(zero, 0).otherwise(value).cast("int")
