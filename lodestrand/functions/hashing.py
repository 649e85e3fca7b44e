"""Column functions that make identifiers and folds from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_hash(*cols: Column | str, length: int = 64) -> Column:
    """The first digits of the SHA-256 of the values joined by a zero character."""
    return F.substring(F.sha2(F.concat_ws("\u0000", *cols), 256), 1, length)


def hash_fold(digest: Column, folds: int = 5) -> Column:
    """A hexadecimal number modulo 3, 5 or 15: as 16 leaves 1, the digits add up."""
    if folds not in (3, 5, 15):
        raise ValueError("the digit sum gives the remainder by 3, 5 and 15 only")
    total = F.aggregate(F.split(digest, ""), F.lit(0), lambda s, d: s + F.coalesce(F.conv(d, 16, 10).cast("int"), F.lit(0)))
    return (total % folds).cast("int")
