"""Portable 60-bit hashes: any SQL engine with ``md5`` gets the same numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def _hex_to_long(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, HASH_BITS // 4), 16, 10).cast("bigint")


def hash60(*parts: Column) -> Column:
    """Hash of the ``|``-joined parts as a non-negative BIGINT below 2^60."""
    return _hex_to_long(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1)


def hash120(*parts: Column) -> tuple[Column, Column]:
    """Two independent 60-bit hashes from one digest."""
    return digest_halves(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])))


def digest_halves(digest: Column) -> tuple[Column, Column]:
    """Two 60-bit numbers of an md5 digest in hexadecimal."""
    return _hex_to_long(digest, 1), _hex_to_long(digest, 1 + HASH_BITS // 4)
