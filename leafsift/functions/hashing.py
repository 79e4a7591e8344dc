"""MD5 buckets for feature hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(digest: Column, buckets: int) -> Column:
    """A 32-digit hex number modulo ``buckets``.

    It does not fit a BIGINT, so it is folded in chunks of 60, 60 and 8 bits; ``buckets``
    below 2**31 keeps every sum inside 63 bits.
    """
    folded = F.lit(0).cast("bigint")
    for start, digits in ((1, 15), (16, 15), (31, 2)):
        step = F.lit((1 << 4 * digits) % buckets).cast("bigint")
        chunk = F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
        folded = (folded * step + chunk) % F.lit(buckets).cast("bigint")
    return folded.cast("int")


def md5_bucket(text: Column, buckets: int) -> Column:
    """The 128-bit MD5 of ``text`` modulo ``buckets``."""
    return F.element_at(md5_buckets(F.array(text), buckets), 1)


def md5_buckets(texts: Column, buckets: int) -> Column:
    """``md5_bucket`` of every text of an array; each digest is taken once."""
    digests = F.transform(texts, lambda t: F.md5(t.cast("binary")))
    return F.transform(digests, lambda d: _fold(d, buckets))


def trace_id(at: Column) -> Column:
    """Ten hex digits of the time's MD5 followed by the epoch second."""
    seconds = F.unix_timestamp(at).cast("string")
    return F.concat(F.substring(F.md5(seconds.cast("binary")), 1, 10), seconds)
