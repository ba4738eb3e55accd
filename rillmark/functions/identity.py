"""User keys, sample buckets and weights."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BUCKETS = 10_000


def key_of(user_id: str | None, anonymous_id: str | None) -> int:
    """64-bit key of the identity, as XXH3 (signed); the signed-in id wins, and the two kinds never share a key by prefix."""
    from xxhash import xxh3_64_intdigest

    key = xxh3_64_intdigest(b"u" + user_id.encode() if user_id else b"a" + (anonymous_id or "").encode())
    return key - (1 << 64) if key >> 63 else key


def key_bytes(key: Column) -> Column:
    """The key as eight bytes, the highest first: what partitions a topic by user."""
    return F.unhex(F.lpad(F.hex(key), 16, "0"))


def bucket(key: Column) -> Column:
    """``key`` modulo 10,000, the key read as unsigned (2**64 leaves 1616)."""
    return F.pmod(F.pmod(key, F.lit(BUCKETS)) + F.when(key < 0, F.lit(1616)).otherwise(F.lit(0)), F.lit(BUCKETS)).cast("int")


def bucket_of(key: int) -> int:
    return (key % (1 << 64)) % BUCKETS


def threshold_of(rate: float) -> int:
    return round(rate * BUCKETS)


def valid_rate(rate: float) -> bool:
    """In (0, 1], in steps of one bucket."""
    return 0 < rate <= 1 and abs(rate * BUCKETS - round(rate * BUCKETS)) < 1e-9 and round(rate * BUCKETS) >= 1


def weight(threshold: Column) -> Column:
    """Horvitz-Thompson weight of an event kept at ``threshold``."""
    return F.lit(float(BUCKETS)) / threshold
