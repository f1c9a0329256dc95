"""Hash splits and seeds: a native profile on the JVM and a conformance profile with BLAKE2b."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

MODULUS = 1_000_000


def threshold(fraction: float) -> int:
    """Buckets below this number are validation; the product is cut, not rounded."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be within 0 and 1")
    return int(fraction * MODULUS)


def address_key(seed: int | None, *parts: Column) -> Column:
    """The text that is hashed: the seed, if any, and parts of the document address, joined by a bar."""
    return F.concat_ws("|", *([] if seed is None else [F.lit(str(seed))]), *(p.cast("string") for p in parts))


def md5_bucket(key: Column) -> Column:
    """Native profile: the first 15 hexadecimal digits of the MD5, modulo MODULUS."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % MODULUS


def blake2b_bucket(key: Column) -> Column:
    """Conformance profile: the 64-bit BLAKE2b digest as a big-endian number, modulo MODULUS."""

    @F.pandas_udf(LongType())
    def bucket(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: int.from_bytes(hashlib.blake2b(k.encode("utf-8", "replace"), digest_size=8).digest(), "big") % MODULUS)

    return bucket(key)


def shuffle_seed(seed: int, name: str) -> int:
    """Seed of the shard order: may exceed 64 bits, so it stays on the driver."""
    return seed + int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")


def sample_seed(seed: int, name: str) -> int:
    """Seed of the shard sample: the first four bytes of the SHA-1."""
    return seed + int.from_bytes(hashlib.sha1(name.encode()).digest()[:4], "big")


def sample_seed_column(seed: int, name: Column) -> Column:
    return F.lit(seed) + F.conv(F.substring(F.sha1(name), 1, 8), 16, 10).cast("long")
