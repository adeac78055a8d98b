"""Content hashes and digests. SHA-2, MD5 and CRC-32 are built in; BLAKE2b and SHA-3 come in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the content hashes and their digest bytes.
HASHES = {"blake2b_160": 20, "blake2b_256": 32, "blake2b_384": 48, "blake2b_512": 64, "sha3_256": 32, "sha3_384": 48, "sha3_512": 64}
DEFAULT = "sha3_256"
#: Part sizes in MiB that a multipart upload may have used.
PART_SIZES = (5, 8, 16, 20)


def digest_function(name: str) -> Callable[[bytes], bytes]:
    if name.startswith("blake2b_"):
        size = HASHES[name]
        return lambda data: hashlib.blake2b(data, digest_size=size).digest()
    make = getattr(hashlib, name)
    return lambda data: make(data).digest()


def content_hash(data: Column, name: str = DEFAULT) -> Column:
    """sha256 stays in the JVM; the others are a vectorised function."""
    if name == "sha256":
        return F.unhex(F.sha2(data, 256))
    if name not in HASHES:
        raise ValueError(f"{name!r} is none of sha256, {', '.join(HASHES)}")
    one = digest_function(name)

    @F.pandas_udf("binary")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: None if b is None else one(bytes(b)))

    return run(data)


def crc_matches(data: Column, expected: Column) -> Column:
    return F.crc32(data).eqNullSafe(expected)


def etag(data: Column, part_bytes: int) -> Column:
    """The tag of an upload in parts of a size: MD5 of the parts' MD5s and their number."""
    count = F.greatest(F.ceil(F.octet_length(data) / part_bytes), F.lit(1)).cast("int")
    sums = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.md5(F.substring(data, i * part_bytes + 1, F.lit(part_bytes))))
    return F.concat(F.md5(F.unhex(F.array_join(sums, ""))), F.lit("-"), count.cast("string"))


def etag_matches(data: Column, tag: Column, part_sizes: tuple[int, ...] = PART_SIZES, unit: int = 1 << 20) -> Column:
    """Plain MD5, or parts of any of the sizes whose number of parts fits the length."""
    clean = F.lower(F.replace(tag, F.lit('"'), F.lit("")))
    parts = F.regexp_extract(clean, "-([0-9]+)$", 1).try_cast("long")
    fits = lambda size: F.floor(F.octet_length(data) / size).isin(parts - 1, parts)
    return F.when(parts.isNull(), F.md5(data) == clean).otherwise(sum((F.when(fits(p * unit), (etag(data, p * unit) == clean).cast("int")).otherwise(0) for p in part_sizes), F.lit(0)) > 0)
