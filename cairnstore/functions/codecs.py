"""Compression with a tag byte in front, in Arrow batches; the codec may differ by row."""

from __future__ import annotations

import gzip
import lzma
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import Codec, codec_by_tag

#: Smallest and usual dictionary of an xz block.
DICTIONARY = (4096, 1 << 20)


def dictionary_size(content: int) -> int:
    """A power of two that holds the content, within the bounds."""
    size = DICTIONARY[0]
    while size < content and size < DICTIONARY[1]:
        size *= 2
    return size


def pack(data: bytes, codec: str) -> bytes:
    tag = bytes([Codec[codec].tag])
    if codec == "gzip":
        return tag + gzip.compress(data, mtime=0)
    if codec == "deflate":
        return tag + zlib.compress(data)
    if codec == "lzma":
        return tag + lzma.compress(data, filters=[{"id": lzma.FILTER_LZMA2, "preset": 6, "dict_size": dictionary_size(len(data))}])
    if codec in ("snappy", "lz4", "lz4hc"):  # these need the plain length to be read
        name, level = {"snappy": ("snappy", None), "lz4": ("lz4_raw", None), "lz4hc": ("lz4", 9)}[codec]
        body = pa.Codec(name, level).compress(data, asbytes=True) if level else pa.Codec(name).compress(data, asbytes=True)
        return tag + len(data).to_bytes(8, "big") + body
    return tag + data


def unpack(data: bytes) -> bytes:
    codec, body = codec_by_tag(data[0]).name, data[1:]
    if codec == "gzip":
        return gzip.decompress(body)
    if codec == "deflate":
        return zlib.decompress(body)
    if codec == "lzma":
        return lzma.decompress(body)
    if codec in ("snappy", "lz4", "lz4hc"):
        size = int.from_bytes(body[:8], "big")
        return pa.Codec({"snappy": "snappy", "lz4": "lz4_raw", "lz4hc": "lz4"}[codec]).decompress(body[8:], size, asbytes=True) if size else b""
    return body


def compress(data: Column, codec: Column) -> Column:
    @F.pandas_udf("binary")
    def run(blocks: pd.Series, codecs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else pack(bytes(b), c) for b, c in zip(blocks, codecs, strict=True)], dtype=object)

    return run(data, codec)


def decompress(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda b: None if b is None else unpack(bytes(b)))

    return run(data)


def policy(size: Column, chosen: Column) -> Column:
    """Tiny blocks stay as they are, small ones are deflated, others get what was chosen for their kind."""
    return F.when(size < 256, "none").when(size < 2048, "deflate").otherwise(F.coalesce(chosen, F.lit("deflate")))
