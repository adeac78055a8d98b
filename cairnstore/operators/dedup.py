"""Chunk identity: one stored chunk per content hash, recipes of files, reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(blocks: DataFrame, digest: Column | None = None) -> DataFrame:
    return blocks.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256) if digest is None else digest).withColumn("length", F.octet_length("content").cast("long"))


def first_seen(blocks: DataFrame, order: list[str]) -> DataFrame:
    """One row per hash: first (the least order struct), length, uses. Combined before the shuffle, so a chunk that
    all files have costs one row per task."""
    return blocks.groupBy("hash").agg(F.min(F.struct(*order)).alias("first"), F.min("length").alias("length"), F.count(F.lit(1)).alias("uses"))


def new_chunks(blocks: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Chunks that the store hasn't, each once."""
    return first_seen(blocks, order).join(known.select("hash"), "hash", "left_anti")


def chunk_status(blocks: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """found (stored before), assigned (seen earlier in this batch) or new, for every block."""
    first = first_seen(blocks, order).select("hash", "first")
    rows = blocks.join(first, "hash").join(known.select("hash", F.lit(True).alias("stored")), "hash", "left")
    tag = F.when(F.col("stored"), "found").when(F.col("first") == F.struct(*order), "new").otherwise("assigned")
    return rows.withColumn("status", tag).drop("first", "stored")


def recipes(blocks: DataFrame) -> DataFrame:
    """path, size and the hashes of its blocks in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block_nr", "hash"))), lambda x: x["hash"])
    return blocks.groupBy("path").agg(ordered.alias("hashes"), F.sum("length").alias("size"))


def resolve(recipe: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, block_nr, hash and the chunk's columns; nulls where the store lacks it."""
    return recipe.select("path", F.posexplode("hashes").alias("block_nr", "hash")).join(chunks, "hash", "left")


def reassemble(blocks: DataFrame) -> DataFrame:
    """path, content: blocks joined in order, null if one is lost. A file is one row; larger ones are restored by
    block. Written as hexadecimal digits once, so that work grows with the file, not with its square."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block_nr", "content"))), lambda x: x["content"])
    rows = blocks.groupBy("path").agg(F.count(F.lit(1)).alias("all"), F.count("content").alias("there"), parts.alias("parts"))
    return rows.select("path", F.when(F.col("all") == F.col("there"), F.unhex(F.array_join(F.transform("parts", F.hex), ""))).alias("content"))


def statistics(blocks: DataFrame) -> DataFrame:
    """Logical and stored bytes and chunks, and their ratio."""
    per_hash = blocks.groupBy("hash").agg(F.count(F.lit(1)).alias("uses"), F.min("length").alias("length"))
    out = per_hash.agg(
        F.sum("uses").cast("long").alias("logical_chunks"),
        F.count(F.lit(1)).alias("stored_chunks"),
        F.sum(F.col("uses") * F.col("length")).cast("long").alias("logical_bytes"),
        F.sum("length").cast("long").alias("stored_bytes"),
    )
    return out.withColumn("ratio", F.round(F.col("stored_bytes") / F.col("logical_bytes"), 6))
