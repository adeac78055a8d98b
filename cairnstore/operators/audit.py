"""Integrity: which chunks, files, folders and snapshots have a problem. Every check returns kind, subject, detail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

PROBLEM = ("kind", "subject", "detail")


def _problem(kind: str, subject, detail):
    return F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")


def _named(rows: DataFrame):
    """A hash as a subject: binary ones by their hexadecimal digits."""
    return F.lower(F.hex("hash")) if dict(rows.dtypes)["hash"] == "binary" else F.col("hash")


def chunk_status(needed: DataFrame, chunks: DataFrame, volumes: DataFrame) -> DataFrame:
    """hash, status for each distinct needed hash: ok, missing, or out of bounds of its volume.

    chunks: hash, volume, start, length; volumes: volume, volume_length."""
    rows = needed.select("hash").distinct().join(chunks.select("hash", "volume", "start", "length"), "hash", "left").join(volumes, "volume", "left")
    fits = F.col("volume_length") >= F.col("start") + F.col("length")
    return rows.select("hash", F.when(F.col("start").isNull(), "missing").when(~F.coalesce(fits, F.lit(False)), "out of bounds").otherwise("ok").alias("status"))


def chunk_problems(needed: DataFrame, chunks: DataFrame, volumes: DataFrame) -> DataFrame:
    rows = chunk_status(needed, chunks, volumes).where("status <> 'ok'")
    return rows.select(*_problem("chunk", _named(rows), F.col("status")))


def content_problems(payload: DataFrame, digest) -> DataFrame:
    """payload: hash, content; digest(column): content whose hash differs, or that can't be read."""
    return payload.where(F.col("content").isNull() | (digest(F.col("content")) != F.col("hash"))).select(
        *_problem("content", _named(payload), F.when(F.col("content").isNull(), "lost or unreadable").otherwise("hash differs"))
    )


def complete(recipes: DataFrame, chunks: DataFrame, key: str = "path") -> DataFrame:
    """key, complete: whether all its chunks are stored; a file without chunks is."""
    rows = recipes.select(key, F.explode_outer("hashes").alias("hash")).join(chunks.select("hash", F.lit(True).alias("stored")).distinct(), "hash", "left")
    return rows.groupBy(key).agg(F.bool_and(F.col("hash").isNull() | F.coalesce("stored", F.lit(False))).alias("complete"))


def orphans(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files whose parent folder isn't there."""
    rows = files.select("path", paths.parent(F.col("path")).alias("parent"))
    return rows.join(folders.select(F.col("path").alias("parent")).distinct(), "parent", "left_anti").select(*_problem("folder", F.col("path"), F.col("parent")))


def snapshot_orphans(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files (snapshot_ts, path) whose parent isn't among the folders (snapshot_ts, path) of their snapshot, where that
    has folders at all."""
    rows = files.join(folders.select("snapshot_ts").distinct(), "snapshot_ts", "left_semi").withColumn("parent", paths.parent(F.col("path")))
    lost = rows.join(folders.select("snapshot_ts", F.col("path").alias("parent")), ["snapshot_ts", "parent"], "left_anti")
    return lost.select(*_problem("folder", F.col("path"), F.col("parent"))).distinct()


def snapshot_problems(members: DataFrame, versions: DataFrame) -> DataFrame:
    """members: snapshot_ts, id. One problem for each snapshot with an id that has no version."""
    lost = members.join(versions.select("id"), "id", "left_anti").groupBy("snapshot_ts").agg(F.count(F.lit(1)).alias("n"))
    return lost.select(*_problem("snapshot", F.col("snapshot_ts"), F.concat(F.col("n").cast("string"), F.lit(" ids without a version"))))


def aligned(contents: DataFrame, saved: DataFrame, digest) -> DataFrame:
    """(file_id, pos, content) against (file_id, pos, hash): positions that disagree or lack a partner."""
    both = contents.withColumn("now", digest(F.col("content"))).join(saved, ["file_id", "pos"], "full_outer")
    return both.where(~F.col("now").eqNullSafe(F.col("hash"))).select("file_id", "pos")


def sampled(files: DataFrame, percent: float, key: str = "path") -> DataFrame:
    """A share of the files, the same ones each time: those whose hash lies below it."""
    if not 0 < percent <= 100:
        raise ValueError("percent is over 0 and at most 100")
    return files if percent == 100 else files.where(F.pmod(F.xxhash64(key), F.lit(10_000)) < int(percent * 100))


def orphan_chunks(chunks: DataFrame, recipes: DataFrame) -> DataFrame:
    """Chunks that no recipe names: what a clean-up could drop."""
    return chunks.join(recipes.select(F.explode("hashes").alias("hash")).distinct(), "hash", "left_anti")


def count(problems: DataFrame) -> int:
    """The exit code of a verification."""
    return problems.count()
