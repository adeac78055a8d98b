"""Replay of a write journal: finished files, orphans, whether the last run ended."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import FINISHED, START, journal_line, parse_journal


def read(spark: SparkSession, path: str) -> DataFrame:
    """seq, value of a journal's lines. seq follows the order of writing: the time of the append, then the file, the
    part of the file and the line in it."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path)
    at = F.regexp_extract("_metadata.file_path", "append=([0-9]+)", 1).try_cast("long")
    seq = F.struct(F.coalesce(at, F.lit(0)).alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("line"))
    return rows.select(seq.alias("seq"), "value")


def append(lines: DataFrame, path: str) -> None:
    """Adds lines (typ, file, md5; in order of seq if there is one) as text, whole files at a time, in a folder named by the time."""
    rows = lines.orderBy("seq") if "seq" in lines.columns else lines
    rows = rows.select(journal_line(F.col("typ"), F.col("file"), F.col("md5")).alias("value"))
    rows.write.text(f"{path.rstrip('/')}/append={time.time_ns()}")


def entries(lines: DataFrame) -> DataFrame:
    """seq, typ, file, md5 of the lines (seq, value) that are whole; others are passed over."""
    return lines.select("seq", parse_journal(F.col("value")).alias("e")).where("e IS NOT NULL").select("seq", "e.*")


def finished(journal: DataFrame) -> DataFrame:
    """file, md5: of several entries for a file the first counts."""
    return journal.where(F.col("typ") == FINISHED).groupBy("file").agg(F.min_by("md5", "seq").alias("md5"))


def unmentioned(on_disk: DataFrame, journal: DataFrame) -> DataFrame:
    """Files on disk that no entry finished: left by a crash, to be deleted."""
    return on_disk.join(journal.where(F.col("typ") == FINISHED).select(F.col("file").alias("path")), "path", "left_anti")


def dirty(journal: DataFrame) -> bool:
    """Whether the last start or stop is a start: then nothing known is trusted."""
    last = journal.where(F.col("typ") != FINISHED).orderBy(F.desc("seq")).limit(1).collect()
    return bool(last) and last[0].typ == START


def counters(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Per kind and window of processing time: events, gained, and the rate by second."""
    rows = events.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("gained"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "events", "gained", (F.col("gained") / seconds).alias("rate"))


def running(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return events.withColumn("total", F.sum(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
