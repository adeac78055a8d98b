"""A second copy elsewhere: what is missing, wrong or temporary there, and the order of uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETRIES = 10


def reconcile(local: DataFrame, remote: DataFrame) -> DataFrame:
    """path, status: upload (missing there), replace (other size), temporary, extra (only there) or same."""
    both = local.select("path", F.col("size").alias("l")).join(remote.select("path", F.col("size").alias("r")), "path", "full_outer")
    status = (
        F.when(F.col("path").endswith(".tmp"), "temporary")
        .when(F.col("r").isNull(), "upload")
        .when(F.col("l").isNull(), "extra")
        .when(F.col("l") != F.col("r"), "replace")
        .otherwise("same")
    )
    return both.select("path", status.alias("status"))


def next_uploads(queue: DataFrame, slots: int, retries: int = RETRIES) -> DataFrame:
    """The next `slots` of the queue by failures and size, with their place; hopeless ones left out.

    The top rows of each of 64 hash groups are taken first, so that no task orders the whole queue."""
    rows = queue.where(F.col("failures") < retries)
    order = ["failures", "size", "path"]
    top = rows.withColumn("lane", F.pmod(F.xxhash64("path"), F.lit(64)))
    top = top.withColumn("place", F.row_number().over(Window.partitionBy("lane").orderBy(*order))).where(F.col("place") <= slots).drop("lane", "place")
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).where(F.col("place") <= slots)


def remaining(queue: DataFrame, retries: int = RETRIES) -> DataFrame:
    return queue.where(F.col("failures") < retries).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))
