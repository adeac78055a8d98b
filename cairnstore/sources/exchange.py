"""Export and import of repository tables as compressed JSON lines; damaged lines are set apart, not lost."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_json(df: DataFrame, path: str) -> None:
    """Binary columns become base64, as JSON has it."""
    df.write.mode("errorifexists").option("compression", "gzip").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows, and lines that don't fit the schema."""
    shape = T.StructType([*spark.createDataFrame([], schema).schema, T.StructField("_bad", T.StringType())])
    read = F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(read.alias("r"), F.col("value").alias("line"))
    return rows.where("r._bad IS NULL").select("r.*").drop("_bad"), rows.where("r._bad IS NOT NULL").select("line")


def write_repeat_script(path: str, repository: str, folder: str) -> bool:
    """A shell line that runs this backup again, if there is no such file yet."""
    if os.path.exists(path):
        return False
    import shlex

    with open(path, "w") as f:
        f.write(f"#!/bin/sh\nexec python -m cairnstore.cli backup {shlex.quote(repository)} {shlex.quote(folder)}\n")
    os.chmod(path, 0o755)
    return True
