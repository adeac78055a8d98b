"""A corpus pipeline of five operators: each stage works on all rows that the one before kept.

toxicity: documents predicted toxic go. exact_dedup: of equal texts one row stays. near_dedup: one document of each
class stays. decontaminate: documents that leak a benchmark item go. mix: documents that the mix takes, with the
words it takes of each.

A row's key is its id with the hash of its text, so rows that share an id (or have none) are judged one by one: a
stage joins its operator's keys of rows to drop. Rows that agree in id and text agree in every decision; the two
stages of deduplication leave one of them. Keys that are many are joined behind a sieve of bounded size, so that
only texts which may be meant are shuffled, not all.

Defined results: null texts count as empty, and of all empty texts one row stays; null ids, labels and sources are values
like others; texts of any length are read whole; an empty table gives an empty result, an empty benchmark or no labels
drop nothing; columns beside those of documents are kept as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnstore.llm.common import BROADCAST_ROWS, materialise, sieved
from cairnstore.llm.decontaminate import leaks
from cairnstore.llm.exact import exact_groups
from cairnstore.llm.mixing import mix
from cairnstore.llm.neardup import LAST, near_rows
from cairnstore.llm.toxicity import scored_rows


def _rid(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (a row's key: its id and the hash of its text) and text."""
    return docs.select(F.struct(docs["doc_id"].alias("d"), _rid(docs).alias("rid")).alias("doc_id"), docs["text"].alias("text"))


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the rows of materialised keys (d, rid)."""
    same = lambda docs, keys: docs.join(keys, docs["doc_id"].eqNullSafe(keys["d"]) & (_rid(docs) == keys["rid"]), how)
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return same(docs, F.broadcast(keys))
    name = f"sieve-{uuid.uuid4().hex}"
    marked = sieved(docs, F.xxhash64(docs["doc_id"].cast("string"), _rid(docs)), keys.select(F.xxhash64(F.col("d").cast("string"), "rid").alias("key")), name)
    some = same(marked.where(marked[name]).drop(name), keys)
    return some if how == "left_semi" else marked.where(~marked[name]).drop(name).unionByName(some)


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    return _joined(docs, materialise(keys.distinct(), "gone"), "left_anti")


def _once(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs with one row of each key of keys (d, rid), those of rows that agree in id and text."""
    keys = materialise(keys, "repeated")
    if not keys.limit(1).count():
        return docs
    several, rid = _joined(docs, keys, "left_semi"), f"rid-{uuid.uuid4().hex}"
    one = several.withColumn(rid, _rid(several)).dropDuplicates(["doc_id", rid]).drop(rid)
    return _joined(docs, keys, "left_anti").unionByName(one)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = scored_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("predicted = 1").select(F.col("doc_id").alias("d"), "rid"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = materialise(exact_groups(_keyed(docs)), "groups")
    if not groups.where("kept = false").limit(1).count():
        return docs
    same = groups.select("doc_id.d", "doc_id.rid", "kept").groupBy("d", "rid").agg(F.max(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n"))
    same = materialise(same, "keys")
    return _once(_without(docs, same.where("kept = 0").select("d", "rid")), same.where("kept = 1 AND n > 1").select("d", "rid"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = near_rows(docs).withColumn("kept", F.expr("d = class_d AND rid = class_rid"))
    same = materialise(rows.groupBy(F.expr(f"nullif(d, {LAST})").alias("d"), "rid", "kept").agg(F.count(F.lit(1)).alias("n")), "near-keys")
    return _once(_without(docs, same.where("NOT kept").select("d", "rid")), same.where("kept AND n > 1").select("d", "rid"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = leaks(_keyed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.select("doc_id.d", "doc_id.rid"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs).where("taken > 0")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near),
    ("decontaminate", drop_leaks),
    ("mix", mixed),
]

#: Nearest examples, sampled bands and seeds have no SQL; tests/llm/test_pipeline.py checks every stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
