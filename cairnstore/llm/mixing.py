"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash. A source's budget is a number of whole passes over it and a rest; the rest
is the documents whose hash lies below a threshold. The threshold is found by histograms of words by source and
hash bucket: 4096 buckets, then only the boundary bucket in 4096 finer ones, and so on, so nothing is sorted.
Thresholds of a smaller budget lie below those of a larger one: mixes are nested.

Defined results: a null text has size 0; null sources are one source, last in order; equal hashes (repeated rows)
form a tie that shares what is left in proportion, rounded down; an empty table gives an empty result; sources
without any word get target 0 and are taken 0 words. Columns beside id, text and source are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, small

#: Bits of the hash that each round of histograms resolves, and rounds.
BITS, ROUNDS = 12, 4


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, size in words and the hash; the hash depends on the id alone."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, BITS * ROUNDS // 4), 16, 10).cast("long").alias("h"),
    )


def targets(per_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """Adds target to (source, source_size): weighted shares of all sizes, none above `most` times its source.

    Sources with a share above their limit get the limit; the excess goes to the others by weight, until none is
    above. What is passed on is two sums a round, so any number of sources will do. Ranks come from a count of
    smaller sources in range partitions, not from one task.
    """
    spark = per_source.sparkSession
    ranked = materialise(_ranked(per_source), "ranked").withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    limit = F.col("source_size") * float(most)
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else limit < F.col("w") * level
        n, kept, weight = ranked.agg(F.count(F.when(over, 1)), F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if n == full or not weight:
            break
        full, level = n, (total - kept) / weight
    target = limit if level is None else F.least(limit, F.col("w") * F.lit(float(level)))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def _ranked(per_source: DataFrame) -> DataFrame:
    """Adds rank from 0 in code point order, nulls last: a count in each range plus what earlier ranges hold."""
    ranged = materialise(per_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("within", within).join(F.broadcast(before.select("part", "before")), "part").select("source", "source_size", (F.col("before") + F.col("within")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, share: float = 1.0) -> DataFrame:
    """doc_id, size, source_size, target, taken and source: words that the mix takes of each document.

    A document is taken for as many whole passes as its source's target holds, once more if its hash lies below
    the source's threshold. The tie at the threshold takes the remaining words, a part of them if need be: the
    first so many words of that document.
    """
    sized = materialise(sizes(docs, id_col, text_col, source_col), "sized")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = materialise(targets(per_source, weights, most, share), "targets")
    whole = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("rest", whole - F.col("passes") * F.col("source_size")).withColumn("low", F.lit(0).cast("long")).withColumn("tie", F.lit(0).cast("long"))
    for k in range(1, ROUNDS + 1):
        goal = materialise(_refine(sized, goal, BITS * (ROUNDS - k), k == 1), f"thresholds-{k}")
    near = F.when(F.col("h") < F.col("low"), F.col("size")).when((F.col("h") == F.col("low")) & (F.col("tie") > 0), F.floor(F.col("size") * F.col("rest") / F.col("tie"))).otherwise(0)
    joined = sized.alias("d").join(small(goal, cells=_width()).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes") + near).cast("long").alias("taken"), F.col("d.source").alias("source"))


def _width() -> Column:
    """Values of 8 bytes that a source's row holds."""
    return F.coalesce(F.octet_length("source"), F.lit(0)) / 8 + 6


def _refine(sized: DataFrame, goal: DataFrame, shift: int, first: bool) -> DataFrame:
    """One round: the bucket of width 2^shift in which each source's rest runs out.

    low is the smallest hash not taken so far, rest the words still to take from the boundary bucket on, tie the
    words in that bucket.
    """
    joined = sized.alias("d").join(small(goal, cells=_width()).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("rest") > 0))
    if not first:
        joined = joined.where((F.shiftright("h", shift + BITS) == F.shiftright("low", shift + BITS)))
    hist = joined.groupBy(F.col("t.source").alias("source"), F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    edge = hist.withColumn("run", run).where(F.col("run") > F.col("rest"))
    edge = edge.groupBy("source").agg(F.min(F.struct("bucket", "words", "run")).alias("e"))
    found = goal.alias("g").join(edge.alias("x"), F.col("g.source").eqNullSafe(F.col("x.source")), "left")
    e = F.col("x.e")
    return found.select(
        F.col("g.source").alias("source"), "source_size", "target", "passes",
        F.when(e.isNull(), F.col("rest")).otherwise(F.col("rest") - (e["run"] - e["words"])).cast("long").alias("rest"),
        F.when(e.isNull(), F.col("low")).otherwise(F.shiftleft(e["bucket"], shift)).cast("long").alias("low"),
        F.when(e.isNull(), F.col("tie")).otherwise(e["words"]).cast("long").alias("tie"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0 AS w FROM d GROUP BY source),
r AS (SELECT *, CAST(3 * source_size AS DOUBLE) AS cap, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS kept,
  CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rest_w, (SELECT CAST(sum(size) AS DOUBLE) FROM d) AS total FROM r),
l AS (SELECT (total - kept) / rest_w AS level FROM c WHERE (total - kept) / rest_w * w <= cap ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, CAST(least(cap, w * level) AS DOUBLE) AS target FROM c, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(round(target) / source_size) AS BIGINT) ELSE 0 END AS passes FROM t),
q AS (SELECT *, CAST(round(target) AS BIGINT) - passes * source_size AS rest FROM p),
x AS (SELECT d.*, q.source_size, q.target, q.passes, q.rest, CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS tie,
  CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(passes * size + CASE WHEN upto <= rest THEN size WHEN upto - tie < rest THEN floor(CAST(size * (rest - (upto - tie)) AS DOUBLE) / tie) ELSE 0 END AS BIGINT) AS taken
FROM x
"""
