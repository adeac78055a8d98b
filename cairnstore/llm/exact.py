"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own bytes say so (the last bits of a window of bytes spell PATTERN, between a least and a
most length; a byte that begins a character of several bytes fits both bits, so that scripts whose characters all begin
alike are cut like others). So equal passages give equal chunks wherever they stand, in any script. A chunk's identifier is
the head of its SHA-256; a text's recipe is its ordered list of identifiers, a few hundredths of its length, and only
recipes are shuffled. Identifiers of chunks in texts that would be called equal are verified by their bytes: those
texts are found by a sieve of bounded size (so texts are not moved to find them), their distinct chunks are moved once,
and any identifier that stands for two chunks is replaced by the chunk itself in the recipes it is in. A group of more
than a thousandth of all rows meets its rows by a broadcast of at most a thousand recipes.

Defined results: null texts are empty; empty texts are equal to each other; rows that repeat id and text make one
kept row, the others are dropped; null ids rank below all others; an empty table gives an empty result. Ids are of any
type that has an order. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, sieved, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least and most bytes of a chunk, and the last bits of the bytes before a cut: an odd byte, an even one, ...
LEAST, MOST, PATTERN = 256, 4096, "1001101001"
#: Bits of an identifier; equal ones are verified by their chunks' bytes.
BITS = 128
#: A group of more than one in so many rows is hot.
HOT = 1000


def boundary(pattern: str = PATTERN) -> str:
    """A regular expression for the place after such bytes, each byte a character of ISO 8859-1."""
    classes = ["[" + "".join(f"\\x{b:02x}" for b in range(bit, 0xC0, 2)) + "\\xc0-\\xff]" for bit in (0, 1)]
    return "(?<=" + "".join(classes[int(bit)] for bit in pattern) + ")"


def normalise(text: Column) -> Column:
    """Lower-cases A-Z only; pure ASCII takes the faster of two equal ways."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def chunks(text: Column, least: int = LEAST, most: int = MOST, pattern: str = PATTERN) -> Column:
    """Content-defined chunks of the UTF-8 bytes, each byte written as one character; their concatenation is the text."""
    held = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(held, F.lit(f"(?s).{{{least},{most}}}?{boundary(pattern)}|.{{1,{most}}}"), F.lit(0))


def identifier(chunk: Column, bits: int = BITS) -> Column:
    """The first bits of the SHA-256; very few of them force collisions, for tests."""
    digest = F.sha2(chunk.cast("binary"), 256)
    return F.unhex(F.substring(digest, 1, bits // 4))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    source = docs.select(F.col(id_col).alias("doc_id"), normalise(F.col(text_col)).alias("norm"))
    recipes = materialise(
        source.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: identifier(c, bits)).alias("recipe")),
        "recipes",
    )
    shared = materialise(_shared(recipes), "shared-recipes")
    twins = recipes.join(small(shared, cells=F.size("recipe") + 2), "recipe", "left_semi").select(F.xxhash64("doc_id").alias("key")).distinct()
    pieces = (
        sieved(source, F.xxhash64("doc_id"), materialise(twins, "twins"), "twin")
        .where("twin")
        .select(F.explode(chunks(F.col("norm"))).alias("chunk"))
        .select(identifier(F.col("chunk"), bits).alias("id"), "chunk")
        .distinct()
    )
    clash = materialise(pieces.groupBy("id").count().where("count > 1").select("id"), "clashes")
    if clash.limit(1).count():
        recipes = materialise(_resolved(source, recipes, clash, bits), "recipes")
        shared = materialise(_shared(recipes), "shared-recipes")
    counted = recipes.groupBy("recipe", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    many = F.col("n") > recipes.count() // hot
    few = materialise(shared.where(many).select("recipe", F.col("keep").alias("hot_keep"), F.col("n").alias("hot_n")), "hot-recipes")
    counted = counted.join(small(few, cells=F.size("recipe") + 2), "recipe", "left")
    away = F.array(F.concat(F.encode(F.lit("!"), "UTF-8"), F.unhex(F.md5(F.concat_ws(" ", F.col("text_sha256"), F.xxhash64("doc_id").cast("string"))))))
    counted = counted.withColumn("recipe", F.when(F.col("hot_n").isNull(), F.col("recipe")).otherwise(away))  # spread, equal to none
    joined = counted.join(shared.where(~many), "recipe", "left").withColumn("n", F.coalesce("hot_n", "n"))
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).when(F.col("hot_n").isNull(), F.col("keep")).otherwise(F.col("hot_keep")).alias("keep_id"),
        F.coalesce("n", "copies").cast("long").alias("group_size"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def _shared(recipes: DataFrame) -> DataFrame:
    return recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")


def _resolved(source: DataFrame, recipes: DataFrame, clash: DataFrame, bits: int) -> DataFrame:
    """Recipes with each clashing identifier replaced by its chunk: of all texts that have one."""
    hit = recipes.select("doc_id", F.explode("recipe").alias("id")).join(clash, "id", "left_semi").select("doc_id").distinct()
    hit = materialise(hit.withColumnRenamed("doc_id", "hit_id"), "clash-texts")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id"))
    whole = source.join(hit, same, "left_semi")
    plain = whole.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), lambda c: F.concat(F.encode(F.lit("="), "UTF-8"), F.encode(c, "ISO-8859-1"))).alias("recipe"))
    rest = recipes.join(hit, same, "left_anti")
    return rest.unionByName(plain)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
