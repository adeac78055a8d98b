"""Choice of codecs: sampled sizes by extension, static costs instead of wall-clock times, so reruns agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.names import Codec

#: First round, bytes of each kind that are sampled, and the ratios between which a slow codec is tried as well.
FIRST, SAMPLE, LOW, HIGH = ("none", "snappy", "lz4", "lz4hc", "gzip"), 4 << 20, 0.03, 0.9
#: What a slower codec has to gain; fast ones need any gain.
GAIN, FAST = 0.03, ("none", "snappy", "lz4")


def samples(blocks: DataFrame, budget: int = SAMPLE) -> DataFrame:
    """Of each extension about a budget of bytes, the blocks whose hash lies below a share, or all if they are fewer;
    blocks under 2 KB have a fixed codec. Totals are combined before the shuffle, and no extension is sorted."""
    rows = blocks.where("length >= 2048")
    share = rows.groupBy("ext").agg((F.lit(float(budget)) / F.sum("length")).alias("share"))
    unit = F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) / (1 << 20)
    return rows.join(share, "ext").where(unit < F.col("share")).drop("share")


def tried(sample: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """ext, hash, codec, length, packed: every block with every codec."""
    rows = sample.select("ext", "hash", "length", "content", F.explode(F.array(*map(F.lit, names))).alias("codec"))
    return rows.select("ext", "hash", "codec", "length", F.octet_length(codecs.compress(F.col("content"), F.col("codec"))).cast("long").alias("packed"))


def ratios(tries: DataFrame) -> DataFrame:
    """ext, codec, received, compressed, ratio (1 where nothing came)."""
    rows = tries.groupBy("ext", "codec").agg(F.sum("length").cast("long").alias("received"), F.sum("packed").cast("long").alias("compressed"))
    return rows.withColumn("ratio", F.when(F.col("received") > 0, F.col("compressed") / F.col("received")).otherwise(1.0))


def winners(rated: DataFrame) -> DataFrame:
    """ext, codec, ratio: candidates by rising cost; a later one wins only by enough gain. Not associative, so an
    ordered fold over each extension's few candidates."""
    cost = F.create_map(*(x for c in Codec for x in (F.lit(c.name), F.lit(c.cost))))
    each = rated.groupBy("ext").agg(F.sort_array(F.collect_list(F.struct(cost[F.col("codec")].alias("cost"), "codec", "ratio"))).alias("c"))
    start = F.struct(F.lit(None).cast("string").alias("codec"), F.lit(2.0).alias("ratio"))

    def better(a, x):
        need = F.when(x["codec"].isin(*FAST), 0.0).otherwise(GAIN)
        win = a["codec"].isNull() | (a["ratio"] - x["ratio"] > need)
        return F.struct(F.when(win, x["codec"]).otherwise(a["codec"]).alias("codec"), F.when(win, x["ratio"]).otherwise(a["ratio"]).alias("ratio"))

    return each.select("ext", F.aggregate("c", start, better).alias("w")).select("ext", "w.codec", "w.ratio")


def choose(blocks: DataFrame, budget: int = SAMPLE) -> DataFrame:
    """ext, codec, ratio: a first round over all kinds, a second with lzma where the first helped but not much."""
    sample = samples(blocks, budget)
    first = ratios(tried(sample, FIRST))
    won = winners(first)
    again = sample.join(won.where((F.col("ratio") > LOW) & (F.col("ratio") < HIGH)).select("ext"), "ext", "left_semi")
    return winners(ratios(tried(again, ("lzma",))).unionByName(first.join(won.select("ext", "codec"), ["ext", "codec"], "left_semi")))


def smallest(tries: DataFrame) -> DataFrame:
    """The codec of the smallest output for each block, the cheaper of equal ones."""
    cost = F.create_map(*(x for c in Codec for x in (F.lit(c.name), F.lit(c.cost))))
    return tries.groupBy("ext", "hash").agg(F.min_by("codec", F.struct("packed", cost[F.col("codec")])).alias("codec"), F.min("packed").alias("packed"))


def histogram(won: DataFrame) -> DataFrame:
    """codec, extensions, in the order of cost."""
    cost = F.create_map(*(x for c in Codec for x in (F.lit(c.name), F.lit(c.cost))))
    return won.groupBy("codec").agg(F.count(F.lit(1)).alias("extensions")).orderBy(cost[F.col("codec")])


def medians(tries: DataFrame, least: int = 100 << 10) -> DataFrame:
    """Median ratio of each codec over blocks of at least so many bytes."""
    return tries.where(F.col("length") >= least).groupBy("codec").agg(F.median(F.col("packed") / F.col("length")).alias("median_ratio"))
