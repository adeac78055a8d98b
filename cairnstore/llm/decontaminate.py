"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask keeps the tokens at its positions and ignores those between. Every place of every text is hashed under
each mask, the hashes are joined with those of the benchmark, and each alignment (text, item, offset) with a hit
is verified token by token. The two masks of weight six hit every window of 13 tokens in which at most two were
substituted (tests/llm checks all cases), so no such overlap is missed. A text leaks an item if some 13 aligned
tokens agree in 11 or more; an item of 6 to 12 tokens must agree whole. An item of fewer tokens can't be told from
chance inside a text: it is leaked by a text whose tokens are just the item's (`short`).

A benchmark of many seeds is not broadcast: places pass a sieve of bounded size first, and only hits are shuffled. Nor
are texts: those with hits are found the same way. Candidates of a text are gathered by item and by stretch of SPREAD
offsets, so repeated words make more rows, not larger ones.

Tokens are runs of letters and digits, lower-cased. Defined results: null and empty texts or items leak nothing;
an empty benchmark or table gives an empty result; repeated ids share one row per item with the best overlap;
null ids are an id. Columns beside id and text are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matching, materialise, small

MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 4, 6, 9, 10))
WINDOW, AGREE = 13, 11
#: Offsets of an item in one candidate.
SPREAD = 1 << 14
#: Values of 8 bytes that candidates may hold to be broadcast.
CELLS = 1 << 20


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _seeds(h: Column) -> Column:
    def one(k: int, mask: tuple[int, ...]) -> Column:
        last = F.size(h) - 1 - mask[-1]
        places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        return F.when(last >= 0, F.transform(places, lambda i: F.xxhash64(F.lit(k), *(F.get(h, i + o) for o in mask)))).otherwise(F.array().cast("array<bigint>"))

    return F.struct(F.size(h).alias("n"), F.concat(*(one(k, m) for k, m in enumerate(MASKS))).alias("seeds"))


def seeds(df: DataFrame, key: str) -> DataFrame:
    """key, seed, at: the masked hashes of column toks and the place of each."""
    made = df.select(key, let(F.transform("toks", lambda w: F.xxhash64(w)), _seeds).alias("x"))
    rows = made.select(key, F.col("x.n").alias("n"), F.posexplode("x.seeds").alias("pos", "seed"))
    head = F.greatest(F.col("n") - MASKS[0][-1], F.lit(0))
    return rows.select(key, "seed", F.when(F.col("pos") < head, F.col("pos")).otherwise(F.col("pos") - head).alias("at"))


def _verify(t: Column, c: Column) -> Column:
    """How text tokens t and item tokens c.toks agree when item token 0 stands at one of c.shifts: the good ones."""

    def score(shift: Column, m: Column) -> Column:
        width = F.least(F.size(m), F.lit(WINDOW))
        sums = F.transform(F.sequence(F.lit(0), F.size(m) - width), lambda s: F.aggregate(F.slice(m, s + 1, width), F.lit(0), lambda a, b: a + b))
        need = F.when(F.size(m) < WINDOW, F.size(m)).otherwise(F.lit(AGREE))
        good = F.filter(F.transform(sums, lambda x, s: F.when(x >= need, s)), lambda s: s.isNotNull())
        return let(good, lambda g: F.when(F.size(g) > 0, F.struct(F.aggregate(m, F.lit(0), lambda a, b: a + b).alias("matched"), (shift + F.get(g, F.lit(0))).alias("start"), (shift + F.element_at(F.concat(F.array(F.lit(0)), g), -1) + width).alias("end"))))

    def agree(shift: Column) -> Column:
        m = F.transform(c["toks"], lambda w, j: F.when((shift + j >= 0) & (shift + j < F.size(t)) & (F.get(t, F.greatest(shift + j, F.lit(0))) == w), 1).otherwise(0))
        return let(m, lambda m: score(shift, m))

    best = F.array_max(F.filter(F.transform(c["shifts"], agree), lambda s: s.isNotNull()))
    return F.struct(c["item_id"].alias("item_id"), best.alias("b"))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", short: bool = True) -> DataFrame:
    """One row per text and item it leaks: doc_id, item_id, start and end in tokens, matched tokens of the item."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = materialise(benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("toks")).where(F.size("toks") > 0), "items")
    items = every.where(F.size("toks") > MASKS[0][-1])
    known = materialise(seeds(items.withColumn("item", F.struct("item_id", "toks")), "item").select("seed", F.col("at").alias("item_at"), F.col("item.item_id").alias("item_id")), "item-seeds")
    places = seeds(texts.select("doc_id", tokens(F.col("text")).alias("toks")), "doc_id")
    hits = matching(places, known, ["seed"]).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    hits = hits.groupBy("doc_id", "item_id", F.floor(F.col("shift") / SPREAD).alias("stretch")).agg(F.collect_set("shift").alias("shifts"))
    listed = small(items.select(F.col("item_id").alias("known_id"), "toks"), cells=_held("toks"))
    hits = hits.join(listed, F.col("item_id").eqNullSafe(F.col("known_id"))).groupBy("doc_id", "stretch").agg(F.collect_list(F.struct("item_id", "toks", "shifts")).alias("cands"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.xxhash64("doc_id").alias("key"), "cands")
    size = F.aggregate("cands", F.lit(4).cast("long"), lambda n, c: n + 4 + F.size(c["shifts"]) + _held(c["toks"]))
    found = matching(texts.withColumn("key", F.xxhash64("doc_id")), materialise(hits, "hits"), ["key"], CELLS, size).where(F.col("doc_id").eqNullSafe(F.col("hit_id")))
    seen = found.select("doc_id", F.explode(let(tokens(F.col("text")), lambda t: F.transform("cands", lambda c: _verify(t, c)))).alias("v"))
    best = seen.where("v.b IS NOT NULL").groupBy("doc_id", F.col("v.item_id").alias("item_id")).agg(F.max("v.b").alias("b"))
    out = best.select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.end").alias("end"), F.col("b.matched").alias("matched"))
    few = every.where(F.size("toks") <= MASKS[0][-1])
    if not short or not few.limit(1).count():
        return out
    whole = texts.select("doc_id", tokens(F.col("text")).alias("toks")).join(small(few, cells=_held("toks")), "toks").select("doc_id", "item_id", F.size("toks").alias("n"))
    return out.unionByName(whole.distinct().select("doc_id", "item_id", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("n").alias("matched")))


def _held(toks: Column | str) -> Column:
    """Values of 8 bytes that tokens hold: their offsets and their letters, one of which may take four bytes."""
    return F.size(toks) + F.ceil(F.char_length(F.array_join(toks, "")) / 2)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
