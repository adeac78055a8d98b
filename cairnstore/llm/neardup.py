"""MinHash near-deduplication: improved consistent weighted sampling over TF-IDF shingles.

A text is the multiset of its five-word shingles. A shingle weighs its count times an idf in [1, 2],
1 + ln(N / df) / ln(N / floor) for a document frequency df over the floor, 2 up to it. The floor is SHARE of all
(text, distinct shingle) pairs: what fewer texts share counts as rare, whatever the size of the corpus. Two texts are
linked if their weighted Jaccard similarity reaches the threshold. Classes are the connected components of links,
named by their smallest id.

Document frequencies over the floor are exact, over all documents. At most 1/SHARE shingles have one, and a shingle
that has holds half the floor's share of some block of texts, so two passes find them: the first counts
each block by itself and sends on what reaches half the share there (at most 2/SHARE shingles can still be over the
floor by the sums of these), the second counts those in all texts. So what is broadcast has a bound that
does not grow with the corpus.

Candidates: BANDS * ROWS consistent weighted samples in BANDS bands; two texts of a weighted similarity of 0.8 share a
band with a probability of 0.9996. Texts of small candidate components are gathered and compared as matrix products,
those of a large one in blocks, then the hubs of their trees, and so on; what is not in one class by then is
compared within each bucket of a band, in pairs of blocks. Nothing but a spanning forest of the links leaves a task.

Copies (texts with the same shingles) are one text in all this, so thousands of copies cost no more than one.

Defined results: null texts are empty; texts without words are one class; a text of one to four words is a single
shingle; a null id counts as the largest and is given back as null; every row is judged by its own text, whatever
rows share its id; an empty table gives an empty result. Columns beside id and text are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, materialise, matching, slices, small
from .words import mix, shingles, words

GRAM, BANDS, ROWS, THRESHOLD = 5, 20, 5, 0.8
#: The share of all (text, distinct shingle) pairs from which on a shingle's document frequency lowers its weight.
SHARE = 2.0**-16
#: Pairs counted as one block, and bytes of text to a task that counts.
COUNTED, TASK_BYTES = 1 << 21, 24 << 20
#: Texts and words of a block of a large component.
BLOCK, BLOCK_WORDS = 256, 500_000
LAST = (1 << 63) - 1
POINTS = 4096
#: Columns of the incidence matrix handled at once.
WIDE = 8192


def gamma_quantiles(n: int = POINTS) -> np.ndarray:
    """Gamma(2, 1) at the middles of n equal probabilities: solves 1 - (1 + x) exp(-x) = p by Newton's method."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p) + p
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-12), 1e-9)
    return x


def texts_of(batch: pa.RecordBatch):
    """(row, distinct shingles, their counts) of each text; a short text is one shingle, an empty one none."""
    w = words(batch.column("text"))
    h = w.hashes()
    g = shingles(h, GRAM)
    for i in range(batch.num_rows):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= GRAM:
            yield (i, b - a, *np.unique(g[a : b - GRAM + 1], return_counts=True))
        elif b > a:
            yield i, b - a, mix(mix(h[a:b] + np.arange(b - a, dtype=np.uint64)).sum(keepdims=True)), np.ones(1, np.int64)
        else:
            yield i, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)


def _blocks_of(batches):
    """Distinct shingles of many texts, in blocks of COUNTED: sorted shingles, their texts, texts of the block."""
    held, size, n = [], 0, 0
    for batch in slices(batches):
        for _, _, x, _ in texts_of(batch):
            held.append(x)
            size += len(x)
            n += 1
            if size >= COUNTED:
                yield *np.unique(np.concatenate(held), return_counts=True), size, n
                held, size, n = [], 0, 0
    if held:
        yield *np.unique(np.concatenate(held), return_counts=True), size, n


def _common_in_blocks(share: float):
    """h, df, pairs: what has half the share of a block, with the block's pairs; h null: its texts and pairs."""

    def run(batches):
        for x, df, pairs, texts in _blocks_of(batches):
            some = df >= max(1.0, share * pairs / 2)
            h = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(x[some].view(np.int64))])
            yield pa.record_batch([h, pa.array(np.concatenate([[texts], df[some]])), pa.array(np.full(len(h), pairs))], ["h", "df", "pairs"])

    return run


class Places:
    """Looks 64-bit hashes up in a sorted list."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.may = np.zeros(1 << 20, bool)
        self.may[(keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of x are in the list, and where there."""
        maybe = np.flatnonzero(self.may[(x >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.keys, x[maybe])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == x[maybe] if len(self.keys) else np.zeros(0, bool)
        return maybe[hit], at[hit]


def _count(places):
    def run(batches):
        at = places.value
        df = np.zeros(len(at.keys), np.int64)
        for batch in slices(batches):
            for _, _, x, _ in texts_of(batch):
                df[at(x)[1]] += 1
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], ["place", "df"])

    return run


class Weights:
    """The idf of every shingle: those of common shingles are listed, all others weigh 2."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, texts: int, floor: float) -> None:
        over = df > floor
        self.at = Places(keys[over])
        self.weight = 1 + np.log(texts / df[over]) / math.log(texts / floor) if over.any() else np.zeros(0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), 2.0)
        hit, at = self.at(x)
        out[hit] = self.weight[at]
        return out


def weights(texts: DataFrame, share: float = SHARE) -> Weights:
    """Weights by the exact document frequencies of all shingles over the floor. What comes to the driver is bounded
    by share alone."""
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = texts.select("text").coalesce(max(1, -(-held // TASK_BYTES)))  # many small partitions make too small blocks
    found = materialise(packed.mapInArrow(_common_in_blocks(share), "h long, df long, pairs long"), "common")
    documents, pairs = found.where("h IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("pairs"), F.lit(0))).first()
    floor = max(share * pairs, 1.0)
    known = found.where("h IS NOT NULL").groupBy("h").agg(F.sum("df").alias("df"), F.sum("pairs").alias("pairs"))
    known = known.where((F.col("df") >= share / 2 * (pairs + F.col("pairs"))) & ((F.col("df") > 1) | (F.col("pairs") < pairs)))
    keys = np.sort(np.array([r.h for r in known.select("h").collect()], np.int64).view(np.uint64))
    df = np.zeros(len(keys), np.int64)
    if len(keys):
        sent = Shared(texts.sparkSession, Places(keys))
        for r in packed.mapInArrow(_count(sent), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():
            df[r.place] = r.df
    return Weights(keys, df, documents, floor)


class Sampler:
    """Improved consistent weighted samples of many sets at once."""

    def __init__(self) -> None:
        r = gamma_quantiles()
        self.r, self.over, self.ln = r.astype(np.float32), (1 / r).astype(np.float32), np.log(r).astype(np.float32)
        self.keys = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def bands(self, x: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row of band hashes for each set; the sets lie one after the other in x, size has their lengths, all
        over 0."""
        start, ln_w = np.cumsum(size) - size, np.log(weight).astype(np.float32)
        owner = np.repeat(np.arange(len(size)), size)
        out = np.zeros((len(size), BANDS), np.uint64)
        for band in range(BANDS):
            key = np.full(len(size), band + 1, np.uint64)
            for row in range(ROWS):
                z = x * self.keys[band * ROWS + row]
                z ^= z >> np.uint64(32)
                z *= np.uint64(0xD6E8FEB86659FD93)
                at = (z >> np.uint64(52)).astype(np.int64)
                r = self.r.take(at)
                beta = ((z >> np.uint64(16)) & np.uint64(0xFFFFFF)).astype(np.float32)
                beta *= np.float32(2.0**-24)
                t = ln_w * self.over.take(at)
                t += beta
                np.floor(t, out=t)
                value = t - beta
                value += 1
                value *= r
                np.subtract(self.ln.take(((z >> np.uint64(40)) & np.uint64(POINTS - 1)).astype(np.int64)), value, out=value)
                least = np.minimum.reduceat(value, start)
                hit = np.flatnonzero(value == least[owner])
                own = owner[hit]
                hit = hit[np.concatenate([[True], own[1:] != own[:-1]])]
                key = mix(key ^ x[hit] ^ (t[hit].astype(np.int64).view(np.uint64) * np.uint64(0x2545F4914F6CDD1D))) + np.uint64(1)
            out[:, band] = key
        return out


def elements(x: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """The k-th of equal shingles is an element of its own."""
    if len(x) == tf.sum():
        return x
    k = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    y = np.repeat(x, tf)
    return np.where(k > 0, mix(y + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), y)


#: Elements sampled at once: their arrays fit a processor's cache.
CHUNK = 1 << 15


def _sign(weigh):
    def run(batches):
        sampler, weight = Sampler(), weigh.value
        for batch in slices(batches):
            rows = batch.num_rows
            n, low, high = (np.zeros(rows, np.int64) for _ in range(3))
            bands = np.zeros((rows, BANDS), np.uint64)
            held: list = []

            def flush():
                bands[[y[0] for y in held]] = sampler.bands(np.concatenate([y[1] for y in held]), np.concatenate([y[2] for y in held]), np.array([len(y[1]) for y in held]))  # noqa: B023
                held.clear()  # noqa: B023

            size = 0
            for i, many, x, tf in texts_of(batch):
                n[i] = many
                if many:
                    low[i] = (mix(x) * tf.astype(np.uint64)).sum().view(np.int64)
                    high[i] = (mix(x ^ np.uint64(0x5851F42D4C957F2D)) * mix(tf.astype(np.uint64))).sum().view(np.int64)
                    held.append((i, x, weight(x) * tf))
                    size += len(x)
                    if size >= CHUNK:
                        flush()
                        size = 0
            if held:
                flush()
            signed = bands.view(np.int64).tolist()
            made = pa.array([b if k else [] for b, k in zip(signed, n.tolist(), strict=True)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("d"), batch.column("rid"), pa.array(n), pa.array(low), pa.array(high), made], ["d", "rid", "n", "low", "high", "bands"])

    return run


def _links(weigh, threshold: float):
    """Links within a block, or between two blocks: of all pairs over the threshold, a spanning forest. A link
    goes from a text u to one nearer to the hub of its tree, the text of most links, so hubs are never u."""

    def linked(held):
        ids = [d for d, _, _ in held]
        side = np.array([s for _, s, _ in held])
        parts, owner, tf_all = [], [], []
        batch = pa.record_batch([pa.array([t for _, _, t in held], pa.large_string())], ["text"])
        sizes, idf = np.zeros(len(ids)), weigh.value
        done = 0
        for part in slices(iter([batch])):
            for i, _, x, tf in texts_of(part):
                weight = idf(x)
                sizes[done + i] = float((weight * tf).sum())
                parts.append(elements(x, tf))
                tf_all.append(np.repeat(weight, tf))
                owner.append(np.full(len(parts[-1]), done + i))
            done += part.num_rows
        if not parts:
            return
        e, o, wt = np.concatenate(parts), np.concatenate(owner), np.concatenate(tf_all)
        order = np.argsort(e, kind="stable")
        e, o, wt = e[order], o[order], wt[order]
        start = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
        count = np.diff(np.concatenate([start, [len(e)]]))
        column = np.repeat(np.arange(len(start)), count)
        keep = np.repeat(count > 1, count)
        o, wt, column = o[keep], wt[keep], column[keep]
        if not len(o):
            return
        column = np.unique(column, return_inverse=True)[1]
        both = np.zeros((len(ids), len(ids)))
        last = int(column.max()) + 1
        for lo in range(0, last, WIDE):
            a, b = np.searchsorted(column, (lo, lo + WIDE))
            m = np.zeros((len(ids), min(WIDE, last - lo)), np.float32)
            m[o[a:b], column[a:b] - lo] = np.sqrt(wt[a:b])
            both += m @ m.T
        similar = both >= (threshold - 1e-6) * np.maximum(sizes[:, None] + sizes[None, :] - both, 1e-12)
        if len(set(side.tolist())) > 1:
            similar &= side[:, None] != side[None, :]
        seen = np.zeros(len(ids), bool)
        for hub in np.argsort(-similar.sum(1), kind="stable").tolist():
            front = [] if seen[hub] else [hub]
            seen[hub] = True
            for i in front:
                fresh = np.flatnonzero(similar[i] & ~seen)
                seen[fresh] = True
                front += fresh.tolist()
                yield from ((ids[j], ids[i]) for j in fresh.tolist())

    def run(batches):
        at, held = None, []
        for batch in batches:
            out = []
            for key, d, s, t in zip(*(batch.column(c).to_pylist() for c in ("task", "d", "side", "text")), strict=True):
                if key != at:
                    out += linked(held) if len(held) > 1 else ()
                    at, held = key, []
                held.append((d, s, t or ""))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])
        out = list(linked(held)) if len(held) > 1 else []
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """v, c: of every vertex of edges (u, v) the least vertex it is connected with.

    Every round links vertices to the least of their neighbours' roots and halves paths; edges within a root go,
    so rounds grow with the logarithm of a component, and each is a table.
    """
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges")
    label = materialise(edges.select(F.explode(F.array("u", "v")).alias("v")).distinct().withColumn("c", F.col("v")), f"{name}-0")
    step = 0
    while edges.limit(1).count():
        step += 1
        # each root hooks to the least root next to it
        hook = edges.groupBy("u").agg(F.min("v").alias("p"))
        hook = materialise(hook, f"{name}-hooks-{step}")
        for jump in range(64):
            up = hook.alias("a").join(hook.alias("b"), F.col("a.p") == F.col("b.u"), "left")
            up = materialise(up.select(F.col("a.u").alias("u"), F.coalesce("b.p", "a.p").alias("p"), F.col("b.p").isNotNull().alias("moved")), f"{name}-jump-{step}-{jump}")
            hook = up.select("u", "p")
            if not up.where("moved").limit(1).count():
                break
        label = materialise(label.join(hook, F.col("c") == F.col("u"), "left").select("v", F.coalesce("p", "c").alias("c")), f"{name}-{step}")
        moved = edges.join(hook.select(F.col("u").alias("x"), F.col("p").alias("pu")), F.col("u") == F.col("x"), "left").drop("x")
        moved = moved.join(hook.select(F.col("u").alias("x"), F.col("p").alias("pv")), F.col("v") == F.col("x"), "left")
        moved = moved.select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v")).where("u <> v")
        edges = materialise(moved.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-edges-{step}")
    return label


def _tasks(texts: DataFrame, members: DataFrame) -> DataFrame:
    """The texts (d, text) of members (v, task, side), those of a task together."""
    held = texts.join(small(materialise(members, "tasks")), F.col("d") == F.col("v")).select("task", "d", "side", "text")
    return held.repartition("task").sortWithinPartitions("task", "d")


def _blocks(members: DataFrame, block: int, block_words: int, level: int) -> DataFrame:
    """members (v, c, n) with the number of blocks of their component and their own block b in it."""
    total = members.groupBy("c").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words"))
    blocks = F.greatest(F.ceil(F.col("texts") / block), F.ceil(F.col("words") / block_words)).cast("int")
    total = total.select("c", F.when((F.col("texts") <= 2 * block) & (F.col("words") <= 2 * block_words), 1).otherwise(blocks).alias("blocks"))
    return members.join(total, "c").select("v", "c", "n", "blocks", F.pmod(F.xxhash64("v", F.lit(level)), F.col("blocks")).cast("int").alias("b"))


def _unsettled(buckets: DataFrame, classes: DataFrame, block: int, block_words: int) -> DataFrame:
    """v, task, side: tasks that compare all pairs of a bucket that aren't yet in one class. buckets: v, n and c, the
    bucket; a text is in many.

    A class of a block or more has blocks of its own, smaller ones share blocks; two blocks meet unless both are
    of one class, so a bucket that is one class costs nothing and a few texts beside a large class a pass over it.
    Of buckets with the same texts one is compared.
    """
    held = buckets.join(classes.select("v", F.col("c").alias("k")), "v", "left").withColumn("k", F.coalesce("k", "v"))
    held = materialise(held, "bucket-classes")
    open_ = held.groupBy("c").agg(F.min("k").alias("low"), F.max("k").alias("high"), *(F.bit_xor(F.xxhash64("v", F.lit(i))).alias(f"same{i}") for i in range(2)))
    open_ = materialise(open_.where("low < high").groupBy("same0", "same1").agg(F.min("c").alias("c")).select("c"), "open-buckets")
    held = materialise(held.join(small(open_), "c", "left_semi"), "open-classes")
    per = held.groupBy("c", "k").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("words"))
    per = per.withColumn("own", F.when((F.col("texts") >= block) | (F.col("words") >= block_words), F.col("k")))
    per = materialise(per, "class-sizes")
    groups = per.groupBy("c", "own").agg(F.sum("texts").alias("texts"), F.sum("words").alias("words"))
    many = F.greatest(F.ceil(F.col("texts") / block), F.ceil(F.col("words") / block_words)).cast("int")
    groups = materialise(groups.select("c", "own", many.alias("blocks")), "class-blocks")
    spread = groups.select("c", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    spread = materialise(spread.withColumn("side", F.xxhash64("own", "b")), "class-spread")
    meet = spread.alias("x").join(spread.alias("y"), F.col("x.c") == F.col("y.c"))
    meet = meet.where("NOT coalesce(x.own = y.own, false)").select(F.col("x.c").alias("c"), F.col("x.side").alias("side"), F.xxhash64("x.c", F.least("x.side", "y.side"), F.greatest("x.side", "y.side")).alias("task"))
    mine = held.join(per.select("c", "k", "own"), ["c", "k"])
    mine = mine.join(groups.select(F.col("c").alias("gc"), F.col("own").alias("go"), "blocks"), (F.col("c") == F.col("gc")) & F.col("own").eqNullSafe(F.col("go")))
    spot = F.pmod(F.xxhash64(F.when(F.col("own").isNull(), F.col("k")).otherwise(F.col("v"))), F.col("blocks")).cast("int")
    mine = mine.select("v", "c", F.xxhash64("own", spot).alias("side"))
    return mine.join(meet, ["c", "side"]).select("v", "task", "side")


def _member_texts(texts: DataFrame, members: DataFrame, repeated: bool) -> DataFrame:
    """d, text: vertex and text of members (v, lead, rid), one row each. repeated: rows may agree in id and text."""
    keys = materialise(members.select("v", F.col("lead").alias("d"), "rid"), "member-keys")
    found = matching(texts, keys, ["d", "rid"]).select(F.col("v").alias("d"), "text")
    return found.dropDuplicates(["d"]) if repeated else found


def near_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, share: float = SHARE, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: d (its id, LAST for null), rid (xxhash64 of its text), and those of the least row of
    its class, class_d and class_rid."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select(F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("rid"), "text")
    weigh = Shared(docs.sparkSession, weights(texts, share))
    signed = materialise(texts.mapInArrow(_sign(weigh), "d long, rid long, n long, low long, high long, bands array<long>"), "signed")
    # copies: one of each stands for all, as a vertex of its own
    same = ["n", "low", "high"]
    stand = signed.groupBy(*same).agg(F.min(F.struct("d", "rid")).alias("s"), F.first("bands").alias("bands"))
    stand = materialise(stand.select(*same, F.xxhash64(*same).alias("rep"), F.col("s.d").alias("lead"), F.col("s.rid").alias("rid"), "bands"), "stand-ins")
    rows = stand.select("rep", "n", F.posexplode("bands").alias("band", "h"))
    least = rows.groupBy("band", "h").agg(F.min("rep").alias("v"), F.max("rep").alias("top")).where("v < top").drop("top")
    stars = rows.join(materialise(least, "buckets"), ["band", "h"]).where("rep <> v").select(F.col("rep").alias("u"), "v")
    candidate = components(stars, "candidates")
    sizes = candidate.join(stand.select(F.col("rep").alias("v"), "n", "lead", "rid"), "v")
    sizes = materialise(sizes, "candidate-sizes")
    repeated = signed.groupBy("d", "rid").count().where("count > 1").limit(1).count() > 0
    texts = materialise(_member_texts(texts, sizes, repeated), "member-texts")
    links = lambda texts, tasks, name: materialise(_tasks(texts, tasks).mapInArrow(_links(weigh, threshold), "u long, v long"), name)
    mine = materialise(_blocks(sizes.select("v", "c", "n"), block, block_words, 0), "members")
    found = links(texts, mine.select("v", F.xxhash64("c", "b").alias("task"), F.lit(0).alias("side")), "links")
    large = materialise(mine.where("blocks > 1").select("v", "c", "n"), "large")
    left = large.count()
    if left:
        texts = materialise(texts.join(small(large.select("v")), F.col("d") == F.col("v"), "left_semi"), "large-texts")
    hubs, last, level = large, found, 0
    while left:
        level += 1
        hubs = materialise(hubs.join(last.select(F.col("u").alias("v")).distinct(), "v", "left_anti"), f"hubs-{level}")
        before, left = left, hubs.count()
        mine = materialise(_blocks(hubs, block, block_words, level), f"hub-blocks-{level}")
        last = links(texts, mine.select("v", F.xxhash64("c", "b").alias("task"), F.lit(0).alias("side")), f"hub-links-{level}")
        found = found.unionByName(last)
        if 2 * left > before or not mine.where("blocks > 1").limit(1).count():
            break
    classes = components(found, "classes")
    if level:
        buckets = rows.join(small(large.select(F.col("v").alias("rep"))), "rep", "left_semi").select(F.col("rep").alias("v"), "n", F.xxhash64("band", "h").alias("c"))
        rest = materialise(_unsettled(buckets, classes, block, block_words), "unsettled")
        if rest.limit(1).count():
            found = found.unionByName(links(texts, rest, "rest-links"))
            classes = components(found, "all-classes")
    placed = materialise(stand.join(classes, F.col("rep") == F.col("v")).select("c", "lead", "rid"), "placed")
    heads = materialise(placed.groupBy("c").agg(F.min(F.struct("lead", "rid")).alias("head")), "heads")
    named = stand.join(classes, F.col("rep") == F.col("v"), "left").join(small(heads), "c", "left")
    named = named.select(*same, F.coalesce("head.lead", "lead").alias("class_d"), F.when(F.col("head").isNull(), F.col("rid")).otherwise(F.col("head.rid")).alias("class_rid"))
    return signed.select("d", "rid", *same).join(materialise(named, "named"), same).select("d", "rid", "class_d", "class_rid")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, share: float = SHARE, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id of its class)."""
    null = lambda c: F.when(F.col(c) != LAST, F.col(c))
    rows = near_rows(docs, id_col, text_col, threshold, share, block, block_words)
    return rows.select(null("d").alias("doc_id"), null("class_d").alias("class_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
