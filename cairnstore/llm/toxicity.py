"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Fit: a bounded sample of labelled rows (at most EXAMPLES, by least hash of their id, of at most EXAMPLE_WORDS distinct
words in sum) gives the examples. The vector space is all their folded words; as in any fitted vectoriser, words that
no example has are no dimension. A text's vector is (1 + ln tf) * idf * relevance, of length 1: idf is
1 + ln((1 + N) / (1 + df)) with df over all documents; relevance grows with the likelihood ratio G between a word's
presence and the label in the sample, from FAINT for a word that tells nothing to 1 (FAINT + G^2 / (G^2 + K^2), K a
share DECISIVE of what labels could tell at most). No word is left out: without marking words, a text's neighbours
are those of its other words.

Score: the index keeps postings by word and, for each block of examples, every word's largest weight. Words of
many examples are kept as columns of a matrix. Texts go through in batches: the bound of a block is the
sum of a text's weights times those maxima; a text's two best blocks are read first, then those whose bound
reaches its k-th best cosine, so the k nearest are exact (cosines to six digits; ties go to the example earlier in
the index). Their votes, weighted by cosine and joined by a prior vote with the rate of the sample, are calibrated by
logistic regression on leave-one-out votes of the examples. A text without a known word gets that rate.

Labels are read only of rows whose crc32(doc_id as text) mod 3 is not 1, to fit; nothing but the text enters a score.

Defined results: null and empty texts have no words; one row per row of documents; null labels and labels
without a document are left out, of several labels of an id the largest counts; without labelled rows of both
kinds the score is the smoothed rate of label 1 (0 if there are none); a null id is not held out; an empty table
gives an empty result. Ids are numbers; columns beside id, text and toxic are left alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, materialise, slices
from .words import words

EXAMPLES, EXAMPLE_WORDS = 8000, 4_000_000
FAINT, DECISIVE = 0.01, 0.04
NEIGHBOURS, BLOCK, PRIOR, TOXIC, EVIDENCE = 16, 64, 0.5, 0.7, 3
#: Words in at least this share of the examples are columns of the matrix, WIDEST at most.
DENSE, WIDEST = 1 / 12, 512
#: Texts scored at once, and postings they may read (or one text).
BATCH, READ = 64, 1 << 19


def bags(batch: pa.RecordBatch, known: np.ndarray | None = None):
    """(rows, words, counts) of distinct folded words of each text, or of known ones as places in their sorted list."""
    w = words(batch.column("text"), fold=True)
    h, owner = w.hashes(), w.text_of()
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    owner, h, tf = owner[start], h[start], np.diff(np.concatenate([start, [len(h)]]))
    if known is None:
        return owner, h, tf
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    ok = known[at] == h if len(known) else np.zeros(len(h), bool)
    return owner[ok], at[ok], tf[ok]


def _bags_of(batches):
    for batch in slices(batches):
        owner, h, tf = bags(batch)
        cut = np.searchsorted(owner, np.arange(batch.num_rows + 1)).tolist()
        parts = [(h[a:b].tobytes(), tf[a:b].astype(np.int32).tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"), pa.array(np.diff(cut)), *(pa.array([x[i] for x in parts], pa.binary()) for i in range(2))], ["doc_id", "toxic", "n", "h", "tf"])


def _frequencies(known):
    def run(batches):
        f, n = known.value, 0
        df = np.zeros(len(f) + 1, np.int64)
        for batch in slices(batches):
            n += batch.num_rows
            df[: len(f)] += np.bincount(bags(batch, f)[1], minlength=len(f))
        df[-1] = n
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], ["place", "df"])

    return run


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How much words tell that stand in so many toxic and clean examples."""
    n, total = toxic + clean, n_toxic + n_clean
    part = lambda x, rate: np.where(x > 0, x * np.log(np.maximum(x, 1) / (n * rate)), 0.0)
    g = 2 * (part(toxic, n_toxic / total) + part(clean, n_clean / total))
    most = -2 * (n_toxic * math.log(n_toxic / total) + n_clean * math.log(n_clean / total))
    return FAINT + g**2 / (g**2 + (DECISIVE * most) ** 2)


class Index:
    """The examples, their postings and block maxima, and the calibration. Bounded by EXAMPLES and EXAMPLE_WORDS."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """known: sorted hashes of words; examples: id, label, places of distinct words, their counts."""
        self.known, self.weight = known, weight
        self.rate = (sum(y for _, y, _, _ in examples) + 0.5) / (len(examples) + 1) if examples else 0.0
        heavy = lambda at, tf: int(at[np.argmax((1 + np.log(tf)) * weight[at])])
        made = sorted((x for x in examples if len(x[2])), key=lambda x: (heavy(x[2], x[3]), x[0]))  # neighbours are alike: tight bounds
        self.ids, self.y = np.array([x[0] for x in made], np.int64), np.array([x[1] for x in made], float)
        self.blocks = max(-(-len(made) // BLOCK), 1)
        owner = np.repeat(np.arange(len(made), dtype=np.int32), [len(x[2]) for x in made])
        at, tf = (np.concatenate([np.zeros(0, np.int32), *(x[i] for x in made)]).astype(np.int32) for i in (2, 3))
        value = self.vectors(owner, at, tf, len(made))
        order = np.argsort(at, kind="stable").astype(np.int32)
        self.who, self.value = owner[order], value[order]
        self.first = np.searchsorted(at[order], np.arange(len(known) + 1))
        held = np.diff(self.first)
        wide = np.argsort(-held, kind="stable")[:WIDEST]
        wide = wide[held[wide] >= max(DENSE * len(made), 1)]
        self.column = np.full(len(known), -1, np.int32)
        self.column[wide] = np.arange(len(wide))
        self.matrix = np.zeros((len(wide), self.blocks * BLOCK), np.float32)
        dense = self.column[at] >= 0
        self.matrix[self.column[at[dense]], owner[dense]] = value[dense]
        self.most = self.matrix.reshape(len(wide), self.blocks, BLOCK).max(2)
        self.a, self.b = 1.0, 0.0
        if 0 < self.y.sum() < len(made):
            self.a, self.b = logistic(_logit(self.votes(*self.nearest(owner, at, tf, len(made), alone=True))), self.y)

    def vectors(self, owner: np.ndarray, at: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        """Weights of the words (places at, counts tf) of n texts, each of length 1."""
        value = (1 + np.log(tf.astype(np.float32))) * self.weight.astype(np.float32)[at]
        size = np.sqrt(np.bincount(owner, value * value, n)).astype(np.float32)
        return value / size[owner]

    def nearest(self, owner: np.ndarray, at: np.ndarray, tf: np.ndarray, n: int, k: int = NEIGHBOURS, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples of each of n texts, best first; a cosine of 0 is none. alone:
        the texts are the examples, and none is its own neighbour."""
        value, found, lo = self.vectors(owner, at, tf, n), [], 0
        cut = np.searchsorted(owner, np.arange(n + 1))
        read = np.concatenate([[0], np.cumsum(np.bincount(owner, np.where(self.column[at] < 0, np.diff(self.first)[at], 0), n))])
        while lo < n:
            hi = max(lo + 1, min(lo + BATCH, n, int(np.searchsorted(read, read[lo] + READ, "right")) - 1))
            part = slice(cut[lo], cut[hi])
            found.append(self._nearest(owner[part] - lo, at[part], value[part], hi - lo, k, np.arange(lo, hi) if alone else None))
            lo = hi
        empty = np.zeros((0, k))
        return tuple(np.concatenate([empty.astype(t), *(x[j] for x in found)]) for j, t in ((0, np.int64), (1, float)))

    def _nearest(self, owner, at, value, n: int, k: int, skip):
        wide, width = self.column[at], self.blocks * BLOCK
        rare = wide < 0
        begin, count = self.first[at[rare]], np.diff(self.first)[at[rare]]
        inside = np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)
        spot = np.repeat(owner[rare].astype(np.int64) * width, count) + self.who[inside]
        cos = np.bincount(spot, np.repeat(value[rare], count) * self.value[inside], n * width).reshape(n, self.blocks, BLOCK)
        query = np.zeros((n, len(self.matrix)), np.float32)
        query[owner[~rare], wide[~rare]] = value[~rare]
        bound = cos.max(2) + query @ self.most + 1e-5
        done, each = np.zeros((n, self.blocks), bool), np.arange(n)

        def read(todo):
            for b in np.flatnonzero(todo.any(0)).tolist():
                rows = np.flatnonzero(todo[:, b])
                cos[rows, b] += query[rows] @ self.matrix[:, b * BLOCK : (b + 1) * BLOCK]
            done[todo] = True
            cos[~done] = 0
            if skip is not None:
                cos.reshape(n, width)[each, skip] = 0

        rest = cos.copy()
        best = np.argsort(-bound, axis=1, kind="stable")[:, :2]
        todo = np.zeros_like(done)
        todo[each[:, None], best] = True
        read(todo)
        few = np.take_along_axis(cos, best[:, :, None], 1).reshape(n, -1)
        least = np.partition(few, -k, axis=1)[:, -k] if few.shape[1] >= k else np.zeros(n)
        todo = ~done & (bound >= least[:, None]) & (bound > 2e-5)
        cos[todo] = rest[todo]
        read(todo)
        cos = np.rint(cos.reshape(n, width) * 1e6)
        key = np.arange(width) - cos * width  # whole numbers that a float holds exactly
        k = min(k, width)
        who = np.argpartition(key, k - 1, axis=1)[:, :k]
        who = np.take_along_axis(who, np.argsort(np.take_along_axis(key, who, 1), axis=1), 1)
        near = np.take_along_axis(cos, who, 1) / 1e6
        pad = NEIGHBOURS - k
        return (np.pad(who, ((0, 0), (0, pad))), np.pad(near, ((0, 0), (0, pad)))) if pad > 0 else (who, near)

    def votes(self, who: np.ndarray, cos: np.ndarray) -> np.ndarray:
        y = np.concatenate([self.y, np.zeros(self.blocks * BLOCK - len(self.y))])
        return ((cos * y[who]).sum(1) + PRIOR * self.rate) / (cos.sum(1) + PRIOR)

    def scores(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a * _logit(votes) + self.b)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method, with smoothed targets and a slope held near 1 by a weak prior."""
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    m, at = np.stack([x, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ at, -30, 30)))
        grad = m.T @ (p - goal) + (at - [1.0, 0.0])
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + np.eye(2), grad)
        at = at - np.clip(step, -1, 1)
    return max(float(at[0]), 0.01), float(at[1])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, example_words: int = EXAMPLE_WORDS) -> Index | float:
    """An index, or a rate where there is nothing to learn. docs: doc_id, text; labels: doc_id, toxic."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = materialise(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), "labelled")
    rows = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = materialise(rows.mapInArrow(_bags_of, "doc_id long, toxic int, n long, h binary, tf binary"), "examples")
    chosen, held = [], 0
    for r in rows.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if held + r.n <= example_words:
            chosen.append(r.doc_id)
            held += r.n
    if len(chosen) < examples:
        rows = rows.join(F.broadcast(spark.createDataFrame([(d,) for d in chosen], "doc_id long")), "doc_id", "left_semi")
    held = rows.toArrow()
    bag = zip(held["doc_id"].to_pylist(), held["toxic"].to_pylist(), held["h"], held["tf"], strict=True)
    found = sorted((d, y, np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(tf.as_buffer(), np.int32)) for d, y, h, tf in bag) if chosen else []
    total, toxic = len(found), sum(y for _, y, _, _ in found)
    if not 0 < toxic < total:
        return float((toxic + 0.5) / (total + 1)) if total else 0.0
    vocabulary = np.unique(np.concatenate([h for _, _, h, _ in found]))
    placed = [(d, y, np.searchsorted(vocabulary, h).astype(np.int32), tf.copy()) for d, y, h, tf in found]
    held = found = bag = None
    counts = np.zeros((2, len(vocabulary)), np.int64)
    for _, y, at, _ in placed:
        counts[y, at] += 1
    sent = Shared(spark, vocabulary)
    df = np.zeros(len(vocabulary) + 1)
    counted = docs.select("text").mapInArrow(_frequencies(sent), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    df[counted["place"].to_numpy()] = counted["df"].to_numpy()
    idf = 1 + np.log((1 + df[-1]) / (1 + df[:-1]))
    return Index(vocabulary, idf * relevance(counts[1], counts[0], toxic, total - toxic), placed)


EVIDENCE_TYPE = "array<struct<doc_id:long,cosine:double,toxic:int>>"


def _score(index):
    def run(batches):
        x = index.value
        for batch in slices(batches):
            n = batch.num_rows
            who, cos = x.nearest(*bags(batch, x.known), n)
            scores = x.scores(x.votes(who, cos))
            some = cos[:, :EVIDENCE] > 0
            w = who[:, :EVIDENCE][some]
            shown = pa.StructArray.from_arrays([pa.array(x.ids[w]), pa.array(cos[:, :EVIDENCE][some]), pa.array(x.y[w].astype(np.int32))], ["doc_id", "cosine", "toxic"])
            cut = np.concatenate([[0], np.cumsum(some.sum(1))]).astype(np.int32)
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), pa.array(scores), pa.ListArray.from_arrays(pa.array(cut), shown)], ["doc_id", "rid", "score", "evidence"])

    return run


def scored_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, example_words: int = EXAMPLE_WORDS) -> DataFrame:
    """The columns of toxicity and rid, the xxhash64 of the text scored."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    index = fit(texts, labels.select(F.col(id_col).cast("long").alias("doc_id"), "toxic"), examples, example_words)
    texts = texts.withColumn("rid", F.xxhash64("text"))
    if isinstance(index, float):
        scored = texts.select("doc_id", "rid", F.lit(index).alias("score"), F.array().cast(EVIDENCE_TYPE).alias("evidence"))
    else:
        scored = texts.mapInArrow(_score(Shared(docs.sparkSession, index)), f"doc_id long, rid long, score double, evidence {EVIDENCE_TYPE}")
    return scored.select("doc_id", "rid", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"), "evidence")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES, example_words: int = EXAMPLE_WORDS) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples, cosines, labels) of every row."""
    return scored_rows(docs, labels, id_col, text_col, examples, example_words).drop("rid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
