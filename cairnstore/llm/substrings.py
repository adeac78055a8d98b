"""Substring deduplication with suffix automata of sharded reference text.

A word goes if a window of 13 words over it also starts in a document with a smaller id. A window is named by
its anchor, the least hash of its five-word shingles: equal windows have equal anchors, and neighbours mostly
share one, so about a fifth as many anchors as windows are shuffled. Anchors of a single document end there. The
rest cut out spans, and spans go to the shard that their anchors' documents (first, last, number) name, so equal
windows meet in one shard. There a suffix automaton holds the text of smaller ids; each distinct span streams
through it for matching statistics, windows matched over at least 13 words go, and only windows it did not know
are added, so a shard holds distinct text however many copies there are.

Automata are built in the shard that needs them, not broadcast whole: with every document a reference for later
ones, sending each automaton to every task would cost the square of the corpus. Spans of anchors that more than
HOT documents have are single windows and their own shards, equal ones joined before the shuffle, so a passage in
a third of all documents burdens no task.

Texts move as little as may be: sieves keep anchors, texts and losses that meet nothing out of the shuffles, a text
without losses is never shuffled for its digest, only spans are stored, and each step's shuffle files go with it.

Defined results: null texts have no words; a null id counts as the largest; rows of one id do not remove words
from each other; a document shorter than 13 words keeps all; an empty table gives an empty result. Columns beside
id and text are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matching, materialise, sieved, slices
from .words import shingles, words

LENGTH, GRAM = 13, 5
#: An anchor of more documents than this makes single-window shards.
HOT = 5000
LAST = (1 << 63) - 1


class Automaton:
    """A generalised suffix automaton over words."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]

    def add(self, text: list) -> None:
        nxt, link, length, last = self.next, self.link, self.len, 0
        for w in text:
            q = nxt[last].get(w)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._split(last, q, w)
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][w]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = new

    def _split(self, p: int, q: int, w) -> int:
        """A state for the longest match through p, apart from longer texts in q."""
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def statistics(self, text: list) -> Iterator[int]:
        """For each word, how many words up to it are a substring of what was added."""
        nxt, link, length, at, n = self.next, self.link, self.len, 0, 0
        for w in text:
            to = nxt[at].get(w)
            while to is None and at:
                at = link[at]
                n = length[at]
                to = nxt[at].get(w)
            if to is not None:
                at, n = to, n + 1
            yield n


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def anchors(w, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window by the word it starts with, and which windows lie in one text."""
    h = w.hashes()
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g, wide, have = shingles(h, gram), length - gram + 1, 1
    while have < wide:
        step = min(have, wide - have)
        g, have = np.minimum(g[: len(g) - step], g[step:]), have + step
    text = w.text_of()
    return g[:n], text[:n] == text[length - 1 :]


def _emit_anchors(length: int, gram: int):
    def run(batches):
        for batch in slices(batches):
            w = words(batch.column("text"))
            a, whole = anchors(w, length, gram)
            text = w.text_of()[: len(a)]
            new = whole.copy()
            if len(a):
                new[1:] &= (a[1:] != a[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
            pick = np.flatnonzero(new)
            ids = batch.column("d").to_numpy()
            yield pa.record_batch([pa.array(_signed(a[pick])), pa.array(ids[text[pick]])], ["a", "d"])

    return run


def _emit_spans(length: int, gram: int, hot: int):
    """The spans of each text whose windows others share: key, first word, words, text."""

    def run(batches):
        for batch in slices(batches):
            w = words(batch.column("text"))
            a, _ = anchors(w, length, gram)
            signed, exact = _signed(a), _signed(shingles(w.hashes(), length))
            ids, rids, hits = batch.column("d").to_pylist(), batch.column("rid").to_pylist(), batch.column("hits")
            spans = []
            for i in range(batch.num_rows):
                first, last = int(w.first[i]), int(w.first[i + 1])
                if last - first < length:
                    continue
                hit = hits[i].values
                known = hit.field("a").to_numpy()
                order = np.argsort(known)
                known = known[order]
                key, n = (hit.field(c).to_numpy()[order] for c in ("k", "n"))
                mine = signed[first : last - length + 1]
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                found = known[at] == mine
                alone = n[at] > hot
                k = np.where(alone, exact[first : last - length + 1], key[at])
                cut = np.ones(len(mine) + 1, bool)
                cut[1:-1] = (k[1:] != k[:-1]) | (found[1:] != found[:-1]) | alone[1:]
                edge = np.flatnonzero(cut)
                spans += [(ids[i], rids[i], int(k[b]), b, e - b + length - 1, w.span(first + b, first + e + length - 1)) for b, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if found[b]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            rows = [pa.array([x[j] for x in spans], kind) for j, kind in enumerate(kinds)]
            yield pa.record_batch([*rows[:5], rows[5].cast(pa.string())], ["d", "rid", "k", "s", "n", "t"])

    return run


def _match(length: int):
    """Of each distinct span of a shard, by the first id that has it: the windows a smaller id has, as runs of
    words."""

    def flush(held, automaton, out):
        for k, m, t, w in held:
            seen = np.fromiter(automaton.statistics(w), np.int64, len(w)) >= length
            ends = np.flatnonzero(seen)
            runs = []
            for e in ends.tolist():
                b = e - length + 1
                if runs and b <= runs[-1][1]:
                    runs[-1][1] = e + 1
                else:
                    runs.append([b, e + 1])
            out.append((k, m, t, [x for r in runs for x in r]))
            fresh = np.flatnonzero(~seen[length - 1 :])
            if len(fresh):
                for part in np.split(fresh, np.flatnonzero(np.diff(fresh) > 1) + 1):
                    yield w[part[0] : part[-1] + length]

    def run(batches):
        automaton, shard, least, held = None, None, None, []
        for batch in batches:
            out: list = []
            for k, m, t in zip(*(batch.column(c).to_pylist() for c in ("k", "m", "t")), strict=True):
                if (k, m) != (shard, least) and held:
                    for fresh in list(flush(held, automaton, out)):
                        automaton.add(fresh)
                    held = []
                if k != shard:
                    automaton = Automaton()
                shard, least = k, m
                held.append((k, m, t, t.split(" ")))
            yield _matched(out)
        out = []
        if held:
            list(flush(held, automaton, out))
        yield _matched(out)

    return run


def _matched(out):
    return pa.record_batch(
        [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.md5(x[2].encode()).digest() for x in out], pa.binary()), pa.array([x[3] for x in out], pa.list_(pa.int32()))],
        ["k", "m", "th", "runs"],
    )


def _finish():
    def run(batches):
        for batch in slices(batches):
            w = words(batch.column("text"))
            removed, digest, total = [], [], np.diff(w.first).astype(np.int64)
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                a, b = int(w.first[i]), int(w.first[i + 1])
                keep = np.ones(b - a + 1, np.int64)
                keep[-1] = 0
                gone = np.zeros(b - a + 1, np.int64)
                for s, e in runs or ():
                    gone[s] += 1
                    gone[e] -= 1
                keep[gone.cumsum() > 0] = 0
                step = np.flatnonzero(np.diff(np.concatenate([[0], keep])))
                parts = [w.span(a + x, a + y) for x, y in zip(step[::2].tolist(), step[1::2].tolist(), strict=True)]
                removed.append(b - a - int(keep.sum()))
                digest.append(hashlib.sha256(b" ".join(parts)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(total), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by a space)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("d"), F.xxhash64("text").alias("rid"), "text")
    points = texts.select("d", "text").mapInArrow(_emit_anchors(length, gram), "a long, d long")
    shared = points.groupBy("a").agg(F.min("d").alias("f"), F.max("d").alias("l"), F.count(F.lit(1)).alias("n")).where("f < l")
    shared = materialise(shared.select("a", F.xxhash64("f", "l", "n").alias("k"), "n"), "anchors", True)
    hits = matching(points, shared, ["a"]).groupBy("d").agg(F.collect_set(F.struct("a", "k", "n")).alias("hits"))
    hits = materialise(hits.withColumnRenamed("d", "hit"), "anchor-hits", True)
    open_ = sieved(texts, F.xxhash64("d"), hits.select(F.xxhash64("hit").alias("key")), "open").where("open")
    place = open_.join(hits, F.col("d") == F.col("hit")).select("d", "rid", "text", "hits")
    place = materialise(place.mapInArrow(_emit_spans(length, gram, hot), "d long, rid long, k long, s int, n int, t string"), "spans", True)
    first = place.groupBy("k", "t").agg(F.min("d").alias("m"))
    matched = materialise(first.repartition("k").sortWithinPartitions("k", "m").mapInArrow(_match(length), "k long, m long, th binary, runs array<int>"), "matched", True)
    where = place.select("d", "rid", "s", "n", "k", F.unhex(F.md5(F.col("t").cast("binary"))).alias("th"))
    own = F.transform(F.sequence(F.lit(0), (F.size("runs") / 2).cast("int") - 1), lambda i: F.struct((F.col("s") + F.get("runs", 2 * i)).alias("s"), (F.col("s") + F.get("runs", 2 * i + 1)).alias("e")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    runs = F.when(F.col("d") > F.col("m"), F.array(F.struct("s", (F.col("s") + F.col("n")).alias("e")))).when(F.size("runs") > 0, own).otherwise(none)
    gone = where.join(matched, ["k", "th"]).select(F.col("d").alias("gd"), F.col("rid").alias("grid"), runs.alias("runs")).where(F.size("runs") > 0)
    gone = gone.groupBy("gd", "grid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    gone = materialise(gone.select("gd", "grid", F.transform("runs", lambda r: F.array(r["s"], r["e"])).alias("runs")), "removed", True)
    marked = sieved(texts, F.xxhash64("d"), gone.select(F.xxhash64("gd").alias("key")), "loses")
    whole = marked.where("NOT loses").select("doc_id", "text", F.lit(None).cast("array<array<int>>").alias("runs"))
    less = marked.where("loses").join(gone, (F.col("d") == F.col("gd")) & (F.col("rid") == F.col("grid")), "left").select("doc_id", "text", "runs")
    return whole.unionByName(less).mapInArrow(_finish(), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) a),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i FROM g JOIN f ON g.k = f.k WHERE f.least < g.doc_id) a, range(0, 13) z(o)),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i WHERE r.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
