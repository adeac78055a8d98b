"""Near-dedup classes against all pairs of weighted Jaccard similarities."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from cairnstore.llm import neardup
from cairnstore.llm.words import mix


def fixture(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(3))
    rows, i = [], 0
    for _ in range(n):
        base = [word() for _ in range(r.choice([5, 12, 80, 200]))]
        for _ in range(r.choice([1, 1, 2, 5, 30 if n > 100 else 9])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 6])):
                w[r.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    r.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "one  two"), (905, "two one"), (906, "same " * 400), (907, "same " * 390), (908, "same " * 40)]


def bags(rows):
    for _, t in rows:
        batch = pa.record_batch([pa.array([t or ""], pa.large_string())], ["text"])
        _, _, x, tf = next(neardup.texts_of(batch))
        yield dict(zip(x.tolist(), tf.tolist(), strict=True))


def idf(rows, share=neardup.SHARE):
    """The idf of every shingle by counting all of them."""
    df = Counter(k for b in bags(rows) for k in b)
    floor = max(share * sum(df.values()), 1)
    return {k: 1 + math.log(len(rows) / n) / math.log(len(rows) / floor) if n > floor else 2.0 for k, n in df.items()}


def similarity(a, b, w):
    inter = sum(min(a[k], b[k]) * w[k] for k in a if k in b)
    union = sum(v * w[k] for k, v in a.items()) + sum(v * w[k] for k, v in b.items()) - inter
    return inter / union if union else float(not a and not b)


def classes(rows, share=neardup.SHARE):
    return brute(rows, list(bags(rows)), idf(rows, share))


def brute(rows, held, w, threshold=0.8):
    root = list(range(len(rows)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i in range(len(rows)):
        for j in range(i):
            if similarity(held[i], held[j], w) >= threshold:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_classes(spark):
    rows = fixture()
    df = spark.createDataFrame([(*x, "z", 5) for x in rows], "doc_id long, text string, bands string, c int").repartition(3)
    for share, block in ((neardup.SHARE, 256), (neardup.SHARE, 8), (1 / 5000, 256)):
        got = {g.doc_id: g.class_id for g in neardup.near_classes(df, share=share, block=block).collect()}
        assert got == classes(rows, share)


def test_weights(spark, monkeypatch):
    """Exact document frequencies of all shingles over the floor, from blocks that hold only parts of them."""
    r = random.Random(8)
    lines = [" ".join(f"l{r.randrange(10**6)}" for _ in range(9)) for _ in range(30)]
    rows = [(i, "\n".join([*(x for k, x in enumerate(lines) if r.random() < (0.8 if k < 3 else 1 / (k + 1))), *(f"u{r.randrange(10**9)}" for _ in range(40))])) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("text")
    seen = set()
    for share, counted in ((2**-16, 1 << 22), (1 / 2000, 1000), (1 / 300, 3000)):
        monkeypatch.setattr(neardup, "COUNTED", counted)
        want = idf(rows, share)
        got = neardup.weights(df, share)
        x = np.array(list(want), np.uint64)
        assert np.abs(got(x) - np.array(list(want.values()))).max() < 1e-9
        assert len(got.weight) <= 1 / share
        seen.add(len(got.weight))
    assert len(seen) == 3 and min(seen) > 0


def test_recall_of_all_pairs():
    """Of all pairs of a weighted similarity of 0.8 or more, those that share a band."""
    rows = [(i, t or "") for i, t in fixture(3, 150)]
    w, held = idf(rows), list(bags(rows))
    sampler, sign = neardup.Sampler(), []
    for b in held:
        x = np.array(sorted(b), np.uint64)
        sign.append(sampler.bands(x, np.array([w[k] * b[k] for k in x.tolist()]), np.array([len(x)]))[0] if b else np.zeros(neardup.BANDS))
    found = total = 0
    for i in range(len(rows)):
        for j in range(i):
            if held[i] and similarity(held[i], held[j], w) >= 0.8:
                total += 1
                found += (sign[i] == sign[j]).any()
    assert total > 200 and found >= 0.99 * total


def test_edges(spark):
    shape = "doc_id long, text string"
    assert neardup.near_classes(spark.createDataFrame([], shape)).collect() == []
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (None, long), (3, "short text here"), (3, "short text here"), (4, None)]
    got = neardup.near_classes(spark.createDataFrame(rows, shape)).collect()
    assert sorted((str(g.doc_id), g.class_id) for g in got) == [("1", 1), ("2", 1), ("3", 3), ("3", 3), ("4", 4), ("None", 1)]


def test_samples_estimate_similarity():
    sampler, rng = neardup.Sampler(), np.random.default_rng(1)
    hits, want = 0, 0.0
    for _ in range(150):
        x = mix(rng.integers(0, 2**62, 60, dtype=np.uint64))
        w = rng.integers(1, 4, 60) * rng.uniform(1, 2, 60)
        a, b = slice(0, 50), slice(10, 60)
        inter = w[10:50].sum()
        want += (inter / w.sum()) ** neardup.ROWS
        m = sampler.bands(np.concatenate([x[a], x[b]]), np.concatenate([w[a], w[b]]), np.array([50, 50]))
        hits += (m[0] == m[1]).sum()
    assert abs(hits / 150 / neardup.BANDS - want / 150) < 0.03


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(50)] + [(3099 - i, 3099) for i in range(50)]
    root = {v: v for e in edges for v in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {x.v: x.c for x in neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: root[v] for e in edges if e[0] != e[1] for v in e}


def test_large_group(spark):
    """A group of many blocks beside texts that are candidates only: classes as of all pairs, a settled group at rest."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(1 if i < 70 else 5 if i < 80 else 2):
            w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"x{r.randrange(10**6)}" for _ in range(120))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    w, held = idf(rows), list(bags(rows[:90]))
    assert min(w[k] for b in held for k in b) > 1.2
    got = {g.doc_id: g.class_id for g in neardup.near_classes(df, block=8).collect()}
    assert got == brute(rows[:90], held, w) | {d: d for d, _ in rows[90:]}
    sizes = Counter(got.values())
    assert max(sizes.values()) > 40 and sum(n == 1 for c, n in sizes.items() if c < 90) > 3
    large = spark.createDataFrame([(i, 100, b) for i in range(40) for b in (0, 1)], "v long, n int, c long")
    one = spark.createDataFrame([(i, 0) for i in range(40)], "v long, c long")
    assert neardup._unsettled(large, one, 8, 10**6).count() == 0
    two = one.where("v < 39")
    tasks = neardup._unsettled(large, two, 8, 10**6).groupBy("task").count().count()
    assert tasks == 6  # five blocks of the class with the one left over, and that by itself; one bucket of the two equal ones


def test_shared_ids(spark):
    """Near copies are found among all texts of one id, not only that of the first."""
    r = random.Random(4)
    base = [[f"w{r.randrange(10**6)}" for _ in range(90)] for _ in range(6)]
    rows = [(i, " ".join(b)) for i in (5, None) for b in (base[:3] if i else base[3:])]
    rows += [(10 + k, " ".join(["new", *b[1:]])) for k, b in enumerate(base)]
    got = neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(5, 5)] * 3 + [(10, 5), (11, 5), (12, 5)] + [(None, 13), (None, 14), (None, 15)] + [(13, 13), (14, 14), (15, 15)]
    assert sorted(map(str, ((g.doc_id, g.class_id) for g in got))) == sorted(map(str, want))
