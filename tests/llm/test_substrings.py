"""Substring removal against its definition, word by word."""

import hashlib
import os
import random
import re
import time

import pytest

from cairnstore.llm import common, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, length=13):
    big = float("inf")
    split = [(big if d is None else d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, w in split:
        for i in range(len(w) - length + 1):
            k = tuple(w[i : i + length])
            least[k] = min(least.get(k, big), d)
    out = []
    for (d, _), (e, w) in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if least[tuple(w[i : i + length])] < e:
                gone.update(range(i, i + length))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def fixture(seed):
    r = random.Random(seed)
    word = lambda n: " ".join(r.choice("a b c d e f é longer words here".split()) + str(r.randint(0, 3)) for _ in range(n))
    passages = [word(r.randint(5, 60)) for _ in range(12)]
    hot = word(20)
    rows = []
    for i in range(150):
        parts = [r.choice([word(r.randint(0, 25)), r.choice(passages), passages[0]]) for _ in range(r.randint(0, 6))]
        if i % 3 == 0:
            parts.insert(r.randint(0, len(parts)), hot)
        rows.append((r.randint(0, 400), r.choice(["  ", "\n", " "]).join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(20)] + [(rows[0][0], rows[5][1]), rows[7], rows[7]]
    rows += [(600, "same " * 40), (601, "same " * 13), (602, "same " * 12), (599, "x " + "same " * 30), (700, None), (701, ""), (702, " \n"), (None, rows[3][1]), (None, hot + " " + hot)]
    rows += [(800, word(20_000)), (801, word(300))]
    return rows + [(802, rows[-2][1][5000:60_000])]


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 4), (3, 0)])
def test_definition(spark, seed, hot):
    rows = fixture(seed)
    df = spark.createDataFrame([(*x, "k", "t", 1) for x in rows], "doc_id long, text string, k string, runs string, d int").repartition(3)
    got = substrings.dedup_substrings(df, hot=hot).collect()
    assert sorted((str(g.doc_id), g.n_words, g.n_removed, g.kept_sha256) for g in got) == brute(rows)


def test_empty(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton():
    r = random.Random(4)
    for _ in range(100):
        texts = [[r.choice("ab") for _ in range(r.randint(0, 12))] for _ in range(4)]
        a = substrings.Automaton()
        for t in texts:
            a.add(t)
        q = [r.choice("abc") for _ in range(20)]
        known = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i, len(t) + 1)} | {()}
        want = [max(n for n in range(i + 2) if tuple(q[i + 1 - n : i + 1]) in known) for i in range(len(q))]
        assert list(a.statistics(q)) == want


def test_little_is_kept(spark, tmp_path, monkeypatch):
    """Long texts that share one passage: neither the texts nor the shuffles that made the tables stay on disk."""
    r = random.Random(5)
    word = lambda n: " ".join(f"{r.getrandbits(40):x}" for _ in range(n))
    passage = word(20)
    rows = [(i, f"{word(1000)} {passage} {word(1000)}") for i in range(200)]
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {files.getAllFiles().apply(i).getPath() for i in range(files.getAllFiles().length())}
    before = shuffled()
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    result = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    tables = sum(x.stat().st_size for x in tmp_path.rglob("*.parquet") if x.is_file())
    assert tables < sum(len(t) for _, t in rows) / 4
    for _ in range(50):  # files are deleted beside the driver; counts leave a few bytes
        left = sum(os.path.getsize(x) for x in shuffled() - before if "shuffle" in x and os.path.exists(x))
        if left < 5000:
            break
        time.sleep(0.1)
    assert left < 5000
    assert sorted((str(g.doc_id), g.n_words, g.n_removed, g.kept_sha256) for g in result.collect()) == brute(rows)


def test_sieves(spark, monkeypatch):
    """Beyond the bound of broadcasts, anchors are joined behind a sieve."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    rows = fixture(6)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substrings.dedup_substrings(df, hot=4).collect()
    assert sorted((str(g.doc_id), g.n_words, g.n_removed, g.kept_sha256) for g in got) == brute(rows)
