"""Toxicity: exact neighbours against all cosines, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np

from cairnstore.llm import toxicity

DOCS, LABELS = "doc_id long, text string, score string, toxic string", "doc_id long, toxic int, text string"


def corpus(n=900, seed=1):
    r = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(400)], ["rotten", "vile", "foul", "nasty"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = int(r.random() < 0.15)
        for _ in range(toxic * r.randint(1, 3)):
            w.insert(r.randint(0, len(w)), r.choice(bad).title())
        rows.append((i, ", ".join(w)))
        if r.random() < 0.7:
            labels.append((i, toxic))
    return rows, labels, {i: int(any(b.title() in t for b in bad)) for i, t in rows}


def run(spark, rows, labels, **more):
    docs = spark.createDataFrame([(*x, "a", "b") for x in rows], DOCS).repartition(3)
    return toxicity.toxicity(docs, spark.createDataFrame([(*x, "t") for x in labels], LABELS), **more).collect()


def test_held_out(spark):
    rows, labels, truth = corpus()
    got = run(spark, rows, labels)
    assert sorted(g.doc_id for g in got) == list(range(900))
    for g in got:
        assert g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1
        assert g.predicted == int(g.score >= 0.7)
    out = [g for g in got if g.held_out]
    assert sum(g.predicted == truth[g.doc_id] for g in out) >= 0.98 * len(out)
    assert all(e.cosine > 0 for g in got for e in g.evidence) and any(g.evidence for g in got)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels, _ = corpus(400)
    turned = [(d, 1 - y if zlib.crc32(str(d).encode()) % 3 == 1 else y) for d, y in labels]
    assert sorted(map(str, run(spark, rows, labels))) == sorted(map(str, run(spark, rows, turned)))


def test_edges(spark):
    rows, labels, _ = corpus(400)
    odd = [(None, "rotten"), (5000, None), (5001, ""), (3, rows[3][1]), (5002, "vile " * 30_000), (5003, "clean")]
    got = run(spark, rows + odd, [*labels, (None, 1), (7, None), (999_999, 1), (8, 0), (8, 1)])
    assert len(got) == len(rows + odd)
    by = {g.doc_id: g for g in got}
    assert by[None].predicted == 1 and by[5002].predicted == 1 and not by[None].held_out
    assert by[5000].score == by[5001].score < 0.7
    assert run(spark, [], labels) == []
    assert {g.score for g in run(spark, rows, [])} == {0.0}
    assert all(0.9 < g.score < 1 for g in run(spark, rows, [(d, 1) for d, _ in rows]))


def test_nearest_is_exact():
    """The k nearest of all examples by their full vectors, leave-one-out ones too."""
    r = np.random.default_rng(2)
    known = np.sort(r.integers(0, 2**63, 400, dtype=np.uint64))
    popular = 1 / np.arange(1, 401)
    bag = lambda: np.sort(r.choice(400, r.integers(1, 40), replace=False, p=popular / popular.sum()))
    examples = [(i, int(r.random() < 0.3), at := bag() if i % 7 else np.zeros(0, np.int64), r.integers(1, 4, len(at))) for i in range(700)]
    index = toxicity.Index(known, r.uniform(0.01, 8, 400), examples)
    assert 5 < len(index.matrix) < 300 and index.blocks == 10
    full = {d: np.zeros(400) for d, _, _, _ in examples}
    for d, _, at, tf in examples:
        full[d][at] = (1 + np.log(tf)) * index.weight[at]
    dense = np.stack([full[d] / np.linalg.norm(full[d]) for d in index.ids.tolist()])

    def check(vectors, who, cos, skip=False):
        for i, v in enumerate(vectors):
            want = dense @ v
            if skip:
                want[i] = 0
            best = np.sort(want)[::-1][: toxicity.NEIGHBOURS]
            assert np.abs(best - cos[i]).max() < 2e-6 and np.abs(want[who[i]] - cos[i])[cos[i] > 0].max() < 2e-6

    bags = [(bag(), None) for _ in range(600)]
    bags = [(at, r.integers(1, 4, len(at))) for at, _ in bags]
    owner = np.repeat(np.arange(600), [len(at) for at, _ in bags])
    at, tf = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags])
    vectors = np.zeros((600, 400))
    vectors[owner, at] = index.vectors(owner, at, tf, 600)
    check(vectors, *index.nearest(owner, at, tf, 600))
    by = {d: (at, tf) for d, _, at, tf in examples}
    own = [by[d] for d in index.ids.tolist()]
    owner = np.repeat(np.arange(len(own)), [len(x) for x, _ in own])
    check(dense, *index.nearest(owner, np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own]), len(own), alone=True), skip=True)


def test_no_word_is_left_out(spark):
    """A near copy of a labelled text is nearest to it by words that tell nothing; a bound on words drops whole examples."""
    rows, labels, _ = corpus(300)
    r = random.Random(4)
    odd = " ".join(f"rare{r.randrange(10**6)}" for _ in range(30))
    free = next(i for i in range(10_000, 10_100) if zlib.crc32(str(i).encode()) % 3 != 1)
    got = {g.doc_id: g for g in run(spark, [*rows, (free, odd), (20_000, odd + " and more")], [*labels, (free, 0)])}
    assert got[20_000].evidence[0].doc_id == free and got[20_000].evidence[0].cosine > 0.9
    few = run(spark, rows, labels, example_words=500)
    assert len({e.doc_id for g in few for e in g.evidence}) < 60
