"""The pipeline's stages: each one's rows against its operator's brute force on its own input."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(1)
    word = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    item = word(30)
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append([i, word(60) + (" vile rotten" if bad else ""), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(bad)))
    rows += [[400, rows[1][1].upper(), "en", "s1", 0], [401, rows[2][1].replace(rows[2][1].split()[9], "other"), "en", None, 0], [402, word(20) + " " + item + " " + word(9), "en", "s2", 0], [403, rows[5][1] + " Vile, rotten!", "de", "s0", 0]]
    rows += [[500, None, None, None, None], [501, "", "en", "s0", 0], rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
        assert name == "mix" or docs.columns == before
        kept.append(sorted(x.doc_id for x in docs.collect()))
    toxic, exact, near, clean, mix = kept
    all_ids = sorted(x[0] for x in rows)
    assert toxic == [i for i in all_ids if not (i < 300 and i % 6 == 0) and i != 403]
    assert exact == [i for i in sorted(set(toxic)) if i not in (1, 500)]
    assert near == [i for i in exact if i != 401]
    assert clean == [i for i in near if i != 402]
    assert set(mix) <= set(clean) and len(mix) > 0.6 * len(clean)
    assert sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()) == mix


def test_empty_and_clashing(spark, tmp_path):
    shape = "doc_id long, text string, lang string, source string, n_chars long, gone long, kept boolean, score double, copies int"
    for name, rows in (("none", []), ("some", [(1, "a b c", None, None, None, 1, True, 0.5, 3), (None, None, None, "s", None, None, None, None, None), (2, "A b c", "en", "s", 5, 2, False, 0.1, 1)])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, shape).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got = sorted(str(x.doc_id) for x in corpus_pipeline.run(spark, d).collect())
        assert got == ([] if name == "none" else ["2"])


def test_many_keys(spark, monkeypatch):
    """Rows dropped or kept by more keys than are broadcast: the same, whatever ids and texts repeat or are null."""
    rows = [(i if i % 9 else None, f"text {i % 70}" if i % 11 else None, "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid string")
    keys = docs.where("text LIKE '%3%' OR doc_id IS NULL").select(corpus_pipeline.F.col("doc_id").alias("d"), corpus_pipeline._rid(docs).alias("rid")).distinct()
    keys = corpus_pipeline.materialise(keys, "keys")
    chosen = {(i if i % 9 else None, f"text {i % 70}" if i % 11 else None) for i in range(400) if not i % 9 or (i % 11 and "3" in f"{i % 70}")}
    order = lambda rows: sorted(map(tuple, rows), key=str)
    for limit in (10, 10_000):
        monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", limit)
        assert order(corpus_pipeline._joined(docs, keys, "left_semi").collect()) == order(r for r in rows if r[:2] in chosen)
        assert order(corpus_pipeline._joined(docs, keys, "left_anti").collect()) == order(r for r in rows if r[:2] not in chosen)


def test_shared_ids(spark, tmp_path):
    """Rows that share an id, or have none, are judged one by one."""
    r = random.Random(3)
    word = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    item, near = word(30), word(60)
    changed = " ".join(["other", *near.split()[1:]])
    fixed = {i: [word(60) for _ in range(6)] for i in (700, None)}
    rows, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        rows.append((i, word(60) + (" vile rotten" if bad else "")))
        labels.append((i, 1, int(bad)))
    rows += [(600, near), (650, fixed[700][0].upper()), (650, fixed[700][1])]
    for i, t in fixed.items():
        rows += [(i, x) for x in t] + [(i, t[2]), (i, word(40) + " vile rotten"), (i, word(20) + " " + item + " " + word(9))]
    rows += [(700, changed), (None, changed + " more")]
    shape = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*x, "en", "s", 0) for x in rows], shape).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
    got = [(x.doc_id, x.text) for x in docs.collect() if x.doc_id is None or x.doc_id >= 600]
    want = [(600, near), *((i, x) for i, t in fixed.items() for x in t)]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(want)
