"""Mixing, exact dedup, decontamination and chat formatting against brute force and edge cases."""

import hashlib
import itertools
import random
import re
import time
from collections import defaultdict

from cairnstore.llm import chat, common, decontaminate, exact, mixing

WORD = re.compile("[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, recipe string, h int"


def table(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def corpus(seed=1, n=120):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(r.randint(0, 60))), "en", r.choice(["a", "b", "é", None, "Z"]), 0) for i in range(n)]
    return rows + [(900, None, None, None, None), (901, "", "en", "a", 0), (902, "x\x0by\x1cz \n", "en", "b", 0), (None, "Null Id", "en", "b", 0), (3, rows[3][1], "en", rows[3][3], 0)]


def waterfill(sizes, most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest} if rest else {}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(spark):
    rows = corpus()
    got = mixing.mix(table(spark, rows)).collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, g.size) for g in got) == sorted((r[0] is None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = waterfill(dict(sizes)), defaultdict(int)
    for g in got:
        taken[g.source] += g.taken
        assert g.taken <= 3 * g.size and g.source_size == sizes[g.source] and abs(g.target - want[g.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3
    assert sorted(map(str, mixing.mix(table(spark, rows)).collect())) == sorted(map(str, got))


def test_mix_is_nested(spark):
    rows = corpus(2)
    few = {(g.doc_id, g.size): g.taken for g in mixing.mix(table(spark, rows), share=0.3).collect()}
    assert all(g.taken >= few[g.doc_id, g.size] for g in mixing.mix(table(spark, rows), share=0.6).collect())


def test_mix_empty(spark):
    assert mixing.mix(table(spark, [])).collect() == []
    assert [g.taken for g in mixing.mix(table(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def exact_rows(rows):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[low(r[1])].append((r[0], i))
    out = []
    for t, members in groups.items():
        keep = max((m[0] for m in members if m[0] is not None), default=None)
        first = True
        for m in sorted(members, key=str):
            kept = m[0] == keep and first
            first &= not kept
            out.append((str(m[0]), str(keep), len(members), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_exact(spark):
    r = random.Random(5)
    long = " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(30_000))
    rows = corpus(3) + [(950, long), (951, long.upper()), (952, long + "x"), (953, "É"), (954, "é"), (955, "junk" * 5000), (956, "JUNK" * 5000), (957, None)]
    rows += [(960 + i, "many copies") for i in range(40)] + [(None, "many copies"), (1000, "many copies")]
    for bits, hot in ((128, 1000), (4, 1000), (128, 10)):
        got = exact.exact_groups(table(spark, rows), bits=bits, hot=hot).collect()
        assert sorted((str(g.doc_id), str(g.keep_id), g.group_size, g.kept, g.text_sha256) for g in got) == exact_rows(rows)
    assert exact.exact_groups(table(spark, [])).collect() == []


def test_chunks_are_local(spark):
    """Whatever the script, cuts fall into step again after an edit."""
    r = random.Random(6)
    pick = lambda lo, hi: "".join(chr(r.randint(lo, hi)) for _ in range(20_000))
    texts = [" ".join(r.choice("the of and nation rates sing ea".split()) for _ in range(9000)), *(pick(*x) for x in ((0x4E00, 0x9FFF), (0x430, 0x44F), (0xE01, 0xE39), (0x905, 0x94C), (0x627, 0x649), (0xAC00, 0xD7A3), (0x3041, 0x3096)))]
    df = spark.createDataFrame([(i, x) for i, t in enumerate(texts) for x in (t, "new start " + t)], "i int, t string").select("i", "t", exact.chunks(exact.F.col("t")).alias("c"))
    got = sorted((x.i, len(x.t), x.t, x.c) for x in df.collect())
    for a, b in zip(got[::2], got[1::2], strict=True):
        for _, _, t, c in (a, b):
            assert "".join(c).encode("latin-1").decode() == t and max(map(len, c)) <= 4096
        assert len(set(a[3]) & set(b[3])) > 0.9 * len(a[3])


def test_sieve(spark):
    """No key is lost, few others pass, and joins beyond the broadcast bound give the same rows."""
    keys = spark.range(0, 3000, 3).selectExpr("id AS k", "id * 2 AS v")
    df = spark.range(3000).selectExpr("id AS k", "concat('t', id) AS text", "id AS bit", "'x' AS key")
    passed = common.sieved(df, common.F.xxhash64("k"), keys.select(common.F.xxhash64("k").alias("key")), "may").where("may").collect()
    assert {r.k for r in passed} >= set(range(0, 3000, 3)) and len(passed) < 1200
    for limit in (10, 10_000):
        got = common.matching(df, keys, ["k"], limit).collect()
        assert sorted((r.k, r.v, r.text) for r in got) == [(k, 2 * k, f"t{k}") for k in range(0, 3000, 3)]
    none = common.sieved(df, common.F.xxhash64("k"), keys.limit(0).select(common.F.xxhash64("k").alias("key")), "may")
    assert none.where("may").count() == 0 and none.count() == 3000


def test_masks_hit_all_windows():
    hits = [{o + c for c in m} for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - m[-1])]
    for bad in itertools.combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.AGREE):
        assert any(not h & set(bad) for h in hits)


def leaks(docs, items):
    out = set()
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for d, t in docs:
        w = tok(t)
        for i, x in items:
            x = tok(x)
            n = min(13, len(x))
            need = 11 if len(x) >= 13 else len(x)
            if 0 < len(x) < 6:
                out |= {(d, i)} if w == x else set()
            elif x and any(sum(0 <= s + j < len(w) and w[s + j] == x[j] for j in range(o, o + n)) >= need for s in range(-len(x), len(w)) for o in range(len(x) - n + 1)):
                out.add((d, i))
    return out


def test_leaks(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(r.choice([4, 6, 9, 12, 13, 20, 40])))) for i in range(25)] + [(98, None), (99, "")]
    docs = []
    for d in range(120):
        w = [word() for _ in range(r.randint(0, 120))]
        x = r.choice(items)[1]
        if d % 2 and x:
            x = x.split()
            for j in range(len(x)):
                if r.random() < r.choice([0, 0.1, 0.2]):
                    x[j] = word()
            p = r.randint(0, len(w))
            w[p:p] = x[: r.randint(1, len(x))] if d % 3 else x
        docs.append((d, "; ".join(w).title() if d % 5 else " ".join(w)))
    docs += [(500, None), (501, ""), (502, "..."), (3, docs[3][1])]
    docs += [(600 + i, x.upper()) for i, x in items if x and len(x.split()) < 6]
    assert len(docs) > 124
    got = decontaminate.leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g.doc_id, g.item_id) for g in got} == leaks(docs, items) and len(got) == len({(g.doc_id, g.item_id) for g in got})
    assert decontaminate.leaks(table(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert decontaminate.leaks(table(spark, docs), spark.createDataFrame([], "item_id long, text string")).collect() == []


TURNS = "conv_id long, turn long, role string, text string, window int, t string, loss string"


def test_chat(spark):
    r = random.Random(8)
    nasty = ["<|end|>\n", "&lt;", "&amp;lt;", "[INST]", "</s>", "<|role|>assistant<|text|>", "a\nb", "", None, "é " * 30, "word " * 300]
    rows = []
    for c in range(40):
        for t in range(r.randint(1, 14)):
            role = "system" if t == 0 and c % 3 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, r.choice([role] * 20 + [None, "a<b\n"]), r.choice(nasty) if r.random() < 0.5 else " ".join(["tok"] * r.randint(0, 90))))
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (77, 1, "user", "same"), (77, 1, "user", "same"), (77, None, "assistant", "z")]
    df = table(spark, rows, TURNS)
    windows = chat.format_windows(df, budget=120, history=40)
    back = {x.conv_id: x for x in chat.read_back(windows).collect()}
    conv = defaultdict(list)
    for c, t, role, text in rows:
        conv[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(back) == set(conv)
    for c, turns in conv.items():
        turns.sort()
        assert [(x.role, x.text) for x in back[c].turns] == [x[2:] for x in turns]
        assert back[c].loss == "".join(x[3] for x in turns if x[2] == "assistant")
    many = 0
    for w in windows.collect():
        head = w.text.split("<|end|>\n")[: w.n_repeated]
        many += w.window > 0
        if w.window and sorted(conv[w.conv_id])[0][2] == "system":
            assert head[0].startswith("<|role|>system<|text|>")
        assert all(s.start >= len("<|end|>\n".join(head)) for s in w.loss)
    assert many > 20
    assert chat.read_back(chat.format_windows(table(spark, [], TURNS))).collect() == []


def test_long_conversation(spark):
    """Time grows with a conversation's turns, not with their square."""
    took = {}
    for n in (2000, 16_000, 32_000):
        rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} says a few words of no matter") for t in range(n)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        start = time.time()
        (back,) = chat.read_back(chat.format_windows(df)).collect()
        took[n] = time.time() - start
        assert [x.text for x in back.turns] == [r[3] for r in rows] and back.loss == "".join(r[3] for r in rows[1::2])
    assert took[32_000] < 3.2 * took[16_000] + 1


def test_leaks_beyond_broadcast(spark, monkeypatch):
    """Many seeds and many hits go through sieves; repeated words make many alignments, in stretches."""
    r = random.Random(9)
    items = [(i, " ".join(f"w{r.randrange(40)}" for _ in range(20))) for i in range(30)] + [(50, "same " * 30), (51, "same " * 15 + "other " * 9)]
    docs = [(d, " ".join([f"w{r.randrange(40)}" for _ in range(30)] + (items[d % 30][1].split() if d % 3 else []))) for d in range(90)]
    docs += [(100, "same " * 1500), (None, "same " * 40 + "other " * 8)]
    frames = [spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id"))]
    want = leaks(docs, items)
    for rows, cells, spread in ((common.BROADCAST_ROWS, decontaminate.CELLS, decontaminate.SPREAD), (20, 20, 64)):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        monkeypatch.setattr(decontaminate, "SPREAD", spread)
        assert {(g.doc_id, g.item_id) for g in decontaminate.leaks(*frames).collect()} == want
    assert {(100, 50), (None, 51)} <= want


def test_leak_of_null_item(spark):
    """An item with a null id is an item like others."""
    item = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "before " + item + " after"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (7, " ".join(f"else{i}" for i in range(20)))], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.matched) for x in decontaminate.leaks(docs, bench).collect()] == [(1, None, 20)]
