"""License scans against containment in every stretch of every text."""

import random
import re

import numpy as np
import pyarrow as pa

from cairnstore.llm import licenses


def fold(t):
    return re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def holds(text, template):
    """Whether some stretch of 1.25 template lengths holds 0.8 of the template's shingles."""
    w, t = fold(text), fold(template)
    want = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    have = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    reach = int(np.ceil(1.25 * len(t))) - 4
    return any(len(want & set(have[i : i + reach])) >= 0.8 * len(want) - 1e-9 for i in range(len(have)) if have[i] in want)


def fixture():
    r = random.Random(3)
    noise = lambda n: " ".join(r.choice("the and of thon ernd software license under is a über".split()) for _ in range(n))
    rows, names = [], sorted(licenses.TEMPLATES)
    for i in range(200):
        w = licenses.TEMPLATES[r.choice(names)].split()
        for _ in range(r.choice([0, 0, 1, 3])):
            w[r.randrange(len(w))] = "other"
        body = " ".join(w)
        rows.append((i, r.choice([noise(r.randint(0, 90)) + ".\n" + body + " " + noise(r.randint(0, 40)), noise(r.randint(0, 60)), body.upper(), body + " " + body])))
    return rows + [(900, None), (901, ""), (902, "Released under"), (1, rows[1][1]), (903, noise(30_000) + licenses.TEMPLATES["mit"])]


def test_scan(spark):
    rows = fixture()
    df = spark.createDataFrame([(*x, "s") for x in rows], "doc_id long, text string, template string").repartition(3)
    got = licenses.scan_licenses(df).collect()
    want = {(d, n) for d, t in rows for n, x in licenses.TEMPLATES.items() if holds(t, x)}
    assert {(g.doc_id, g.template) for g in got} == want
    assert len(want) > 100
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_places():
    text = "aa bb. " + licenses.TEMPLATES["mit-line"] + " and " + licenses.TEMPLATES["mit-line"]
    w = licenses.words(pa.array([text], pa.large_string()), fold=True)
    g = licenses.shingles(w.hashes(), 5)
    t = licenses.Templates({"m": licenses.TEMPLATES["mit-line"]})
    assert licenses.matches(g, t.sets[0], t.words[0], 0.8) == [(2, 7, 1.0), (8, 13, 1.0)]


def test_whole_templates_are_retrieved():
    """A template of any number of shingles, wherever in a batch it begins."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    for n in (5, 7, 8, 9, 19, 20, 23, 26, 27, 40):
        for _ in range(8):
            body = " ".join(word() for _ in range(n))
            t = licenses.Templates({"t": body})
            for before in range(9):
                text = " ".join([*(word() for _ in range(before)), body, *(word() for _ in range(5))])
                g = licenses.shingles(licenses.words(pa.array([text], pa.large_string()), fold=True).hashes(), 5)
                assert t.retrieve(g)
