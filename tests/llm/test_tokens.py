"""Token counts against pieces taken one by one."""

import random
import re
import time
from unittest.mock import patch

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from cairnstore.llm import tokens

WORD = re.compile("[^\x20\x09-\x0d]+")


def greedy(word, pieces, known):
    """known: the characters of the vocabulary's trie."""
    text, n = "▁" + word, 0
    while text:
        for k in range(len(text), 0, -1):
            if text[:k] in pieces:
                n, text = n + 1, text[k:]
                break
        else:
            n, text = n + len(text[0].encode()), text[1:]
    return n


def count(automaton, ws):
    chars = np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32)
    end = np.cumsum([len(w) for w in ws])
    return automaton.counts(chars, end - [len(w) for w in ws], end).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc▁é", min_size=1, max_size=5), max_size=12), st.lists(st.text("abcdé𝄞", min_size=1, max_size=14), min_size=1, max_size=8))
def test_greedy(pieces, ws):
    automaton = tokens.Automaton(pieces)
    for few in (0, 3, 12):
        with patch.object(tokens, "FEW", few):
            assert count(automaton, ws) == [greedy(w, set(pieces), None) for w in ws]


def test_long_words():
    """A word without end is read by itself, to the same count and at a bounded price a character."""
    r = random.Random(2)
    automaton, long = tokens.Automaton(tokens.vocabulary()), ["".join(r.choice("aeinorstdéü🙂") for _ in range(20_000)), "a" * 20_001]
    with patch.object(tokens, "FEW", 0):
        want = count(automaton, long)
    assert count(automaton, long) == want
    start = time.time()
    count(automaton, ["abcdefghij" * 100_000])
    assert time.time() - start < 20


def test_vocabulary():
    pieces = tokens.vocabulary()
    r = random.Random(1)
    ws = ["the", "worthless", "thanatan", "Überraschung", "日本語", "x" * 50] + ["".join(r.choice("aeinorstdéü🙂") for _ in range(r.randint(1, 20))) for _ in range(300)]
    assert len(pieces) > 30_000 and count(tokens.Automaton(pieces), ws) == [greedy(w, set(pieces), None) for w in ws]


def test_counts(spark):
    rows = [(1, "the cat  sat\x0bon\n it"), (2, None), (3, ""), (None, "é"), (1, "the cat  sat\x0bon\n it"), (5, "a" * 30_000 + " " + "the " * 30_000)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, n_tokens int, n_words string")
    pieces = tokens.vocabulary()
    want = sorted((str(d), len(WORD.findall(t or "")), sum(greedy(w, set(pieces), None) for w in WORD.findall(t or "") if len(w) < 1000)) for d, t in rows[:5])
    got = sorted((str(g.doc_id), g.n_words, g.n_tokens) for g in tokens.token_counts(df).collect())
    assert [g for g in got if g[0] != "5"] == want
    assert next(g for g in got if g[0] == "5")[1] == 30_001
    assert tokens.token_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
