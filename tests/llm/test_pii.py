"""Personal data against the base patterns run over whole texts."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from cairnstore.llm import pii

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, k == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def check(text):
    spans = pii.scan(text, pii.automaton())
    assert [x for x in spans if x[1] < 4] == base(text)
    return pii.written(spans)


@settings(max_examples=400, deadline=None)
@given(st.text("a1.@-+ (é5%", max_size=40))
def test_any(text):
    check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "256.1.1.1", "..", ".", "@", "a@b.c", "x.y+z@mail-1.example.com", "+1 (974) 555-3436", "+", " ", "-", "é", "00001.02.3.255", "1.2.3.4.5.6.7.8", "@@", "7"]), max_size=12))
def test_parts(parts):
    check("".join(parts))


def test_added():
    text = "see https://example.org/a?b=1. or ftp://x account no. DE44-5001-0517 token = \"9b0b3c6a43eb\" Token: shortx a@b.co"
    assert check(text) == "url:4:29,url:34:41,account:54:68,account:78:90,email:106:112"


def test_accounts():
    """Identifiers to their end, IBANs in groups by their check digits."""
    for body, want in (
        ("DE89 3704 0044 0532 0130 00 is mine", "DE89 3704 0044 0532 0130 00"),
        ("DE89370400440532013000.", "DE89370400440532013000"),
        ("GB82 WEST 1234 5698 7654 32 and more", "GB82 WEST 1234 5698 7654 32"),
        ("DE89 3704 0044 0532 0130 01", None),
        ("ab_12_34-" * 20 + "!", "ab_12_34-" * 20),
        ("x" * 200 + "1234", "x" * 200 + "1234"),
        ("nothing here", None),
    ):
        text = "IBAN: " + body
        spans = [text[s:e] for s, k, e in pii.scan(text, pii.automaton()) if k == 5]
        assert spans == ([want] if want else []), body


def test_long():
    for text in ("1" * 50_000, "a" * 50_000 + "@", "1." * 30_000, "a@" * 30_000, "+1" * 30_000, "é@b.c " * 5000, "iban " * 20_000, "token=" + "a1-" * 30_000, "iban: DE11 " * 8000):
        check(text)


def test_table(spark):
    rows = [(1, "mail a@b.co, 10.0.0.1"), (2, None), (3, ""), (None, "x"), (1, "mail a@b.co, 10.0.0.1")]
    df = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, spans string")
    got = sorted((str(g.doc_id), g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256, g.spans) for g in pii.find_personal(df).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    full, none = "email:5:11,ip:13:21", sha("")
    assert got == [("1", 1, 1, 0, 0, sha(full), full)] * 2 + [("2", 0, 0, 0, 0, none, ""), ("3", 0, 0, 0, 0, none, ""), ("None", 0, 0, 0, 0, none, "")]
    assert pii.find_personal(spark.createDataFrame([], "doc_id long, text string")).collect() == []
