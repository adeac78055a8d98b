"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, `://` and cues such as `iban` or `account`.
From each anchor a deterministic parser walks to the boundaries and validates; every parser reads a stretch of text
at most once, so work is linear. Base kinds, leftmost and non-overlapping within a kind, failing ones dropped:

  email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
  ip     four numbers joined by dots, each at most 255
  card   digits with single spaces or hyphens between, 14 to 19 of them, passing Luhn's check
  phone  + and a digit, then digits, spaces, brackets, dots, hyphens, to a digit: 10 to 15 digits

Added kinds: url (http, https or ftp address) and account (what follows a cue: an IBAN, in groups or not, that passes its
check digits, or else a run of 6 or more letters, digits, hyphens and underlines, 4 or more of them digits, to its end).

Defined results: null texts are empty; one row per row; positions are code points, ends exclusive; a null id stays
null; an empty table gives an empty result. Columns beside id and text are left alone.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
CUES = ("account", "acct", "iban", "passport", "ssn", "token")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ADDRESS = re.compile(r"[^\s<>\"'`{}|\\^]+")
AFTER_CUE = re.compile(r"(?:[\x20:=#\"']|number|no\.|nr\.|is\b){1,12}(?=[A-Za-z0-9])", re.IGNORECASE)
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{5,}")
#: Country, check digits, then 11 to 30 characters, single spaces between.
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")


def iban_end(text: str, at: int) -> int:
    """End of the longest IBAN that begins here, of whole groups; 0 if there is none."""
    found = IBAN.match(text, at)
    while found:
        held = found[0].replace(" ", "").upper()
        if int("".join(str(int(c, 36)) for c in held[4:] + held[:4])) % 97 == 1:
            return found.end()
        cut = found[0].rfind(" ")
        found = IBAN.fullmatch(text, at, at + cut) if cut > 0 else None
    return 0


def account_end(text: str, at: int) -> int:
    """End of an account or other identifier that begins here, 0 if there is none."""
    if end := iban_end(text, at):
        return end
    found = IDENTIFIER.match(text, at)
    return found.end() if found and sum(c.isdigit() for c in found[0]) >= 4 else 0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    anchors = {"@": "@", "+": "+", "://": ":", **{str(d): "0" for d in range(10)}}
    for cue in CUES:
        anchors |= {cue: "a", cue.upper(): "a", cue.capitalize(): "a"}
    for key, kind in anchors.items():
        found.add_word(key, (kind, len(key)))
    found.make_automaton()
    return found


def scan(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every span, in order."""
    spans: list[tuple[int, int, int]] = []
    end = [0] * len(KINDS)
    for last, (kind, size) in anchors.iter(text):
        if kind == "0":
            if last >= end[1]:
                end[1] = _dotted(text, last, spans)
            if last >= end[2]:
                run = DIGITS.match(text, last)
                end[2] = run.end()
                if run.end() - last >= 14:
                    digits = run[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        spans.append((last, 2, run.end()))
        elif kind == "@":
            begin = last
            while begin > end[0] and text[begin - 1] in LOCAL:
                begin -= 1
            end[0] = max(end[0], last)
            if begin < last and (domain := DOMAIN.match(text, last + 1)):
                spans.append((begin, 0, domain.end()))
                end[0] = domain.end()
            elif begin < last:
                end[0] = last + 1
        elif kind == "+":
            if phone := PHONE.match(text, last):
                if 10 <= sum(c.isdigit() for c in phone[0]) <= 15:
                    spans.append((last, 3, phone.end()))
        elif kind == ":":
            begin = last - 2
            while begin > end[4] and last - begin < 16 and text[begin - 1] in SCHEME:
                begin -= 1
            if begin >= end[4] and text[begin : last - 2].lower() in ("http", "https", "ftp") and (address := ADDRESS.match(text, last + 1)):
                stop = last + 1 + len(address[0].rstrip(".,;:!?)]"))
                if stop > last + 1:
                    spans.append((begin, 4, stop))
                    end[4] = stop
        elif kind == "a":
            begin = last + 1 - size
            if begin >= end[5] and not (begin and text[begin - 1].isalnum()) and (found := AFTER_CUE.match(text, last + 1)):
                if stop := account_end(text, found.end()):
                    spans.append((found.end(), 5, stop))
                    end[5] = stop
    spans.sort()
    return spans


def _dotted(text: str, at: int, spans: list) -> int:
    run = DOTTED.match(text, at)
    if run[0].count(".") >= 3:
        parts = list(NUMBER.finditer(text, at, run.end()))
        for i in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                spans.append((parts[i].start(), 1, parts[i + 3].end()))
    return run.end()


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches):
    anchors = automaton()
    for batch in slices(batches):
        rows = [scan(t, anchors) for t in batch.column("text").to_pylist()]
        base = [[x for x in spans if x[1] < len(BASE)] for spans in rows]
        counts = [pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in range(len(BASE))]
        digest = pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base])
        yield pa.record_batch([batch.column("doc_id"), *counts, digest, pa.array([written(x) for x in rows])], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans (kind:start:end, ...) of every row."""
    shape = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
