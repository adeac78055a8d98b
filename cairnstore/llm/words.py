"""Words of Arrow text columns as numpy arrays: boundaries, 64-bit hashes, shingles.

Works on the UTF-8 buffer: the six separators are ASCII, so no character is ever decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For folded words: everything in ASCII but letters and digits separates, capital letters become small ones.
_OTHER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_M1, _M2, _P = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9FB21C651E98DF25)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= _M2
    x ^= x >> np.uint64(29)
    x *= _M1
    x ^= x >> np.uint64(32)
    return x


@dataclass
class Words:
    data: np.ndarray  #: UTF-8 bytes of all texts, padded by eight
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after each word
    first: np.ndarray  #: first word of each text; one more entry than texts

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes a step."""
        eight = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        size = self.end - self.start
        out = mix(size.astype(np.uint64) * _P)
        todo, lane = np.arange(len(size)), 0
        while len(todo):
            left = np.minimum(size[todo] - lane, 8)
            out[todo] = mix((out[todo] ^ (eight[self.start[todo] + lane] & _MASK[left])) * _P)
            lane += 8
            todo = todo[size[todo] > lane]
        return out

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def span(self, a: int, b: int) -> bytes:
        """Words a to b, b exclusive, joined by one space."""
        s, e = self.start[a:b], self.end[a:b]
        if b - a > 1 and not (s[1:] - e[:-1] == 1).all() or (self.data[e[:-1]] != 0x20).any():
            return b" ".join(self.data[x:y].tobytes() for x, y in zip(s.tolist(), e.tolist(), strict=True))
        return self.data[s[0] : e[-1]].tobytes() if b > a else b""


def words(texts: pa.Array, fold: bool = False) -> Words:
    """Splits a large_string array without nulls; fold: into lower-case words without ASCII punctuation."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    data = np.concatenate([data, np.full(8, 0x20, np.uint8)])
    if fold:
        data = _FOLD[data]
    space = (_OTHER if fold else _SPACE)[data]
    n = bounds[-1]
    begins = np.empty(n, bool)
    ends = np.empty(n, bool)
    if n:
        begins[0] = True
        begins[1:] = space[: n - 1]
        edges = bounds[1:-1]
        begins[edges[edges < n]] = True
        begins &= ~space[:n]
        ends[:] = space[1 : n + 1]
        ends[edges[edges > 0] - 1] = True
        ends &= ~space[:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, bounds))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; those that cross texts are for the caller to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _P + h[i : i + n]
    return mix(out)
