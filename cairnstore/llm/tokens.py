"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links: when a word can't be matched further, the link of the state goes to
the state for what is left of it after the longest tokens have been taken off the front, and the count of tokens
taken off is stored with the link. So a word's greedy longest-match count is read in one pass, without building a
piece. All distinct words of a batch are read in step, one character each time, as arrays; the last few, longer than all
others, are read one by one. Words of a batch are told apart by 64-bit hashes.

Words are split at white space and begin with the vocabulary's word mark. A character that begins no piece by
itself counts as its UTF-8 bytes (byte fallback), and cuts the word.

Defined results: null and empty texts have no tokens; one row per row, in any order; columns beside id and text are
left alone. Words of any length are read; memory follows the batch.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, slices
from .words import words

MARK = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Most characters of distinct words read in step at once.
AT_ONCE = 1 << 18
#: Words left from which on each is read by itself.
FEW = 12


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """The ordinary pieces of a SentencePiece model, read where the driver runs."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Automaton:
    """States are trie nodes; edges are kept sorted by state and character for searches by arrays."""

    def __init__(self, pieces: list[str], mark: str = MARK) -> None:
        self.mark = mark
        child: list[dict[str, int]] = [{}]
        cost = [0]  # tokens that the string of a node counts as, 0 if it is no piece

        def put(piece: str, tokens: int) -> None:
            at = 0
            for c in piece:
                to = child[at].get(c)
                if to is None:
                    child[at][c] = to = len(child)
                    child.append({})
                    cost.append(0)
                at = to
            cost[at] = cost[at] or tokens

        for piece in pieces:
            if piece:
                put(piece, 1)
        for c in list(child[0]):  # so that any prefix of a piece can be taken apart
            put(c, len(c.encode()))
        for c in {c for node in child for c in node}:
            put(c, len(c.encode()))
        fail, popped = [0] * len(child), [0] * len(child)
        queue = deque((n, 0, c) for c, n in child[0].items())
        while queue:
            node, parent, c = queue.popleft()
            if cost[node]:
                fail[node], popped[node] = 0, cost[node]
            else:
                at, taken = fail[parent], popped[parent]
                while c not in child[at]:
                    taken += popped[at]
                    at = fail[at]
                fail[node], popped[node] = child[at][c], taken
            queue.extend((n, node, x) for x, n in child[node].items())
        edges = sorted((s << 21 | ord(c), n) for s, node in enumerate(child) for c, n in node.items())
        self.edge = np.array([e for e, _ in edges] + [1 << 62], np.int64)
        self.to = np.array([n for _, n in edges] + [0], np.int64)
        self.fail, self.popped = np.array(fail, np.int64), np.array(popped, np.int64)
        first = np.full(0x110000, -1, np.int32)
        for c, n in child[0].items():
            first[ord(c)] = n
        self.first = first
        code = np.arange(0x110000)
        self.edges: dict[int, int] | None = None
        self.bytes = (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int8)

    def counts(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each word of code points chars[start:end], the word mark put before it."""
        n = len(start)
        state = np.full(n, max(int(self.first[ord(self.mark)]), 0), np.int64)
        total = np.zeros(n, np.int64) if self.first[ord(self.mark)] >= 0 else np.full(n, len(self.mark.encode()))
        order = np.argsort(start - end, kind="stable")  # longest first: those still running are a head
        length = (end - start)[order]
        start, state, total = start[order], state[order], total[order]
        running = n
        for i in range(int(length[0]) if n else 0):
            running = int(np.searchsorted(-length, -i, "left"))
            if running <= FEW:
                for j in range(running):
                    state[j], total[j] = self._alone(chars[start[j] + i : start[j] + length[j]].tolist(), int(state[j]), int(total[j]))
                break
            c = chars[start[:running] + i].astype(np.int64)
            todo = np.arange(running)
            while len(todo):
                s, x = state[todo], c[todo]
                root = s == 0
                found = np.where(root, self.first[x], -1)
                inner = np.flatnonzero(~root)
                if len(inner):
                    key = s[inner] << 21 | x[inner]
                    at = np.searchsorted(self.edge, key)
                    found[inner] = np.where(self.edge[at] == key, self.to[at], -1)
                ok = found >= 0
                state[todo[ok]] = found[ok]
                odd = todo[~ok & root]
                total[odd] += self.bytes[c[odd]]
                todo = todo[~ok & ~root]
                total[todo] += self.popped[state[todo]]
                state[todo] = self.fail[state[todo]]
        while (left := np.flatnonzero(state)).size:
            total[left] += self.popped[state[left]]
            state[left] = self.fail[state[left]]
        out = np.empty(n, np.int64)
        out[order] = total
        return out

    def _alone(self, chars: list[int], s: int, total: int) -> tuple[int, int]:
        """State and tokens after more characters of one word."""
        if self.edges is None:
            self.edges = dict(zip(self.edge[:-1].tolist(), self.to[:-1].tolist(), strict=True))
            self.links = self.fail.tolist(), self.popped.tolist()
        edges, (fail, popped) = self.edges, self.links
        for c in chars:
            to = edges.get(s << 21 | c)
            while to is None and s:
                total += popped[s]
                s = fail[s]
                to = edges.get(s << 21 | c)
            if to is None:
                total += 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            else:
                s = to
        return s, total


def _count(automaton):
    def run(batches):
        a = automaton.value
        for batch in slices(batches):
            w = words(batch.column("text"))
            _, head, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
            per_word = np.zeros(len(head), np.int64)
            size = (w.end - w.start)[head]
            ends = np.cumsum(size)
            lo = 0
            while lo < len(head):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + AT_ONCE, "right")))
                pick = head[lo:hi]
                raw = b"".join(w.data[x:y].tobytes() for x, y in zip(w.start[pick].tolist(), w.end[pick].tolist(), strict=True))
                data = np.frombuffer(raw, np.uint8)
                begins = (data & 0xC0) != 0x80
                nth = np.cumsum(begins)
                chars = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
                upto = np.concatenate([[0], nth])[np.cumsum(size[lo:hi])]
                start = np.concatenate([[0], upto[:-1]])
                per_word[lo:hi] = a.counts(chars, start, upto)
                lo = hi
            run_up = np.concatenate([[0], np.cumsum(per_word[which])])
            n = run_up[w.first[1:]] - run_up[w.first[:-1]]
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(w.first).astype(np.int64)), pa.array(n)], ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every row; the vocabulary, a list of fixed size, is broadcast as arrays."""
    automaton = Shared(docs.sparkSession, Automaton(vocabulary() if pieces is None else pieces))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_count(automaton), "doc_id long, n_words long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
