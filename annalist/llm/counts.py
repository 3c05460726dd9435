"""Token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node has a failure link and the number of pieces that are
settled when the automaton falls back along it, so the greedy longest-match pieces of a word are
counted in one pass over its bytes, without building a piece and without looking back.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8, widened
from .packing import byte_of

#: Words whose counts a worker remembers, and the bytes of the longest such word.
REMEMBERED, LONG = 500_000, 256


class LongestMatch:
    """Counts greedy longest-match pieces over a vocabulary that holds every single byte."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: dict[int, int] = {}
        ends = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                to = self.next.get(node << 8 | c)
                if to is None:
                    to = self.next[node << 8 | c] = len(ends)
                    ends.append(False)
                node = to
            ends[node] = bool(node)
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for edge, to in self.next.items():
            below[edge >> 8].append((edge & 255, to))
        if sum(ends[to] for _, to in below[0]) < 256:
            raise ValueError("a byte is not in the vocabulary")
        self.fall, self.settled = [-1] * len(ends), [0] * len(ends)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, to in below[node]:
                queue.append(to)
                if ends[to]:  # the whole of it is a piece
                    self.fall[to], self.settled[to] = 0, 1
                    continue
                at, n = self.fall[node], self.settled[node]
                while at >= 0 and (at << 8 | c) not in self.next:
                    n += self.settled[at]
                    at = self.fall[at]
                if at >= 0:
                    self.fall[to], self.settled[to] = self.next[at << 8 | c], n
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Pieces of ``word``, each the longest of the vocabulary that fits where the last one ended."""
        step, fall, settled = self.next.get, self.fall, self.settled
        node = n = 0
        for c in word:
            to = step(node << 8 | c)
            while to is None:
                n += settled[node]
                node = fall[node]
                to = step(node << 8 | c)
            node = to
        while node:
            n += settled[node]
            node = fall[node]
        return n

    def total(self, words: list[bytes]) -> int:
        """Pieces of all ``words``, each with a blank before it."""
        known = self.known
        try:
            return sum([known[x] for x in words])
        except KeyError:
            n = 0
            for x in words:
                if (got := known.get(x)) is None:
                    got = self.count(b" " + x)
                    if len(x) <= LONG:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[x] = got
                n += got
            return n


_MADE: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    """The automaton of a byte-level vocabulary file; a worker process makes it once."""
    if path not in _MADE:
        spec = json.load(open(path, encoding="utf-8"))
        to_byte, special = byte_of(), {x["content"] for x in spec["added_tokens"]}
        _MADE[path] = LongestMatch(bytes(to_byte[c] for c in x) for x in spec["model"]["vocab"] if x not in special)
    return _MADE[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``n_tokens``.

    Words are ``[^\\x20\\x09-\\x0D]+``; a word's pieces are the greedy longest matches, from the left,
    of the word with one blank before it, over the byte strings of the vocabulary. Null and empty
    texts have no words and no tokens; repeated rows are counted each; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = automaton(path)
        for batch in batches:
            words, tokens = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column(1)):
                parts = text.as_py().split()
                words[k], tokens[k] = len(parts), pieces.total(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(tokens)], ["id", "n_words", "n_tokens"])

    rows = widened(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
