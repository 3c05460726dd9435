"""BPE encoding by speculation and verification, and decoding.

A word's tokens are proposed by greedy longest match. A sequence of tokens is what merging would
give exactly if every adjacent pair is: the two tokens, encoded together, stay the two tokens. All
adjacent pairs of a batch's new words are tested at once, in numpy, by taking the tokens apart along
their seam, last merge first, and looking for a merge across the seam that would have come earlier.
Only words with a failing pair are merged exactly. Texts are put together from remembered words.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import widened
from .packing import _BLANK, byte_of

#: Stretches without white space whose tokens a worker remembers (in two generations), words as the
#: pattern splits them, and the longest of either.
REMEMBERED, WORDS, LONG = 500_000, 700_000, 64
_NONBLANK = re.compile(f"[^{_BLANK}]+")
#: Proposed tokens that are verified at once.
_AT_ONCE = 1 << 20


class WordBpe:
    """A lower-casing BPE file with word ends: NFC, one blank, lower case, split, bytes, merges."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(pattern.replace("\\s", _BLANK)).findall
        self.char_of = {b: c for c, b in byte_of().items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_at = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.names = {i: x for x, i in self.vocab.items()} | {i: x for x, i in self.special.items()}
        self.longest = max(len(x.removesuffix(self.end)) for x in self.vocab)

        n = max(self.names) + 1
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        left, right, made = np.arange(n), np.arange(n), np.full(n, -1)
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            to = self.vocab[a + b]
            self.rank.setdefault((self.vocab[a], self.vocab[b]), k)
            self.merged.append(to)
            if made[to] < 0:
                made[to], left[to], right[to] = k, self.vocab[a], self.vocab[b]
        self.left, self.right, self.made = left, right, made
        keys = np.array([a << 32 | b for a, b in self.rank])
        order = np.argsort(keys)
        self.seams, self.seam_rank = keys[order], np.array(list(self.rank.values()))[order]
        # tokens that merging their own characters doesn't give are never proposed
        self.offered = {x: i for x, i in self.vocab.items() if self.exact(x) == [i]}
        # the longest token, without the suffix, that starts with each three characters
        self.reach: dict[str, int] = {}
        for x in self.offered:
            body = x.removesuffix(self.end) if len(x) > len(self.end) else x
            self.reach[body[:3]] = max(self.reach.get(body[:3], 0), len(body))
        self.known: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}  # the generation before: what is met again moves up
        self.parts: dict[str, tuple[bytes, str]] = {}  # words as the pattern splits them

    def _symbols(self, word: str) -> list[int]:
        """``word``: byte characters and the suffix of the end of a word, if it has that."""
        body = word.removesuffix(self.end) if len(word) > len(self.end) else word
        out = [self.vocab[c] for c in body]
        if body is not word and body != word:
            out[-1] = self.vocab[body[-1] + self.end]
        return out

    def exact(self, word: str) -> list[int]:
        """Tokens of ``word`` by merging, lowest rank first and leftmost among equals."""
        ids = self._symbols(word)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := self.rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else n
            if j >= n or self.rank.get((ids[k], ids[j])) != r:
                continue  # one of the two has been merged since
            ids[k], ids[j] = self.merged[r], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (x := self.rank.get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (x, k))
            if before[k] >= 0 and (x := self.rank.get((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (x, before[k]))
        return [x for x in ids if x >= 0]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match of byte characters; the last token ends the word. Empty if none fits."""
        offered, n, at, out = self.offered, len(word), 0, []
        while at < n:
            far = self.reach.get(word[at : at + 3], 2)
            if n - at <= far and (i := offered.get(word[at:] + self.end)) is not None:
                out.append(i)
                break
            for to in range(min(n - 1, at + far), at, -1):
                if (i := offered.get(word[at:to])) is not None:
                    break
            else:
                return []
            out.append(i)
            at = to
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stays two tokens when merged from their characters."""
        a, b = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        never = len(self.merged) + 1
        # merges across the seam count only if they come before the merge that took a part away from it
        limit = np.full(len(a), never)
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            key = x.astype(np.int64) << 32 | y
            at = np.minimum(np.searchsorted(self.seams, key), len(self.seams) - 1)
            rank = np.where(self.seams[at] == key, self.seam_rank[at], never)
            bad = rank < top
            good[live[bad]] = False
            made_x, made_y = self.made[x], self.made[y]
            done = bad | (made_x < 0) & (made_y < 0)
            # undo the later merge; of two by the same rule, the right one, as merging goes from the left
            from_x = made_x > made_y
            a[live] = np.where(from_x, self.right[x], x)
            b[live] = np.where(from_x, y, self.left[y])
            limit[live] = np.where(from_x, made_x, made_y + 1)
            live = live[~done]
        return good

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Tokens of each of ``words`` (byte characters, without the suffix)."""
        out = {x: self.propose(x) for x in words}
        sure = [x for x in words if out[x]]
        flat = np.array([i for x in sure for i in out[x]], np.int64)
        sizes = np.array([len(out[x]) for x in sure], np.int64)
        if len(flat):
            whose = np.repeat(np.arange(len(sure)), sizes)
            inside = np.flatnonzero(whose[1:] == whose[:-1])
            wrong = whose[inside[~self.compatible(flat[inside], flat[inside + 1])]]
        else:
            wrong = np.empty(0, np.int64)
        for x in [sure[k] for k in np.unique(wrong).tolist()] + [x for x in words if not out[x]]:
            out[x] = self.exact(x + self.end)
        return out

    def _normal(self, stretch: str) -> str:
        if not stretch.isascii():
            # case is mapped character by character, so no final sigma
            stretch = unicodedata.normalize("NFC", stretch).replace("Σ", "σ")
        return stretch.lower()

    def learn(self, stretches: list[str]) -> dict[str, tuple[bytes, str]]:
        """Ids (little-endian 32-bit) and names of the tokens of each of ``stretches``."""
        got: dict[str, tuple[bytes, str]] = {}
        at = 0
        while at < len(stretches):
            end, size = at, 0
            while end < len(stretches) and size < _AT_ONCE:
                size += len(stretches[end])
                end += 1
            split = [self.words(self._normal(x)) for x in stretches[at:end]]
            if len(self.parts) >= WORDS:
                self.parts.clear()
            parts = self.parts
            new = list({w for x in split for w in x if w not in parts})
            spelt = ["".join([self.char_of[b] for b in w.encode()]) for w in new]
            ids = self.encode_words(spelt)
            rare = {w: (np.array(ids[x], "<u4").tobytes(), " ".join([self.names[i] for i in ids[x]])) for w, x in zip(new, spelt)}
            parts.update((w, x) for w, x in rare.items() if len(w) <= LONG)
            for x, words in zip(stretches[at:end], split):
                of = [parts.get(w) or rare[w] for w in words]
                got[x] = of[0] if len(of) == 1 else (b"".join([w[0] for w in of]), " ".join([w[1] for w in of]))
            at = end
        return got

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each text."""
        cut = [self.special_at.search(x) is not None for x in texts] if self.special else [False] * len(texts)
        parts = [_NONBLANK.findall(x) if not c else self._around(x) for x, c in zip(texts, cut)]
        if len(self.known) >= REMEMBERED // 2:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = {x for p in parts for x in p if x not in known and x not in self.special}
        again = {x for x in new if x in before}
        known.update((x, before[x]) for x in again)
        new -= again
        rare = self.learn(list(new)) if new else {}
        for x in rare:
            if len(x) <= LONG:
                known[x] = rare[x]
        out = []
        for p in parts:
            of = [known.get(x) or rare.get(x) or self._one(x) for x in p]
            out.append((b"".join([x[0] for x in of]), " ".join([x[1] for x in of if x[1]])))
        return out

    def _one(self, token: str) -> tuple[bytes, str]:
        return np.array([self.special[token]], "<u4").tobytes(), token

    def _around(self, text: str) -> list[str]:
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [*_NONBLANK.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + _NONBLANK.findall(text[at:])

    def decode(self, ids: np.ndarray) -> str:
        """Names of the tokens with a blank between, as a tokenizer without a decoder gives."""
        return " ".join([self.names[i] for i in ids.tolist()])


_MADE: dict[str, WordBpe] = {}


def coder(path: str) -> WordBpe:
    """The encoder of a file; a worker process makes it once."""
    if path not in _MADE:
        _MADE[path] = WordBpe(path)
    return _MADE[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_tokens``, ``ids`` (little-endian 32-bit), ``decoded``.

    A null text is empty: no ids, empty decoded text. Strings of special tokens become those tokens,
    as the file's library does. Repeated rows are encoded each; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = coder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                got = words.encode(part.column(1).to_pylist())
                n = [len(x[0]) // 4 for x in got]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.string())],
                    ["id", "n_tokens", "ids", "decoded"],
                )

    rows = widened(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
