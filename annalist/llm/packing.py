"""Packing along a space-filling curve.

Token counts of each document are hashed to a signed vector, projected to three dimensions, and
turned into a Hilbert key. Documents are range-sorted by the key, so that neighbours on the curve
share vocabulary, and packed in that order: each partition of the range is one run of tokens that
is cut every ``width`` ids. The rest of a run is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8, widened

WIDTH, END = 2048, 1
#: Dimensions of the projection, and bits of each in the key.
DIMENSIONS, BITS = 3, 12
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 400_000
#: White space as the tokenizer's patterns take it.
_BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Stretches that no token crosses: a word with what clings to it and one blank before, or blanks.
_STRETCH = re.compile(f" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes of Latin-1 stand for themselves, the others for characters from U+0100 on.
    """
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Ids of a byte-level BPE file, the same as the file's own library gives.

    Text is cut into stretches that no token crosses; a stretch's ids are remembered. New stretches
    go to a rank-merging encoder over the file's vocabulary if its merges are in the order of their
    ids, and to the file's library if not, or where a special token's string occurs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.known: dict[str, bytes] = {}
        vocab, to_byte = spec["model"]["vocab"], byte_of()
        self.size = max(max(vocab.values()), *(x["id"] for x in spec["added_tokens"]), END) + 1
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        merged = [vocab["".join(x if isinstance(x, list) else x.split(" "))] for x in spec["model"]["merges"]]
        self.ranked = None
        if merged == sorted(merged) and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"] and spec["normalizer"] is None:
            import public_tokenizers
            import tiktoken

            ranks = {bytes(to_byte[c] for c in x): i for x, i in vocab.items() if i not in {t["id"] for t in spec["added_tokens"]}}
            self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _new(self, stretch: str) -> bytes:
        ids = self.ranked.encode_ordinary(stretch) if self.ranked else self.whole.encode(stretch, add_special_tokens=False).ids
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        got = self.known[stretch] = np.array(ids, self.dtype).tobytes()
        return got

    def encode(self, text: str) -> np.ndarray:
        if any(x in text for x in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype)
        known = self.known
        parts = _STRETCH.findall(text)
        try:
            raw = b"".join([known[x] for x in parts])
        except KeyError:
            raw = b"".join([known.get(x) or self._new(x) for x in parts])
        return np.frombuffer(raw, self.dtype)


_TOKENS: dict[str, ByteTokens] = {}


def tokens_of(path: str) -> ByteTokens:
    """The encoder of a file; a worker process makes it once."""
    if path not in _TOKENS:
        _TOKENS[path] = ByteTokens(path)
    return _TOKENS[path]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of points with integer coordinates below ``2**bits``."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest cell down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _signs(size: int) -> np.ndarray:
    """For each token id, a sign in each dimension, from a hash of the id."""
    with np.errstate(over="ignore"):
        h = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.stack([(h >> np.uint64(7 * k) & np.uint64(1)).astype(np.float32) * 2 - 1 for k in range(DIMENSIONS)], axis=1)


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``key`` (Hilbert), ``n`` and ``ids`` (little-endian, end id included) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        signs = _signs(tokens.size)
        end = np.array([END], tokens.dtype).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, at = [], np.zeros((part.num_rows, DIMENSIONS))
                for k, text in enumerate(part.column(1).to_pylist()):
                    got = tokens.encode(text)
                    ids.append(got.tobytes() + end)
                    for i in range(0, len(got), 1 << 20):
                        at[k] += signs[got[i : i + (1 << 20)]].sum(axis=0)
                    at[k] /= max(1, len(got))
                cell = ((np.tanh(3 * at) + 1) / 2 * ((1 << BITS) - 1)).astype(np.int64)
                n = [len(x) // tokens.dtype().itemsize for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hilbert(cell)), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["id", "key", "n", "ids"])

    rows = widened(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key long, n long, ids binary")


def _cut(rest: int, width: int) -> list[int]:
    """Lengths of the sequences that the last ``rest`` ids of a run make: powers of two, largest first."""
    return [1 << b for b in range(width.bit_length() - 1, -1, -1) if rest >> b & 1] if rest < width else [width]


def pack(docs: DataFrame, path: str, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, in sequences of at most ``width`` (a power of two) ids.

    Columns: ``id_col``, ``start`` (ids of the document before the piece), ``length``, ``ids``
    (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``. Every document ends
    with id 1, so a null or empty text is one piece of one id. Every sequence holds ``width`` ids or
    a lesser power of two of them, so none needs padding. Repeated rows are packed as often as they
    occur; an empty table gives no pieces; a long document spans as many sequences as it needs.
    """
    if width < 1 or width & (width - 1):
        raise ValueError("width must be a power of two")
    spark = docs.sparkSession
    made = stored(tokenised(docs, path, id_col, text_col), "tokens")
    kind = made.schema["id"].dataType.simpleString()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = tokens_of(path)
        sequence = TaskContext.get().partitionId() << 36
        fields = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types: list[pa.DataType] = []
        filled = 0
        open_: list[tuple] = []  # pieces of the sequence that is being filled

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], fields)

        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 2, pa.binary(), *[pa.int64()] * 3]
            done: list[tuple] = []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                ids = np.frombuffer(raw, tokens.dtype).astype("<u4")
                start, n = 0, len(ids)
                while start < n:
                    take = min(width - filled, n - start)
                    open_.append((key, start, take, ids[start : start + take].tobytes(), n, sequence, filled))
                    start += take
                    filled += take
                    if filled == width:
                        done += open_
                        open_, filled = [], 0
                        sequence += 1
                if len(done) > 2000:
                    yield batch_of(done)
                    done = []
            if done:
                yield batch_of(done)
        if open_:
            last: list[tuple] = []
            room = _cut(filled, width)
            used = 0
            for key, start, length, raw, n, _, _ in open_:
                at = 0
                while at < length:
                    take = min(room[0] - used, length - at)
                    last.append((key, start + at, take, raw[4 * at : 4 * (at + take)], n, sequence, used))
                    at += take
                    used += take
                    if used == room[0]:
                        room.pop(0)
                        used = 0
                        sequence += 1
            yield batch_of(last)

    dealt = made.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").select("id", "n", "ids")
    out = dealt.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
