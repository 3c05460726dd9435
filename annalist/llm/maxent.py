"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax.

Words are counted over all training documents. The commonest form classes by frequency; every other
word belongs to a class by a hash of its ending, so a word that was never seen has one too. The
model gives the class of the next token from hashed features of the tokens before it (one back, two
back, three back, and the last two together), then the word within a class of common words from the
tokens one and two back; within a class of endings, words follow their smoothed counts. Weights are
trained by gradient steps on every partition of the training documents at once, each document in one
round, and after each round what the partitions changed is averaged, row by row, by use.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8, widened

#: Classes of common words and their size; classes of endings.
FREQUENT, EACH, ENDINGS = 16, 32, 48
HEAD, CLASSES = FREQUENT * EACH, FREQUENT + ENDINGS
#: Places of a token before: common words, classes of endings, and the start of a text.
START = HEAD + ENDINGS
_SPAN = 1024
#: Rows of the class weights (the bias, three places, hashed pairs) and of the word weights.
ROWS, WORD_ROWS = 1 << 14, 1 + 2 * _SPAN
_PAIRS = 1 + 3 * _SPAN
#: Words whose counts every worker holds, at most, and the bytes of the longest of them. Counts of
#: all other words are joined.
HELD, LONG = 150_000, 48
#: Rounds of training, largest step, occurrences that damp a step, power of a row's number of steps
#: by which they shrink, tokens of a step and of what is scored at once (few enough for the
#: processor's cache), rows of weights that travel together.
ROUNDS, RATE, DAMPED, DECAY, STEP, SCORED, TOGETHER = 2, 0.8, 4.0, 0.25, 1 << 14, 1 << 12, 256
#: Bytes of text whose tokens are looked up together.
BYTES = 1 << 18
#: Tokens that a task of training reads, about, whatever the input and the cluster.
LEARNED = 4_000_000
#: Distinct words that a counting task holds before it sends their counts.
_COUNTED = 400_000

END = b""  # the token at the end of a text; no word is empty


def ending_class(word: bytes) -> int:
    """The class of a word that isn't common, from its last two bytes."""
    return (word[-1] * 131 + (word[-2] if len(word) > 1 else 0) * 7) % 251 % ENDINGS if word else 0


def held_out(column: str = "doc_id"):
    """Whether the document is kept from learning: its id's CRC-32 leaves 1 when divided by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word``, ``ending`` and ``c`` of every token of ``docs`` (``text`` as bytes), the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            words = list(seen)
            columns = [pa.array(words, pa.binary()), pa.array([ending_class(x) for x in words], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "ending", "c"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(text.as_py().lower().split())
                seen[END] += 1
                if len(seen) > _COUNTED:
                    yield sent()
                    seen.clear()
        if seen:
            yield sent()

    return docs.select("text").mapInArrow(run, "word binary, ending int, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


class Vocabulary:
    """What workers hold of the counts: at most ``HELD`` words, common ones first, and totals by class."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, of_ending: np.ndarray, kinds: np.ndarray):
        self.words, self.counts, self.total, self.distinct = words, counts, total, distinct
        # the end token is a common word whatever its count
        at = words.index(END) if END in words else -1
        order = [at, *(k for k in range(len(words)) if k != at)] if at >= 0 else list(range(len(words)))
        self.words = [words[k] for k in order] if at >= 0 else [END, *words]
        self.counts = counts[order] if at >= 0 else np.append(0, counts)
        head = self.words[:HEAD]
        self.head = len(head)
        of_ending, kinds = of_ending.astype(float), kinds.astype(float)
        for x, c in zip(head, self.counts[: self.head]):
            of_ending[ending_class(x)] -= c
            kinds[ending_class(x)] -= c > 0
        self.of_ending, self.kinds = np.maximum(of_ending, 0), np.maximum(kinds, 0)

    def prepare(self) -> None:
        """Tables that a worker makes for itself."""
        self.index = {x: k for k, x in enumerate(self.words)}
        ending = np.array([ending_class(x) for x in self.words])
        self.place = np.where(np.arange(len(self.words)) < self.head, np.arange(len(self.words)), HEAD + ending).astype(np.int32)
        self.base_low = np.log10(self.total + 0.5 * (self.distinct + 1))
        self.log_count = np.log10(self.counts + 0.5)
        self.ending_low = np.log10(self.of_ending + 0.5 * (self.kinds + 1))

    def initial(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights that give every token its smoothed share, whatever came before."""
        rows = np.zeros((ROWS, CLASSES), np.float32)
        words = np.zeros((WORD_ROWS, FREQUENT, EACH), np.float32)
        share = np.zeros(HEAD)
        share[: self.head] = self.counts[: self.head] + 0.5
        share = share.reshape(FREQUENT, EACH)
        mass = np.concatenate([share.sum(axis=1), self.of_ending + 0.5 * (self.kinds + 1)])
        rows[0] = np.log(np.maximum(mass / mass.sum(), 1e-13))
        words[0] = np.log(np.maximum(share / np.maximum(share.sum(axis=1, keepdims=True), 1e-9), 1e-13))
        return rows, words


class Tokens:
    """Tokens of texts, as places of the model: flat, with three starts before each text."""

    def __init__(self, vocabulary: Vocabulary, texts: list[bytes], rare: bool = True):
        get = vocabulary.index.get
        self.rare: list[Counter[bytes]] = []
        self.known: list[np.ndarray] = []
        flat: list[np.ndarray] = []
        for text in texts:
            words = text.lower().split()
            words.append(END)
            at = np.array(list(map(get, words, repeat(-1))), np.int32)
            place = vocabulary.place[at]
            missed = np.flatnonzero(at < 0)
            if len(missed):
                place[missed] = [HEAD + ending_class(words[k]) for k in missed.tolist()]
            if rare:
                self.rare.append(Counter([words[k] for k in missed.tolist()]))
            self.known.append(at)
            flat += [np.full(3, START, np.int32), place]
        self.flat = np.concatenate(flat) if flat else np.empty(0, np.int32)
        self.sizes = np.array([len(x) for x in self.known], np.int64)
        self.at = np.flatnonzero(self.flat != START)


def _features(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class weights, and of the word weights, that are active at each token beside the bias."""
    one, two, three = flat[at - 1].astype(np.int64), flat[at - 2].astype(np.int64), flat[at - 3].astype(np.int64)
    pair = _PAIRS + ((one * _SPAN + two) * 2654435761 >> 7) % (ROWS - _PAIRS)
    rows = np.stack([1 + one, 1 + _SPAN + two, 1 + 2 * _SPAN + three, pair])
    return rows, rows[:2]


def _class_of(place: np.ndarray) -> np.ndarray:
    return np.where(place < HEAD, place // EACH, place - HEAD + FREQUENT)


def _exponents(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials of the logits, in place, and their sums by row."""
    if len(logits) and float(logits.max()) > 60:  # single precision holds no exponential over 88
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, logits @ np.ones(logits.shape[1], np.float32)


def _forward(rows: np.ndarray, words: np.ndarray, flat: np.ndarray, at: np.ndarray):
    """Class exponentials and their sums at each token; of common words, the same within their class."""
    features, near = _features(flat, at)
    place = flat[at]
    classes = _class_of(place)
    logits = rows[features[0]]
    logits += rows[0]
    for f in features[1:]:
        logits += rows[f]
    head = np.flatnonzero(place < HEAD)
    inner = words.reshape(-1, EACH)
    bias, cells = classes[head], near[:, head] * FREQUENT + classes[head]
    within = inner[bias]
    for f in cells:
        within += inner[f]
    return features, [bias, *cells], classes, head, place[head] % EACH, _exponents(logits), _exponents(within)


def log10_tokens(rows: np.ndarray, words: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log10 of the class probability of each token, times that of a common word within its class."""
    out = np.empty(len(at))
    for k in range(0, len(at), SCORED):
        part = at[k : k + SCORED]
        _, _, classes, head, slot, (p, total), (within, inner) = _forward(rows, words, flat, part)
        got = p[np.arange(len(part)), classes].astype(float) / total
        got[head] *= within[np.arange(len(head)), slot] / inner
        out[k : k + SCORED] = np.log10(np.maximum(got, 1e-30))
    return out


class Trainer:
    """Gradient steps with a step size for each weight, and how often each row was used."""

    def __init__(self, rows: np.ndarray, words: np.ndarray):
        self.rows, self.words = rows.copy(), words.reshape(-1, EACH).copy()
        self.first = rows, words.reshape(-1, EACH)
        self.used = [np.zeros(len(self.rows), np.float32), np.zeros(len(self.words), np.float32)]
        self.steps = [np.zeros(len(self.rows), np.float32), np.zeros(len(self.words), np.float32)]

    def _descend(self, k: int, table: np.ndarray, feature: np.ndarray | None, grad: np.ndarray, label: np.ndarray) -> None:
        """A step along the gradient of the rows in use, each weight by its curvature.

        The gradient of a weight is what the model expects of its class less what was observed; the
        larger of the two bounds the curvature, so a step never exceeds ``RATE``.
        """
        width = grad.shape[1]
        if feature is None:  # the bias is active at every token
            which, times = np.zeros(1, np.int64), np.full(1, len(grad))
            total = grad.sum(axis=0, keepdims=True)
            seen = np.bincount(label, minlength=width)[None, :].astype(np.float32)
        else:
            order = np.argsort(feature.astype(np.int16 if len(table) <= 1 << 15 else np.int32), kind="stable")
            ordered = feature[order]
            starts = np.flatnonzero(np.diff(ordered, prepend=-1))
            which = ordered[starts]
            total = np.add.reduceat(grad[order], starts, axis=0)
            times = np.diff(np.append(starts, len(feature)))
            cell = np.repeat(np.arange(len(which)) * width, times) + label[order]
            seen = np.bincount(cell, minlength=len(which) * width).reshape(-1, width).astype(np.float32)
        seen += np.maximum(total, 0)  # the larger of what was observed and what was expected
        seen += DAMPED
        self.steps[k][which] += 1
        seen *= (self.steps[k][which] ** DECAY)[:, None]
        total *= RATE
        total /= seen
        table[which] -= total
        self.used[k][which] += times

    def step(self, flat: np.ndarray, at: np.ndarray) -> None:
        features, cells, classes, head, slot, (p, total), (within, inner) = _forward(self.rows, self.words, flat, at)
        p /= total[:, None]
        within /= inner[:, None]
        p[np.arange(len(at)), classes] -= 1
        within[np.arange(len(head)), slot] -= 1
        for f in (None, *features):
            self._descend(0, self.rows, f, p, classes)
        if len(head):
            for f in cells:
                self._descend(1, self.words, f, within, slot)

    def changes(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Blocks of rows that were used: number of the block, uses, and changes times uses."""
        at = 0
        for k, table in enumerate((self.rows, self.words)):
            for start in range(0, len(table), TOGETHER):
                used = self.used[k][start : start + TOGETHER]
                if used.any():
                    change = (table[start : start + TOGETHER] - self.first[k][start : start + TOGETHER]) * used[:, None]
                    yield at + start // TOGETHER, used.tobytes(), change.astype(np.float32).tobytes()
            at += -(-len(table) // TOGETHER)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k in range(batch.num_rows):
            block = batch.column(0)[k].as_py()
            got = [np.frombuffer(batch.column(c)[k].as_py(), np.float32) for c in (1, 2)]
            if block in held:
                for a, b in zip(held[block], got):
                    a += b
            else:
                held[block] = [x.copy() for x in got]
    for block, (used, change) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([used.tobytes()], pa.binary()), pa.array([change.tobytes()], pa.binary())], ["block", "used", "change"])


def _trained(docs: DataFrame, vocabulary: Vocabulary, rows: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one round over ``docs`` (``text`` as bytes), each partition starting from the same.

    Splits of the input are put together to partitions of about ``LEARNED`` tokens, so neither a
    task's work nor what a lost executor repeats grows with the input, and the weights don't depend
    on the number of cores. Changes are summed by block, in the order of the partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary.prepare()
        trainer = Trainer(rows, words)
        held: list[bytes] = []
        size = 0

        def learn() -> None:
            tokens = Tokens(vocabulary, held, rare=False)
            for k in range(0, len(tokens.at), STEP):
                trainer.step(tokens.flat, tokens.at[k : k + STEP])

        for batch in batches:
            for text in batch.column(0):
                held.append(text.as_py())
                size += len(held[-1])
                if size > BYTES:
                    learn()
                    held, size = [], 0
        if held:
            learn()
        part = TaskContext.get().partitionId()
        for block, used, change in trainer.changes():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([used], pa.binary()), pa.array([change], pa.binary())], ["block", "part", "used", "change"])

    tasks = max(1, round(vocabulary.total / ROUNDS / LEARNED))
    summing = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    parts = docs.select("text").coalesce(tasks).mapInArrow(run, "block int, part int, used binary, change binary")
    parts = parts.repartition(summing, "block").sortWithinPartitions("block", "part").select("block", "used", "change")
    got = parts.mapInArrow(_summed, "block int, used binary, change binary")
    rows, words = rows.copy(), words.reshape(-1, EACH).copy()
    first = -(-len(rows) // TOGETHER)
    for r in got.collect():  # as many as there are blocks of weights
        table, block = (rows, r["block"]) if r["block"] < first else (words, r["block"] - first)
        used = np.frombuffer(r["used"], np.float32)
        change = np.frombuffer(r["change"], np.float32).reshape(len(used), -1)
        table[block * TOGETHER : block * TOGETHER + len(used)] += change / np.maximum(used, 1)[:, None]
    return rows, words.reshape(-1, FREQUENT, EACH)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, scored by a model of those that aren't held out.

    Columns: ``id_col``, ``held_out``, ``n_tokens``, ``n_known`` (tokens that training has),
    ``train_tokens``, ``base_score`` (smoothed unigrams) and ``score`` (the model), both log10 of the
    probability of the whole text. A null text is empty and has its end token only; rows with a null
    id are learned from; repeated rows count each; an empty table gives no rows.
    """
    rows = widened(docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    train = rows.where(~held_out("id"))
    counts = stored(word_counts(train), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    by_ending = counts.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("kinds")).collect()
    of_ending, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by_ending:
        of_ending[r["ending"]], kinds[r["ending"]] = r["c"], r["kinds"]
    # at most HELD words of at most LONG bytes
    common = counts.where(F.octet_length("word") <= LONG).orderBy(F.desc("c"), "word").limit(HELD).select("word", "c").toArrow()
    held = Vocabulary(common["word"].to_pylist(), common["c"].to_numpy(), total, distinct, of_ending, kinds)

    weights = held.initial()
    for k in range(ROUNDS if total else 0):
        part = train.where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == k)
        weights = _trained(part, held, *weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held.prepare()
        for batch in batches:
            start = 0
            sizes = np.cumsum([len(x.as_py()) for x in batch.column(1)])
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + (1 << 20), "right")))
                part = batch.slice(start, end - start)
                start = end
                tokens = Tokens(held, part.column(1).to_pylist())
                each = log10_tokens(*weights, tokens.flat, tokens.at)
                known = np.concatenate(tokens.known)
                place = tokens.flat[tokens.at]
                ends = np.cumsum(tokens.sizes) - tokens.sizes
                counted = np.where(known >= 0, held.log_count[known], 0.0)
                within = np.where(place >= HEAD, counted - held.ending_low[np.maximum(place - HEAD, 0)], 0.0)
                columns = [
                    part.column(0),
                    pa.array(tokens.sizes),
                    pa.array(np.add.reduceat(((known >= 0) & (held.counts[known] > 0)).astype(np.int64), ends)),
                    pa.array(np.add.reduceat(counted, ends) - tokens.sizes * held.base_low),
                    pa.array(np.add.reduceat(each + within, ends)),
                    pa.array([list(x.items()) for x in tokens.rare], pa.map_(pa.binary(), pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "n_known", "base", "model", "rare"])

    schema = f"id {kind}, n_tokens long, n_known long, base double, model double, rare map<binary,bigint>"
    scored = stored(rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    # the words that workers don't hold: each adds the log of its count to both scores
    rare = scored.select("row", F.explode("rare").alias("word", "times"))
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    more = (
        rare.join(counts.select("word", "c"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * log).alias("more"), F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("found"))
    )
    some = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(more, "row", "left").select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + some).alias("base_score"),
        (F.col("model") + some).alias("score"),
    )
