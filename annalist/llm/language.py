"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent networks read the bytes of a window, one from each end; a softmax over both
states labels every byte. A document's probabilities are the mean over all of its bytes. The network
is trained in numpy by backpropagation through time, on a bounded sample of labelled documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import widened

#: Size of a state, bytes of a window, and windows that are read in step.
STATE, WINDOW, AT_ONCE = 8, 128, 4096
#: The sample: documents of each language, windows of each document, and documents of all languages, at most.
DOCUMENTS, WINDOWS, SAMPLE = 160, 6, 10_240
#: Training: windows of a step, steps, step size, and bytes of a training window.
BATCH, STEPS, RATE, TRAINED = 160, 220, 0.02, 48
UNKNOWN = "und"

Weights = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def initial(labels: int, state: int = STATE, seed: int = 3) -> Weights:
    """Small random weights; tables ``x`` hold what each byte adds to the gates."""
    rng = np.random.default_rng(seed)
    out = {}
    for side in "fb":
        out["x" + side] = rng.normal(0, 0.3, (256, 3 * state))
        out["u" + side] = rng.normal(0, 0.3, (state, 3 * state))
        out["x" + side][:, :state] -= 0.5  # states last at first
    out["o"] = rng.normal(0, 0.3, (2 * state, labels))
    out["c"] = np.zeros(labels)
    return {k: v.astype(np.float32) for k, v in out.items()}


def _forward(w: Weights, side: str, data: np.ndarray, keep: bool = False):
    """States after each byte of ``data`` (steps, windows); with what training needs if ``keep``."""
    x, u = w["x" + side], w["u" + side]
    n = u.shape[0]
    steps, rows = data.shape
    states = np.zeros((steps + 1, rows, n), np.float32)
    gates, kept = [], []
    u_zr, u_n = np.ascontiguousarray(u[:, : 2 * n]), np.ascontiguousarray(u[:, 2 * n :])
    for t in range(steps):
        h = states[t]
        a = x[data[t]]
        zr = h @ u_zr
        zr += a[:, : 2 * n]
        zr = _sigmoid(zr)
        inner = h @ u_n
        new = zr[:, n:] * inner
        new += a[:, 2 * n :]
        np.tanh(new, out=new)
        out = states[t + 1]
        np.subtract(new, h, out=out)
        out *= zr[:, :n]
        out += h
        if keep:
            gates.append((zr, inner, new))
    return (states, gates) if keep else states


def _backward(w: Weights, side: str, data: np.ndarray, states: np.ndarray, gates: list, grad: np.ndarray) -> Weights:
    """Gradients of the weights of one side, from those of the states; through time, last step first."""
    u = w["u" + side]
    n = u.shape[0]
    dx, du = np.zeros_like(w["x" + side]), np.zeros_like(u)
    dh = np.zeros_like(states[0])
    for t in range(len(data) - 1, -1, -1):
        zr, inner, new = gates[t]
        h, z, r = states[t], zr[:, :n], zr[:, n:]
        dh = dh + grad[t]
        dnew = dh * z * (1 - new * new)
        dz = dh * (new - h) * z * (1 - z)
        dr = dnew * inner * r * (1 - r)
        da = np.concatenate([dz, dr, dnew], axis=1)
        dhid = np.concatenate([dz, dr, dnew * r], axis=1)
        du += h.T @ dhid
        np.add.at(dx, data[t], da)
        dh = dh * (1 - z) + dhid @ u.T
    return {"x" + side: dx, "u" + side: du}


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def train(windows: np.ndarray, labels: np.ndarray, count: int, steps: int = STEPS, seed: int = 5) -> Weights:
    """Weights after ``steps`` steps of Adam over ``windows`` (rows of bytes) with a label each."""
    w = initial(count)
    rng = np.random.default_rng(seed)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    shares = np.bincount(labels, minlength=count).astype(float)
    chance = (1 / shares)[labels]
    chance /= chance.sum()  # each language as often as any other
    for step in range(1, steps + 1):
        pick = rng.choice(len(windows), min(BATCH, len(windows)), p=chance)
        data = np.ascontiguousarray(windows[pick].T)
        forth, gates_f = _forward(w, "f", data, True)
        back, gates_b = _forward(w, "b", data[::-1], True)
        h = np.concatenate([forth[1:], back[1:][::-1]], axis=2)
        p = _softmax(h @ w["o"] + w["c"])
        p[:, np.arange(len(pick)), labels[pick]] -= 1
        p /= p.shape[0] * p.shape[1]
        grad = {"o": np.einsum("tbi,tbj->ij", h, p), "c": p.sum(axis=(0, 1))}
        dh = p @ w["o"].T
        n = STATE
        grad |= _backward(w, "f", data, forth, gates_f, dh[:, :, :n])
        grad |= _backward(w, "b", data[::-1], back, gates_b, dh[::-1, :, n:])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grad.items():
            mean[k] += 0.1 * (g - mean[k])
            square[k] += 0.01 * (g * g - square[k])
            move = mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            w[k] -= (rate * move).astype(np.float32)
    return w


def label_bytes(w: Weights, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums over the bytes of each window (a row, of which ``lengths`` count) of the label probabilities."""
    data = np.ascontiguousarray(windows.T)
    place = np.arange(data.shape[0])[:, None]
    inside = place < lengths[None, :]
    forth = _forward(w, "f", data)[1:]
    # the far end comes first: a shorter window's bytes are moved there, so its state starts afresh
    turned = np.take_along_axis(data, np.maximum(lengths[None, :] - 1 - place, 0), axis=0)
    back = _forward(w, "b", turned)[1:]
    back = np.take_along_axis(back, np.maximum(lengths[None, :] - 1 - place, 0)[:, :, None], axis=0)
    n = w["uf"].shape[0]
    p = _softmax(forth @ w["o"][:n] + back @ w["o"][n:] + w["c"])
    return np.einsum("tbk,tb->bk", p, inside.astype(np.float32))


def probabilities(w: Weights, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all bytes of each text; an empty text has zeros."""
    labels = w["c"].shape[0]
    out = np.zeros((len(texts), labels))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes) - sizes
    number = -(-sizes // WINDOW)
    whose = np.repeat(np.arange(len(texts)), number)
    nth = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    start = base[whose] + nth * WINDOW
    length = np.minimum(WINDOW, base[whose] + sizes[whose] - start)
    order = np.argsort(-length, kind="stable")  # windows of one length run together
    for k in range(0, len(order), AT_ONCE):
        part = order[k : k + AT_ONCE]
        longest = int(length[part].max())
        at = np.minimum(start[part][:, None] + np.arange(longest)[None, :], max(0, len(flat) - 1))
        np.add.at(out, whose[part], label_bytes(w, flat[at], length[part]))
    return out / np.maximum(sizes, 1)[:, None]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(column: str = "doc_id"):
    """Whether the document is kept from learning: its id's CRC-32 leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Languages and weights."""

    def __init__(self, languages: list[str], weights: Weights):
        self.languages, self.weights = languages, weights

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability; ``und`` and 0 for null and for texts without a letter."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        fine = [k for k, x in enumerate(texts) if x and has_letter(x)]
        if not fine or not self.languages:
            return out
        for k, p in zip(fine, probabilities(self.weights, [texts[k].encode() for k in fine])):
            best = int(p.argmax())
            out[k] = self.languages[best], min(1.0, float(p[best]))
        return out


def fit(docs: DataFrame, documents: int = DOCUMENTS, windows: int = WINDOWS, sample: int = SAMPLE) -> Model:
    """Train on a sample of the documents that aren't held out and whose language isn't null.

    The sample's bound: ``documents`` of each language, those of least hash of id and text, and
    ``windows`` stretches of each, spread evenly over the whole text; ``sample`` documents in all, in
    turn from every language, so that a language is left out only if there are more than that. Rows
    that repeat id and text count once.
    """
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("key"))
    picked = known.select("lang", "key").withColumn("place", place).where(F.col("place") <= documents).distinct()
    picked = picked.orderBy("place", F.xxhash64("lang"), "lang").limit(sample).select("key").collect()
    if not picked:
        return Model([], initial(1))
    keys = [r["key"] for r in picked]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or not has_letter(text):
                    continue
                data = text.encode()
                n = max(1, min(windows, len(data) // TRAINED))
                for k in range(n):
                    at = (len(data) - TRAINED) * k // max(1, n - 1) if len(data) > TRAINED else 0
                    piece = data[at : at + TRAINED]
                    out.append((piece * (TRAINED // len(piece) + 1))[:TRAINED])
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "piece"])

    rows = known.where(F.col("key").isin(keys)).dropDuplicates(["lang", "key"]).select("lang", "text")
    rows = sorted((r["lang"], bytes(r["piece"])) for r in rows.mapInArrow(cut, "lang string, piece binary").collect())
    if not rows:
        return Model([], initial(1))
    data = np.frombuffer(b"".join(x for _, x in rows), np.uint8).reshape(len(rows), TRAINED)
    languages = sorted({x for x, _ in rows})
    labels = np.array([languages.index(x) for x, _ in rows])
    return Model(languages, train(data, labels, len(languages)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, columns to ``carry``, ``lang_pred``, ``score``.

    The whole text decides, every byte of it. Null texts and texts without a letter are ``und`` with
    score 0; repeated rows are judged each; an empty table gives no rows.
    """
    languages, weights = json.dumps(model.languages), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Model(json.loads(languages), weights)
        for batch in batches:
            start = 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + (2 << 20), "right")))
                part = batch.slice(start, end - start)
                got = judge.predict(part.column(0).to_pylist())
                columns = [*part.columns[1:], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[1:], "lang_pred", "score"])
                start = end

    rows = widened(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *carry))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double").withColumnRenamed("id", id_col)
