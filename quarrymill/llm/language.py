"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads windows of WINDOW bytes of the whole text, labels every byte, and a document's probabilities are the means over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WINDOW, HIDDEN, BLOCK = 64, 6, 4096
#: The training sample: documents of each language, and windows of each document; passes over it, windows of a step, step size.
SAMPLE, SAMPLE_WINDOWS, EPOCHS, BATCH, RATE = 240, 5, 4, 96, 0.03
PAD, NO_LETTER = 256, "und"


def squash(x: np.ndarray) -> np.ndarray:
    """In place, x / (1 + |x|): between -1 and 1 like the hyperbolic tangent, at a fraction of its cost."""
    x /= np.abs(x) + np.float32(1)
    return x


def weights(classes: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Per direction: a table of inputs by byte (update, reset, candidate), recurrent matrices; then the labels' layer."""
    r = np.random.default_rng(seed)
    out = {}
    for d in "fb":
        out[f"x{d}"] = r.normal(0, 0.3, (PAD + 1, 3 * HIDDEN)).astype(np.float32)
        out[f"u{d}"] = r.normal(0, 0.4, (HIDDEN, 2 * HIDDEN)).astype(np.float32)
        out[f"c{d}"] = r.normal(0, 0.4, (HIDDEN, HIDDEN)).astype(np.float32)
    out["o"], out["ob"] = r.normal(0, 0.3, (2 * HIDDEN, classes)).astype(np.float32), np.zeros(classes, np.float32)
    return out


def run(w: dict, d: str, x: np.ndarray):
    """For training: states of one direction over x (steps, windows), and what backpropagation needs. The state rests where a byte is padding."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    states, kept = np.empty((*x.shape, HIDDEN), np.float32), []
    table, u, c = w[f"x{d}"], w[f"u{d}"], w[f"c{d}"]
    for t in range(len(x)):
        in_ = table[x[t]]
        gates = squash(in_[:, : 2 * HIDDEN] + h @ u) * np.float32(0.5) + np.float32(0.5)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = squash(in_[:, 2 * HIDDEN :] + (r * h) @ c)
        on = (x[t] != PAD)[:, None]
        kept.append((h, z, r, n, on))
        h = states[t] = np.where(on, h + z * (n - h), h)
    return states, kept


def states(w: dict, d: str, x: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The same states as run, units first: (steps, HIDDEN, windows). full: whether a step has no padding."""
    table, u, c = (np.ascontiguousarray(w[k + d].T) for k in "xuc")
    out = np.empty((len(x), HIDDEN, x.shape[1]), np.float32)
    h, half = np.zeros((HIDDEN, x.shape[1]), np.float32), np.float32(0.5)
    for t in range(len(x)):
        in_ = table.take(x[t], axis=1)
        gates, n = in_[: 2 * HIDDEN], in_[2 * HIDDEN :]
        gates += u @ h
        squash(gates)
        gates *= half
        gates += half
        n += c @ (gates[HIDDEN:] * h)
        squash(n)
        n -= h
        n *= gates[:HIDDEN]
        if not full[t]:
            n *= x[t] != PAD
        h = np.add(h, n, out=out[t])
    return out


def back(w: dict, d: str, x: np.ndarray, kept: list, g: np.ndarray, grads: dict) -> None:
    """Backpropagation through time: g are the gradients of the states, summed into grads."""
    u, c = w[f"u{d}"], w[f"c{d}"]
    gh = np.zeros_like(g[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, on = kept[t]
        gh = gh + g[t]
        live = gh * on
        gz = live * (n - h) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        gn = live * z * (1 - np.abs(n)) ** 2
        through = gn @ c.T
        gr = through * h * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        gates = np.concatenate((gz, gr), 1)
        grads[f"c{d}"] += (r * h).T @ gn
        grads[f"u{d}"] += h.T @ gates
        np.add.at(grads[f"x{d}"], x[t], np.concatenate((gates, gn), 1))
        gh = gh * ~on + live * (1 - z) + through * r + gates @ u.T


def label(w: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of each class at every byte: (steps, classes, windows), 0 at padding; x: (steps, windows)."""
    pad = x == PAD
    full = ~pad.any(1)
    f, b = states(w, "f", x, full), states(w, "b", x[::-1], full[::-1])[::-1]
    of, ob, bias = np.ascontiguousarray(w["o"][:HIDDEN].T), np.ascontiguousarray(w["o"][HIDDEN:].T), w["ob"][:, None]
    out = np.empty((len(x), len(bias), x.shape[1]), np.float32)
    for t in range(len(x)):
        s = of @ f[t]
        s += ob @ b[t]
        s += bias
        s -= s.max(0)
        np.exp(s, out=s)
        s /= s.sum(0)
        if not full[t]:
            s *= ~pad[t]
        out[t] = s
    return out


def train(x: np.ndarray, y: np.ndarray, classes: int) -> dict[str, np.ndarray]:
    """Fit to windows x (windows, steps) with classes y: cross-entropy at every byte, Adam steps, a fixed order by seed."""
    w = weights(classes)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in "mv")
    order, step = np.random.default_rng(2), 0
    for epoch in range(EPOCHS):
        for pick in np.array_split(p := order.permutation(len(x)), max(1, len(p) // BATCH)):
            bx, step = np.ascontiguousarray(x[pick].T), step + 1
            (hf, kf), (hb, kb) = run(w, "f", bx), run(w, "b", bx[::-1])
            both = np.concatenate((hf, hb[::-1]), 2)
            s = both @ w["o"] + w["ob"]
            s = np.exp(s - s.max(2, keepdims=True))
            s /= s.sum(2, keepdims=True)
            s[:, np.arange(len(pick)), y[pick]] -= 1
            on = (bx != PAD)[..., None]
            s = s * on / max(on.sum(), 1)
            grads = {k: np.zeros_like(a) for k, a in w.items()}
            grads["o"] += np.einsum("tnh,tnc->hc", both, s, optimize=True)
            grads["ob"] += s.sum((0, 1))
            g = s @ w["o"].T
            back(w, "f", bx, kf, g[:, :, :HIDDEN], grads)
            back(w, "b", bx[::-1], kb, g[::-1, :, HIDDEN:], grads)
            rate = RATE * 0.5 ** (3 * epoch / EPOCHS)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.99 * v[k] + 0.01 * grads[k] ** 2
                w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return w


def cut_up(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts with offsets at, padded: (windows, WINDOW), and the text of each."""
    size = np.diff(at)
    many = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), many)
    start = np.repeat(at[:-1], many) + WINDOW * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    place = start[:, None] + np.arange(WINDOW)
    inside = place < at[1:][text][:, None]
    found = data[np.minimum(place, max(len(data) - 1, 0))].astype(np.int16) if len(data) else np.zeros(place.shape, np.int16)  # PAD is no byte
    return np.where(inside, found, np.int16(PAD)), text


class Model:
    def __init__(self, names: list[str], w: dict[str, np.ndarray] | None):
        self.names, self.w = names, w

    def pooled(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of each text; zeros for an empty one."""
        out = np.zeros((len(at) - 1, len(self.names)))
        for a in range(0, len(at) - 1, 256):
            b = min(a + 256, len(at) - 1)
            x, text = cut_up(data, at[a : b + 1])
            for k in range(0, len(x), BLOCK):
                part = np.ascontiguousarray(x[k : k + BLOCK].T)
                np.add.at(out, a + text[k : k + BLOCK], label(self.w, part).sum(0).T)
        return out / np.maximum(np.diff(at), 1)[:, None]


def learnable() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of every non-null language of docs, from sample documents of each, drawn by a hash of their ids, never of held-out ones.

    The draw ranks ids alone; only SAMPLE_WINDOWS windows of each drawn text, spread over it, reach the driver.
    """
    spark = docs.sparkSession
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable())
    drawn = usable.select("doc_id", "lang").withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= sample).select("doc_id").distinct()
    texts = usable.join(F.broadcast(drawn), "doc_id", "left_semi").select("doc_id", "lang", "text")

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, at = common.utf8(b.column(2))
            x, text = cut_up(data, at)
            keep = []
            for k in range(b.num_rows):
                own = np.flatnonzero(text == k)
                keep += own[np.unique(np.linspace(0, len(own) - 1, SAMPLE_WINDOWS).astype(int))].tolist() if len(own) else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[keep])), b.column(1).take(pa.array(text[keep])), pa.array([x[k].tobytes() for k in keep], pa.binary())], ["doc_id", "lang", "bytes"])

    rows = texts.mapInArrow(common.lean(task), "doc_id long, lang string, bytes binary").orderBy("doc_id", "bytes").collect()
    names = sorted({r["lang"] for r in rows})
    if not names:
        return Model([], None)
    x = np.stack([np.frombuffer(r["bytes"], np.int16) for r in rows])
    return Model(names, train(x, np.array([names.index(r["lang"]) for r in rows]), len(names)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row: the language with the largest mean probability over the whole text's bytes.

    A null text, or one without a letter, is "und" with score 0, as is everything where the model knows no language.
    """
    spark = docs.sparkSession
    common.ship(spark)
    common.small_batches(spark)
    t = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.when(t.rlike(r"\p{L}"), t).otherwise("").alias("text"))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, at = common.utf8(b.column(1))
            if model.names:
                p = model.pooled(data, at)
                best, none = p.argmax(1), np.diff(at) == 0
                names = [NO_LETTER if e else model.names[k] for k, e in zip(best, none, strict=True)]
                score = np.clip(p.max(1), 0, 1)
            else:
                names, score = [NO_LETTER] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(common.lean(task), "doc_id long, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    """Learn from documents that aren't held out, predict all."""
    docs = common.table(spark, sf_dir, "documents")
    common.ship(spark)
    common.small_batches(spark)
    return identify(docs, fit(docs)).select("doc_id", (~learnable()).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
