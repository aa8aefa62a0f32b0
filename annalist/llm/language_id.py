"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes in both directions from a zero state
and gives every position a distribution over the learned languages; a document's
distribution is the mean over its letter positions, of all windows of the whole
text.  It is trained here in numpy by backpropagation through time on a bounded,
deterministic sample (``TRAIN_ROWS`` rows a language, ``TRAIN_WINDOWS`` windows
a row).  Prediction is one map over the rows with a broadcast of a few thousand
weights; nothing is shuffled.

Defined results: a null text or one without a letter is ``und`` with score 0; an
empty training set gives ``und`` for all; rows that repeat are predicted alike;
ties between languages go to the first by code point.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens

#: Bound of the training sample: rows a language, windows a row.
TRAIN_ROWS, TRAIN_WINDOWS = 300, 3
WINDOW, HIDDEN, STEPS, BATCH = 64, 8, 300, 96

_LETTER = re.compile(r"[^\W\d_]")
#: Lower-cased letters and non-ASCII bytes stay, everything else reads as a space.
_INPUT = np.array([c if 97 <= c <= 122 or c >= 0x80 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def encode(text: str) -> np.ndarray:
    return _INPUT[np.frombuffer(text.lower().encode(), np.uint8)]


def windows(data: np.ndarray) -> np.ndarray:
    """Consecutive windows, the last one padded with spaces: (n, WINDOW)."""
    n = -(-len(data) // WINDOW)
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def _sigmoid(x):
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    return np.add(x, 0.5, out=x)


@dataclass
class Model:
    """Weights of both directions: ``x`` (256, 3H) inputs by byte, ``u`` (H, 2H) gates, ``c`` (H, H) candidate; ``w`` (2H, C), ``b`` (C)."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 6) -> Model:
        rng = np.random.default_rng(seed)
        g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0] if len(s) > 1 and s[0] != 256 else 4)).astype(np.float32)
        w = {}
        for d in "fb":
            w |= {f"x{d}": g(256, 3 * hidden), f"u{d}": g(hidden, 2 * hidden), f"c{d}": g(hidden, hidden)}
        return cls(languages, w | {"w": g(2 * hidden, len(languages)), "b": np.zeros(len(languages), np.float32)})

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction over ``x`` (T, B); ``keep`` gets what the backward pass needs."""
        wx, u, c = (self.weights[k + d] for k in "xuc")
        hidden = len(c)
        n = x.shape[1]
        out = np.empty((len(x), n, hidden), np.float32)
        h = np.zeros((n, hidden), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            a = wx[x[t]]
            g = h @ u
            g += a[:, : 2 * hidden]
            _sigmoid(g)
            z, r = g[:, :hidden], g[:, hidden:]
            rh = r * h
            k = rh @ c
            k += a[:, 2 * hidden :]
            np.tanh(k, out=k)
            if keep is not None:
                keep.append((t, h, z, r, rh, k))
            h = h + z * (k - h)
            out[t] = h
        return out

    def positions(self, win: np.ndarray) -> np.ndarray:
        """Distribution of every position: (B, T, C)."""
        x = np.ascontiguousarray(win.T)
        hidden = len(self.weights["cf"])
        w = self.weights["w"]
        logits = self._run(x, "f") @ w[:hidden]
        logits += self._run(x, "b") @ w[hidden:]
        logits += self.weights["b"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits.transpose(1, 0, 2)

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """As ``_run``, for prediction: gates in arrays of their own, nothing kept."""
        hidden = len(self.weights["c" + d])
        wz, wr, wc = (np.ascontiguousarray(m) for m in np.split(self.weights["x" + d], 3, axis=1))
        uz, ur = (np.ascontiguousarray(m) for m in np.split(self.weights["u" + d], 2, axis=1))
        c = self.weights["c" + d]
        out = np.empty((*x.shape, hidden), np.float32)
        h = np.zeros((x.shape[1], hidden), np.float32)
        gate, part, k = (np.empty_like(h) for _ in range(3))
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.matmul(h, ur, out=gate)
            np.take(wr, x[t], axis=0, out=part, mode="clip")
            gate += part
            _sigmoid(gate)
            gate *= h
            np.matmul(gate, c, out=k)
            np.take(wc, x[t], axis=0, out=part, mode="clip")
            k += part
            np.tanh(k, out=k)
            np.matmul(h, uz, out=gate)
            np.take(wz, x[t], axis=0, out=part, mode="clip")
            gate += part
            _sigmoid(gate)
            k -= h
            k *= gate
            h = np.add(h, k, out=out[t])
        return out

    def pooled(self, win: np.ndarray, rows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the distributions over each window's letter positions, and their numbers."""
        sums = np.empty((len(win), len(self.languages)), np.float64)
        w, b, hidden = self.weights["w"], self.weights["b"], len(self.weights["cf"])
        ones = np.ones(len(b), np.float32)
        for i in range(0, len(win), rows):
            x = np.ascontiguousarray(win[i : i + rows].T).astype(np.intp)
            p = self._states(x, "f") @ w[:hidden]
            p += self._states(x, "b") @ w[hidden:]
            p += b  # states are within 1, so no overflow: no maximum is taken off
            np.exp(p, out=p)
            share = (x != 32).astype(np.float32) / (p @ ones)
            sums[i : i + rows] = np.einsum("tbc,tb->bc", p, share)
        return sums, (win != 32).sum(axis=1)

    def gradients(self, win: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over letter positions, and its gradients through time."""
        x = np.ascontiguousarray(win.T)
        w, hidden = self.weights, len(self.weights["cf"])
        kept = {d: [] for d in "fb"}
        states = {d: self._run(x, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logits = both @ w["w"] + w["b"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        weight = (x != 32).astype(np.float32)
        weight /= max(1.0, weight.sum())
        b = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, b, y] + 1e-9) * weight).sum())
        p[:, b, y] -= 1
        p *= weight[:, :, None]
        grads = {"w": np.einsum("tbh,tbc->hc", both, p), "b": p.sum(axis=(0, 1))}
        dstates = p @ w["w"].T
        for d, part in (("f", dstates[:, :, :hidden]), ("b", dstates[:, :, hidden:])):
            u, c = w["u" + d], w["c" + d]
            dx, du, dc = np.zeros_like(w["x" + d]), np.zeros_like(u), np.zeros_like(c)
            dh = np.zeros_like(part[0])
            for t, h, z, r, rh, k in reversed(kept[d]):
                dh = dh + part[t]
                dk = dh * z * (1 - k * k)
                drh = dk @ c.T
                dc += rh.T @ dk
                dg = np.concatenate([dh * (k - h) * z * (1 - z), drh * h * r * (1 - r)], axis=1)
                du += h.T @ dg
                np.add.at(dx, x[t], np.concatenate([dg, dk], axis=1))
                dh = dh * (1 - z) + drh * r + dg @ u.T
            grads |= {"x" + d: dx, "u" + d: du, "c" + d: dc}
        return loss, grads


def fit(win: np.ndarray, y: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 6) -> Model:
    """Adam on batches of equal shares of the languages."""
    model = Model.new(languages, seed=seed)
    rng = np.random.default_rng(seed)
    by = [np.flatnonzero(y == k) for k in range(len(languages))]
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, steps + 1):
        take = np.concatenate([rng.choice(i, max(1, BATCH // len(by))) for i in by])
        # a random cut before the window's start teaches the network short texts and any phase
        _, grads = model.gradients(np.roll(win[take], int(rng.integers(WINDOW)), axis=1), y[take])
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        for k, g in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, per_row: int = TRAIN_WINDOWS, seed: int = 6) -> Model:
    """A model from ``labelled`` (doc_id, text, lang): at most ``rows`` rows a language, those with the smallest digest of their id."""
    known = labelled.where("text is not null and lang is not null").where(F.regexp_like("text", F.lit(r"\p{L}")))
    order = Window.partitionBy("lang").orderBy(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed)))), "text")
    sample = known.select("doc_id", "text", "lang").withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= rows)

    def cut(batches):
        for batch in batches:
            langs, wins = [], []
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                all_ = windows(encode(text))
                for i in {round(j * (len(all_) - 1) / max(1, per_row - 1)) for j in range(per_row)}:
                    langs.append(lang)
                    wins.append(all_[i].tobytes())
            yield pa.record_batch({"lang": pa.array(langs, pa.string()), "win": pa.array(wins, pa.binary())})

    found = sorted((r.lang, bytes(r.win)) for r in sample.select("text", "lang").mapInArrow(cut, "lang string, win binary").collect())
    languages = sorted({lang for lang, _ in found})
    if not found:
        return Model([], {})
    win = np.frombuffer(b"".join(w for _, w in found), np.uint8).reshape(-1, WINDOW)
    return fit(win, np.array([languages.index(lang) for lang, _ in found]), languages, seed=seed)


def _predictions(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return langs, scores
    good = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    parts = [windows(encode(texts[i])) for i in good]
    if not parts:
        return langs, scores
    sums, letters = model.pooled(np.concatenate(parts))
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    total = np.add.reduceat(sums, first, axis=0) / np.maximum(1, np.add.reduceat(letters, first))[:, None]
    for i, p in zip(good, total, strict=True):
        k = int(np.argmax(p))
        langs[i], scores[i] = model.languages[k], float(min(1.0, p[k]))
    return langs, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in tokens.pieces(batches, most=2 << 20):
            langs, scores = _predictions(held.value, batch.column(at).to_pylist())
            yield pa.record_batch([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def label_positions(text: str, model: Model) -> list[tuple[int, int, str]]:
    """Runs (start byte, end byte, language) of equal labels over the letter positions of the lower-cased text."""
    data = encode(text)
    if not len(data) or not model.languages:
        return []
    best = model.positions(windows(data)).argmax(axis=2).reshape(-1)[: len(data)]
    best = np.where(data == 32, -1, best)
    cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
    return [(a, b, model.languages[best[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if best[a] >= 0]
