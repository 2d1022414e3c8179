"""Language of a text by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample (``per_lang`` documents a language) and then labels every byte position
of every whole text; a document's probabilities are the mean over its
positions.  Texts are read in windows of ``STEP`` bytes that run side by side,
so a long document is as parallel as many short ones.

Defined results: a null text or one without a letter is ``und`` with score 0;
null languages are never learnt from; with nothing to learn from, all rows are
``und``; further columns are ignored; repeated rows each get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import least_rows

STEP = 64
_LETTER = re.compile(r"[^\W\d_]")


class ByteGru:
    """Both directions as one stacked pair: arrays have a leading axis of 2."""

    def __init__(self, langs: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        scale = 1 / np.sqrt(hidden)
        self.p = {
            "x": rng.normal(0, 0.5, (2, 256, 3 * hidden)),
            "u": rng.normal(0, scale, (2, hidden, 3 * hidden)),
            "v": rng.normal(0, scale, (2, hidden, len(langs))),
            "b": np.zeros(len(langs)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, data: np.ndarray, keep: bool = False):
        """Hidden states (T, 2, B, H) of byte windows (B, T); the second runs backwards."""
        n, steps, h = data.shape[0], data.shape[1], self.hidden
        both = np.ascontiguousarray(np.stack((data, data[:, ::-1])).transpose(2, 0, 1))
        x, u = self.p["x"], self.p["u"]
        state = np.zeros((2, n, h), np.float32)
        out, gates = np.empty((steps, 2, n, h), np.float32), []
        xin = np.empty((2, n, 3 * h), np.float32)
        for t in range(steps):
            for side in (0, 1):
                np.take(x[side], both[t, side], axis=0, out=xin[side])
            a = np.matmul(state, u)
            zr = a[..., : 2 * h] + xin[..., : 2 * h]
            zr *= -1
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            z, r = zr[..., :h], zr[..., h:]
            m = a[..., 2 * h :]
            c = np.tanh(xin[..., 2 * h :] + r * m)
            new = c + z * (state - c)
            if keep:
                gates.append((state, z, r, m.copy(), c))
            state = new
            out[t] = state
        return out, gates, both

    def _logits(self, out: np.ndarray) -> np.ndarray:
        """(T, B, langs): the forward state at t and the backward state that has read from the end to t."""
        v = self.p["v"]
        return np.matmul(out[:, 0], v[0]) + np.matmul(out[::-1, 1], v[1]) + self.p["b"]

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(-1, keepdims=True))
        x /= x.sum(-1, keepdims=True)
        return x

    def label(self, data: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, langs) of every position of byte windows (B, T)."""
        return self._softmax(self._logits(self.states(data)[0]))

    def grads(self, data: np.ndarray, y: np.ndarray, mask: np.ndarray):
        out, gates, both = self.states(data, keep=True)
        prob = self._softmax(self._logits(out))
        n, steps, h = data.shape[0], data.shape[1], self.hidden
        w = (mask.T / max(1, mask.sum())).astype(np.float32)[..., None]
        loss = -float((np.log(prob[:, np.arange(n), y] + 1e-9) * w[..., 0]).sum())
        d = prob
        d[:, np.arange(n), y] -= 1
        d *= w
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["b"] = d.sum((0, 1))
        sides = (d, d[::-1])
        for s in (0, 1):
            g["v"][s] = np.einsum("tbh,tbc->hc", out[:, s], sides[s])
        u = self.p["u"]
        dh = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            prev, z, r, m, c = gates[t]
            for s in (0, 1):
                dh[s] += sides[s][t] @ self.p["v"][s].T
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (prev - c) * z * (1 - z)
            dr = dc * m * r * (1 - r)
            da = np.concatenate((dz, dr, dc * r), -1)
            dx = np.concatenate((dz, dr, dc), -1)
            for s in (0, 1):
                np.add.at(g["x"][s], both[t, s], dx[s])
                g["u"][s] += prev[s].T @ da[s]
            dh = dh * z + np.matmul(da, u.transpose(0, 2, 1))
        return loss, g

    def fit(self, data: np.ndarray, y: np.ndarray, mask: np.ndarray, steps: int, batch: int = 192, rate: float = 0.02, seed: int = 11) -> float:
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(data), batch)
            loss, g = self.grads(data[pick], y[pick], mask[pick])
            lr = rate * (1 - 0.9 * i / steps)
            for k in self.p:
                gk = np.clip(g[k], -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * gk
                m2[k] = 0.98 * m2[k] + 0.02 * gk * gk
                self.p[k] -= (lr * (m1[k] / (1 - 0.9**i)) / (np.sqrt(m2[k] / (1 - 0.98**i)) + 1e-6)).astype(np.float32)
        return loss


def windows(texts: list[bytes], step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All byte windows of the texts (zero-padded), the text of each, and its true length."""
    counts = np.array([(len(t) + step - 1) // step for t in texts], np.int64)
    total = int(counts.sum())
    flat = bytearray(total * step)
    at, size = 0, np.full(total, step, np.int64)
    row = 0
    for t, c in zip(texts, counts, strict=True):
        flat[at : at + len(t)] = t
        at += int(c) * step
        row += int(c)
        if c:
            size[row - 1] = len(t) - (int(c) - 1) * step
    return np.frombuffer(bytes(flat), np.uint8).reshape(total, step), np.repeat(np.arange(len(texts)), counts), size


def train(docs: DataFrame, per_lang: int = 400, per_text: int = 4, hidden: int = 8, steps: int = 260, seed: int = 5) -> ByteGru | None:
    """Fit on at most ``per_lang`` labelled texts of each language, those with the least hash of doc_id."""
    known = docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 <> 1").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ids = least_rows(known.dropDuplicates(["doc_id", "lang"]), "lang", ["h", "doc_id"], per_lang).select(F.col("doc_id").alias("_id")).distinct()
    # windows are cut where the texts are; of rows that share a doc_id one is learnt from
    spot = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.lit(1), F.char_length("text") - STEP // 2)) + 1
    cuts = F.array(*(F.substring("text", spot(k).cast("int"), F.lit(STEP)) for k in range(per_text)))
    own = docs.where("lang is not null and text is not null").select("doc_id", "lang", cuts.alias("cuts"))
    rows = own.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"), "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "cuts")).alias("r")).select("doc_id", "r.*").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    langs = sorted({r["lang"] for r in rows if any(_LETTER.search(c) for c in r["cuts"])})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    parts, y = [], []
    for r in rows:
        for k, piece in enumerate(r["cuts"]):
            if k == 0 and rng.random() < 0.3:
                piece = piece.upper()
            if _LETTER.search(piece):
                parts.append(piece.encode("utf-8", "replace")[:STEP])
                y.append(langs.index(r["lang"]))
    data, _, size = windows(parts)
    mask = np.arange(STEP)[None, :] < size[:, None]
    model = ByteGru(langs, hidden)
    model.fit(data, np.array(y), mask, steps)
    return model


def predict(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """(doc_id, lang_pred, score, n_bytes) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for low in range(0, len(pdf), 512):
                yield one(pdf.iloc[low : low + 512])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
        seen = [bool(model) and bool(_LETTER.search(t)) for t in texts]
        raw = [t.encode("utf-8", "replace") if s else b"" for t, s in zip(texts, seen, strict=True)]
        total = np.zeros((len(texts), len(model.langs) if model else 1))
        if model:
            data, owner, size = windows(raw)
            for at in range(0, len(data), 2048):
                prob = model.label(data[at : at + 2048])
                live = (np.arange(STEP)[:, None] < size[None, at : at + 2048]).astype(np.float32)
                np.add.at(total, owner[at : at + 2048], np.einsum("tbc,tb->bc", prob, live))
        share = total / np.maximum(total.sum(1, keepdims=True), 1e-12)
        best = share.argmax(1)
        return pd.DataFrame({
            "doc_id": pdf["doc_id"].to_numpy(),
            "lang_pred": [model.langs[b] if s else "und" for b, s in zip(best, seen, strict=True)],
            "score": [float(min(1.0, share[i, b])) if s else 0.0 for i, (b, s) in enumerate(zip(best, seen, strict=True))],
            "n_bytes": np.array([len(t.encode("utf-8", "replace")) for t in texts], np.int64),
        })

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double, n_bytes long")
