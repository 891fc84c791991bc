"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of ``SPAN`` bytes; it gives
every byte of a text a probability for each language, and a document the mean over its bytes. A text is
cut into windows that cover it whole; the windows of many texts run side by side.

The sample for training has at most ``PER_LANG`` documents of each language, by a hash of the id, found in one pass
over ids and languages and then read once, whole (see ``sampling``). All languages are learned, those after the
``FIRST_LANGS`` most frequent in the sample from ``LEAST_DOCS`` documents on; a language of fewer has no class, and its
documents get that of the nearest one. Rows without lang or of the held-out fold are never learned from; only text
goes into a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; if nothing can be learned
(an empty table, no lang) every text is ``und``; of languages with equal probability the first by name is taken; very
long texts are labelled whole; a null doc_id counts as not held out and is not learned from; repeated rows are reported
each; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperledger.session import ship

from .adam import Adam
from .common import Text, chunks, table
from .sampling import MOST_CHARS, first_rows, remainder

SPAN, HIDDEN, LANES = 64, 8, 1024
PER_LANG, FIRST_LANGS, LEAST_DOCS = 300, 64, 5
STEPS, BATCH, RATE, SEED = 220, 96, 0.02, 7
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


class Network:
    """Weights of the two directions (f and b) and of the output layer; classes are languages."""

    def __init__(self, langs: list[str]) -> None:
        rng = np.random.default_rng(SEED)
        self.langs = langs
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = (rng.standard_normal((256, 3 * HIDDEN)) * 0.3).astype(np.float32)
            self.w["h" + d] = (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / HIDDEN**0.5).astype(np.float32)
            self.w["o" + d] = (rng.standard_normal((HIDDEN, len(langs))) * 0.3).astype(np.float32)
        self.w["bias"] = np.zeros(len(langs), dtype=np.float32)

    def run(self, d: str, data: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each byte of one direction. data: (SPAN, lanes)."""
        x, u = self.w["x" + d], self.w["h" + d]
        span, lanes = data.shape
        out = np.empty((span, lanes, HIDDEN), dtype=np.float32)
        h, trace = np.zeros((lanes, HIDDEN), dtype=np.float32), []
        for t in range(span) if d == "f" else range(span - 1, -1, -1):
            g, a = x[data[t]], h @ u
            gates = g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
            if keep:
                trace.append((t, h, z, r, n, a[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            out[t] = h
        return out, trace

    def probabilities(self, data: np.ndarray) -> np.ndarray:
        """(SPAN, lanes, languages): the label probabilities of every byte."""
        y = self.run("f", data)[0] @ self.w["of"]
        y += self.run("b", data)[0] @ self.w["ob"]
        y += self.w["bias"]
        y -= y.max(axis=2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=2, keepdims=True)
        return y

    def slopes(self, data: np.ndarray, lang: np.ndarray, real: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over the real bytes, back through time."""
        states = {d: self.run(d, data, keep=True) for d in "fb"}
        y = states["f"][0] @ self.w["of"] + states["b"][0] @ self.w["ob"] + self.w["bias"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        y[:, np.arange(len(lang)), lang] -= 1
        y *= (real / real.sum())[:, :, None].astype(np.float32)
        out = {"bias": y.sum(axis=(0, 1))}
        for d, (h_all, trace) in states.items():
            u, flat = self.w["h" + d], y.reshape(-1, y.shape[2])
            out["o" + d] = h_all.reshape(-1, HIDDEN).T @ flat
            into = y @ self.w["o" + d].T
            dx, du, dh = np.zeros_like(self.w["x" + d]), np.zeros_like(u), np.zeros_like(trace[0][1])
            for t, h, z, r, n, a in reversed(trace):
                dh = dh + into[t]
                dn = dh * (1 - z) * (1 - n * n)
                dg = np.concatenate([dh * (h - n) * z * (1 - z), dn * a * r * (1 - r), dn], axis=1)
                da = dg.copy()
                da[:, 2 * HIDDEN :] = dn * r
                np.add.at(dx, data[t], dg)
                du += h.T @ da
                dh = dh * z + da @ u.T
            out["x" + d], out["h" + d] = dx, du
        return out


def train(samples: list[tuple[str, bytes]], langs: list[str]) -> Network:
    """samples: language and a text. Each step takes a window of a text of each language, from anywhere in it."""
    net, rng = Network(langs), np.random.default_rng(SEED)
    lang = np.array([langs.index(x) for x, _ in samples])
    by = [np.flatnonzero(lang == k) for k in range(len(langs))]
    adam = Adam(net.w, RATE)
    # Where a batch can't hold all languages they take turns, in as many more steps.
    steps = STEPS * -(-len(langs) // BATCH)
    for step in range(steps):
        turn = step * BATCH if len(langs) > BATCH else 0
        pick = np.array([rng.choice(by[(turn + k) % len(langs)]) for k in range(BATCH)])
        data, real = np.zeros((SPAN, BATCH), dtype=np.uint8), np.zeros((SPAN, BATCH), dtype=np.float32)
        for lane, i in enumerate(pick):
            piece = samples[i][1]
            start = rng.integers(0, max(1, len(piece) - SPAN + 1))
            cut = np.frombuffer(piece[start : start + SPAN], dtype=np.uint8)
            data[: len(cut), lane], real[: len(cut), lane] = cut, 1
        adam(net.slopes(data, lang[pick], real), 1.0 if step < steps * 0.6 else 0.25)
    return net


def windows(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, SPAN) bytes, the number of real bytes of each window and its row; they cover every text whole."""
    size = np.diff(text.first)
    count = -(-size // SPAN)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = text.first[row] + nth * SPAN
    length = np.minimum(SPAN, text.first[row + 1] - begin)
    at = begin[:, None] + np.arange(SPAN)
    inside = np.arange(SPAN) < length[:, None]
    padded = np.append(text.data, np.uint8(0))
    return np.where(inside, padded[np.where(inside, at, 0)], 0).astype(np.uint8), length, row


def has_letter(raw: bytes) -> bool:
    if any(0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A for c in raw[:64]):
        return True
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def label_positions(net: Network, text: Text) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of windows: rows, real lengths, and (SPAN, lanes, languages) probabilities of every byte."""
    data, length, row = windows(text)
    lanes = max(1, LANES * FIRST_LANGS // max(FIRST_LANGS, len(net.langs)))
    for i in range(0, len(row), lanes):
        yield row[i : i + lanes], length[i : i + lanes], net.probabilities(np.ascontiguousarray(data[i : i + lanes].T))


def predict(net: Network, text: Text) -> tuple[np.ndarray, np.ndarray]:
    """The language index (-1: none) and its pooled probability for each row."""
    total = np.zeros((len(text), len(net.langs)))
    for row, length, p in label_positions(net, text):
        real = (np.arange(SPAN)[:, None] < length).astype(np.float32)
        np.add.at(total, row, np.einsum("tlk,tl->lk", p, real))
    best = total.argmax(axis=1)
    size = np.maximum(np.diff(text.first), 1)
    score = np.clip(total[np.arange(len(text)), best] / size, 0, 1)
    for i in range(len(text)):
        if not has_letter(text.row(i)):
            best[i], score[i] = -1, 0
    return best, score


def predict_batches(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    net = sent.value
    names = [*(net.langs if net else []), UNKNOWN]
    for batch in batches:
        for part, text in chunks(batch):
            best, score = predict(net, text) if net else (np.full(len(text), -1), np.zeros(len(text)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([names[k] for k in best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])


def fit(docs: DataFrame) -> Network | None:
    """docs: doc_id, text, lang. None if there is nothing to learn from."""
    known = docs.where((remainder(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull())
    # At most PER_LANG rows of each language, of ids.
    chosen = first_rows(known.select("doc_id", "lang"), "lang", PER_LANG).collect()
    size = Counter(x["lang"] for x in chosen)
    ranked = sorted(size, key=lambda x: (-size[x], x))
    langs = {x for i, x in enumerate(ranked) if i < FIRST_LANGS or size[x] >= LEAST_DOCS}
    if not langs:
        return None
    ids = docs.sparkSession.createDataFrame(sorted({(x["doc_id"], x["lang"]) for x in chosen if x["lang"] in langs}), "doc_id long, lang string")
    rows = known.where(F.length("text") <= MOST_CHARS).join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", F.xxhash64("doc_id").alias("h"), "text")
    got = sorted((x["h"], x["lang"], x["text"]) for x in rows.collect() if has_letter(x["text"].encode()))
    samples = [(lang, text.encode()) for _, lang, text in got]
    learned = sorted({x for x, _ in samples})
    return train(samples, learned) if learned else None


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of (doc_id, text, lang)."""
    ship(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(fit(slim))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return slim.select("doc_id", "text", held.alias("held_out")).mapInArrow(lambda batches: predict_batches(batches, sent), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
