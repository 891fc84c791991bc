"""Document quality by a convolutional network over bytes, in numpy.

Learned filters of ``WIDTH`` bytes slide over chunks of ``CHUNK`` bytes; chunks overlap by ``WIDTH - 1``
bytes and cover the document whole. Each filter is max-pooled over a chunk; a hidden layer scores a chunk
and the document's probability is that of the mean over its chunks, weighted by their length.

For prediction the filters are folded into tables over pairs of bytes, so a position costs ``WIDTH / 2`` look-ups
instead of a matrix product.

The sample for training has at most ``PER_CLASS`` labelled documents of either label, outside the held-out
fold, by a hash of the id, whole (see ``sampling``): each step takes ``PIECES_A_STEP`` chunks of a document, from
anywhere in it or shorter. Weights decay, so that what few documents show counts for little. Only text goes into a score.

Defined cases: null and empty texts are scored as texts of no bytes; without labelled rows of both labels
every score is 1.0; very long texts are scored whole; a null doc_id counts as not held out and is not learned from;
repeated rows are reported each; other columns are kept, and a column that docs already have a name for gets
underscores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from paperledger.session import ship

from .adam import Adam
from .common import Text, chunks, table
from .sampling import labelled, remainder

WIDTH, CHUNK, FILTERS, EMBED, HIDDEN = 6, 1024, 16, 6, 12
PIECES_A_STEP, SHORT_SHARE, SHORTEST = 2, 0.5, 4
#: Each byte is a class of its own; the last one pads.
CLASSES, PAD = 257, 256
PER_CLASS, STEPS, BATCH, RATE, SEED = 1200, 900, 48, 0.01, 5
#: Share of the weights, but biases, that is added to their slopes: few labelled documents are bad ones, and alike.
DECAY = 3e-3
FOLDS, THRESHOLD = 5, 0.3
#: Bytes of text that are scored at a time: a byte takes the sums of all filters.
SCORED_BYTES = 1 << 18


def padded(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes with room behind each row for the last filter positions; the first filter position of
    each chunk, the row of each chunk and the number of filter positions of each."""
    size = np.diff(text.first)
    positions = np.maximum(size, 1)
    room = positions + WIDTH - 1
    start = np.concatenate(([0], np.cumsum(room)))
    out = np.full(start[-1] + 1, PAD, dtype=np.int32)
    if len(text.data):
        out[np.arange(len(text.data)) + np.repeat(start[:-1] - text.first[:-1], size)] = text.data
    count = -(-positions // CHUNK)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = start[row] + nth * CHUNK
    return out, begin, row, np.minimum(CHUNK, positions[row] - nth * CHUNK)


class Network:
    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        size = {"embed": (CLASSES, EMBED), "filters": (WIDTH * EMBED, FILTERS), "bias": (FILTERS,), "w1": (FILTERS, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, 1), "b2": (1,)}
        self.w = {k: (rng.standard_normal(s) * (0.5 if k == "embed" else 0 if k[0] == "b" else (1.0 / s[0]) ** 0.5)).astype(np.float32) for k, s in size.items()}

    def folded(self) -> list[np.ndarray]:
        """Tables over pairs of byte classes, two neighbouring filter positions each."""
        one = np.einsum("ce,kef->kcf", self.w["embed"], self.w["filters"].reshape(WIDTH, EMBED, FILTERS))
        return [np.ascontiguousarray((one[k][:, None] + one[k + 1][None]).reshape(CLASSES * CLASSES, FILTERS), dtype=np.float32) for k in range(0, WIDTH, 2)]

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hidden layer and the logit of each chunk."""
        relu = np.maximum(pooled + self.w["bias"], 0)
        hidden = np.tanh(relu @ self.w["w1"] + self.w["b1"])
        return relu, hidden, (hidden @ self.w["w2"] + self.w["b2"])[:, 0]

    def slopes(self, text: Text, owner: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients for a batch of documents. owner: the document of each piece of text."""
        data, begin, row, length = padded(text)
        at = np.minimum(begin[:, None] + np.arange(CHUNK), len(data) - WIDTH)
        window = at[:, :, None] + np.arange(WIDTH)
        seen = self.w["embed"][data[np.minimum(window, len(data) - 1)]].reshape(-1, WIDTH * EMBED)
        conv = (seen @ self.w["filters"]).reshape(len(begin), CHUNK, FILTERS)
        conv[np.arange(CHUNK) >= length[:, None]] = -1e9
        best = conv.argmax(axis=1)
        relu, hidden, logit = self.head(np.take_along_axis(conv, best[:, None], axis=1)[:, 0])
        doc = owner[row]
        weight = length / np.bincount(doc, length, len(label))[doc]
        p = 1 / (1 + np.exp(-np.bincount(doc, weight * logit, len(label))))
        d_logit = ((p - label)[doc] * weight / len(label)).astype(np.float32)[:, None]
        out = {"w2": hidden.T @ d_logit, "b2": d_logit.sum(axis=0)}
        d_hidden = d_logit @ self.w["w2"].T * (1 - hidden * hidden)
        out |= {"w1": relu.T @ d_hidden, "b1": d_hidden.sum(axis=0)}
        d_pool = (d_hidden @ self.w["w1"].T) * (relu > 0)
        out["bias"] = d_pool.sum(axis=0)
        top = np.take_along_axis(window, best[:, :, None], axis=1)  # chunk, filter, byte of the window
        what = data[np.minimum(top, len(data) - 1)]
        shown = self.w["embed"][what].reshape(len(begin), FILTERS, -1)
        out["filters"] = np.einsum("cfi,cf->if", shown, d_pool)
        d_seen = (d_pool[:, :, None] * self.w["filters"].T[None]).reshape(-1, EMBED)
        out["embed"] = np.zeros_like(self.w["embed"])
        np.add.at(out["embed"], what.ravel(), d_seen)
        return {k: v.astype(np.float32) for k, v in out.items()}


class Scorer:
    """A trained network with its folded tables."""

    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, net.folded()

    def __call__(self, text: Text) -> np.ndarray:
        """The probability of label 1 for each row."""
        data, begin, row, length = padded(text)
        pair = data[:-1] * CLASSES + data[1:]
        last = len(pair) - WIDTH + 2
        total = np.zeros((last + 1, FILTERS), dtype=np.float32)  # with a position more, where the last chunk may end
        for k, table in enumerate(self.tables):
            total[:last] += np.take(table, pair[2 * k : last + 2 * k], axis=0)
        # The positions between one row's last and the next row's first see two rows and are cut off.
        edges = np.column_stack((begin, begin + length)).ravel()
        pooled = np.maximum.reduceat(total, np.minimum(edges, last), axis=0)[::2]
        logit = self.net.head(pooled)[2]
        n = len(text)
        return 1 / (1 + np.exp(-np.bincount(row, length * logit, n) / np.bincount(row, length, n)))


def some_pieces(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """A few chunks of a text, from anywhere in it, half of them cut to parts of any order of length: short documents are few."""
    if len(text) <= CHUNK * PIECES_A_STEP:
        out = [text[i : i + CHUNK] for i in range(0, max(len(text), 1), CHUNK)]
    else:
        out = [text[i : i + CHUNK] for i in rng.integers(0, len(text) - CHUNK + 1, PIECES_A_STEP).tolist()]
    for i, piece in enumerate(out):
        if rng.random() < SHORT_SHARE:
            size = int(2 ** rng.uniform(SHORTEST, np.log2(CHUNK)))
            start = int(rng.integers(0, max(1, len(piece) - size + 1)))
            out[i] = piece[start : start + size]
    return out


def train(samples: list[tuple[bytes, int]]) -> Network:
    """samples: a document and its label. Batches hold as many documents of either label."""
    net, rng = Network(), np.random.default_rng(SEED)
    by = [np.array([i for i, (_, y) in enumerate(samples) if y == k]) for k in (0, 1)]
    adam = Adam(net.w, RATE)
    for step in range(STEPS):
        pick = np.concatenate([rng.choice(x, BATCH // 2) for x in by])
        some = [(d, piece) for d, i in enumerate(pick) for piece in some_pieces(samples[i][0], rng)]
        text = Text(np.frombuffer(b"".join(x for _, x in some), dtype=np.uint8), np.cumsum([0] + [len(x) for _, x in some]))
        slopes = net.slopes(text, np.array([d for d, _ in some]), np.repeat((0.0, 1.0), BATCH // 2))
        adam({k: g if k[0] == "b" else g + np.float32(DECAY) * net.w[k] for k, g in slopes.items()}, 1.0 if step < STEPS * 0.7 else 0.2)
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """None if labelled rows of both labels aren't there."""
    rows = labelled(docs, labels, "quality", FOLDS, PER_CLASS).select(F.xxhash64("doc_id").alias("h"), "label", "text")
    got = sorted((x["h"], x["label"], x["text"]) for x in rows.collect())
    samples = [(text.encode(), label) for _, label, text in got]
    return Scorer(train(samples)) if {y for _, y in samples} == {0, 1} else None


def score_batches(batches: Iterator[pa.RecordBatch], sent, name: str) -> Iterator[pa.RecordBatch]:
    """Adds a last column."""
    scorer = sent.value
    for batch in batches:
        for part, text in chunks(batch, size=SCORED_BYTES):
            score = scorer(text) if scorer else np.ones(len(text))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, name])


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """The rows of docs (doc_id, text and any others) with the score as a last column of that name, or the name with
    underscores where docs have it."""
    ship(docs.sparkSession)
    while name in docs.columns:
        name += "_"
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), labels))
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(lambda batches: score_batches(batches, sent, name), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    return scored(docs, table(spark, sf_dir, "labels")).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
