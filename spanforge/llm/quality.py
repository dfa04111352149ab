"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes slide over overlapping chunks that cover the whole text; each chunk keeps every
filter's largest response (max-pooling, ReLU); the chunks' mean goes through a logistic layer to one probability.
A filter on one-hot bytes is a sum of one table entry a byte, so two tables of byte pairs give all responses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import held_out, utf8_column

FILTERS, WIDTH, CHUNK, OVERLAP = 12, 4, 512, 32
#: The bound of what is learned: rows, and bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 3000
STEP_CHUNKS = 2000
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def chunks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (of the windows' first bytes) and text of each chunk; a text of n bytes has max(1, n - WIDTH + 1) windows."""
    windows = np.maximum(1, np.diff(offsets) - WIDTH + 1)
    stride = CHUNK - OVERLAP
    n = np.maximum(1, -(-(windows - OVERLAP) // stride))
    text = np.repeat(np.arange(len(windows)), n)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = within * stride
    return start, np.minimum(start + CHUNK, windows[text]), text


class ByteNet:
    """Parameters: ``filters`` [WIDTH, 256, FILTERS], ``bias`` [FILTERS], ``weights`` [FILTERS], ``base``."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.filters = r.normal(0, 0.3, (WIDTH, 256, FILTERS))
        self.bias, self.weights, self.base = np.zeros(FILTERS), r.normal(0, 0.5, FILTERS), 0.0

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        f = self.filters.astype(np.float32)
        return (f[0][:, None] + f[1][None]).reshape(65536, -1), (f[2][:, None] + f[3][None]).reshape(65536, -1)

    def probabilities(self, texts: list[np.ndarray], tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Of label 1, of each text (its bytes); an empty text counts as blanks."""
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        start, end, text = chunks(offsets)
        pooled = np.zeros((len(texts), FILTERS))
        for a in range(0, len(start), STEP_CHUNKS):
            b = min(a + STEP_CHUNKS, len(start))
            parts = [np.pad(p, (0, max(0, WIDTH - len(p))), constant_values=32) if len(p := texts[text[k]][start[k] : end[k] + WIDTH - 1]) < WIDTH else p for k in range(a, b)]
            sizes = np.array([len(p) for p in parts])
            joined = np.concatenate([*parts, np.zeros(WIDTH, np.uint8)]).astype(np.uint16)
            pair = (joined[:-1] << 8) | joined[1:]
            total = int(sizes.sum())
            heads = np.cumsum(sizes) - sizes
            response = tables[0][pair[:total]]
            response += tables[1][pair[2 : total + 2]]
            for k in range(1, WIDTH):  # windows that would reach into the next chunk
                response[np.cumsum(sizes) - k] = -np.inf
            most = np.maximum.reduceat(response, heads, axis=0) + self.bias
            np.add.at(pooled, text[a:b], np.maximum(most, 0))
        pooled /= np.bincount(text, minlength=len(texts))[:, None]
        return 1 / (1 + np.exp(-np.clip(pooled @ self.weights + self.base, -30, 30)))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 14, rate: float = 0.03, seed: int = 11) -> "ByteNet":
        """Adam on the log loss, classes weighted alike; deterministic."""
        r = np.random.default_rng(seed)
        share = labels.mean()
        cost = np.where(labels == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        params = [self.filters, self.bias, self.weights, np.array([self.base])]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), 32):
                grads = [np.zeros_like(p) for p in params]
                for i in order[a : a + 32]:
                    t = texts[i] if len(texts[i]) >= WIDTH else np.pad(texts[i], (0, WIDTH - len(texts[i])), constant_values=32)
                    start, end, _ = chunks(np.array([0, len(t)]))
                    windows = len(t) - WIDTH + 1
                    response = sum(self.filters[o][t[o : o + windows]] for o in range(WIDTH)) + self.bias
                    places = np.array([s + response[s:e].argmax(axis=0) for s, e in zip(start, end)])
                    most = np.take_along_axis(response, places, axis=0)
                    pooled = np.maximum(most, 0).mean(axis=0)
                    p = 1 / (1 + np.exp(-np.clip(pooled @ self.weights + params[3][0], -30, 30)))
                    g = (p - labels[i]) * cost[i]
                    grads[2] += g * pooled
                    grads[3] += g
                    back = g * self.weights * (most > 0) / len(start)
                    grads[1] += back.sum(axis=0)
                    for o in range(WIDTH):
                        np.add.at(grads[0][o], (t[places + o], np.arange(FILTERS)[None, :]), back)
                step += 1
                for p, g, m, v in zip(params, grads, first, second):
                    g = g / 32 + 1e-5 * p
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.base = float(params[3][0])
        return self


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> ByteNet:
    """Fit on at most ``rows`` labelled rows (first by hash of the id), ``size`` bytes of each, none held out."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    half = [marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2).collect() for q in (0, 1)]
    label = {r.doc_id: r.quality for part in half for r in part}
    found = docs.where(F.col("doc_id").isin(list(label))).groupBy("doc_id").agg(F.min(F.substring("text", 1, size)).alias("text")).collect() if label else []
    found = sorted((r for r in found if r.text), key=lambda r: r.doc_id)
    net = ByteNet()
    if found:
        net.fit([np.frombuffer(r.text.encode()[:size], np.uint8) for r in found], np.array([label[r.doc_id] for r in found], float))
    return net


def score(docs: DataFrame, net: ByteNet) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row's whole text.

    A null text counts as empty, an empty one as four blanks. Repeated rows give repeated results, an empty table
    none; other columns are ignored. Without labelled rows the network stays at its first values.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = own.tables()
        for batch in batches:
            data, offsets = utf8_column(batch.column(2))
            texts = [data[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
            found = own.probabilities(texts, tables) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text")).mapInArrow(run, SCHEMA)
