"""Quality by a byte-level convolutional network in numpy.

Bytes have learned embeddings; learned filters run over windows of bytes; each chunk of the text (chunks
overlap and together cover all of it) keeps the largest response of every filter; the chunks' maxima are
averaged and, with their overall maximum, combined into one probability. Trained by backpropagation
through the windows that gave the maxima.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import read_table, text_or_empty
from siftwell.llm.labelled import crc_of_id, sample

#: Rows of each class that the model is fitted on, at most.
PER_CLASS = 1200
DIM, WIDTH, STRIDE, FILTERS = 6, 10, 5, 24
#: Windows of a chunk, and by how many the next chunk starts later.
CHUNK, HOP = 192, 160
THRESHOLD = 0.3
#: Chunks of a text that are worked out together.
TOGETHER = 400


@dataclass
class Model:
    embedding: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    shift: np.ndarray  # FILTERS
    mean_weight: np.ndarray  # FILTERS
    max_weight: np.ndarray  # FILTERS
    bias: np.ndarray  # 1

    def windows(self, raw: np.ndarray) -> np.ndarray:
        """All windows of a text as rows; the last one is padded by zero bytes."""
        n = windows_of(len(raw))
        need = (n - 1) * STRIDE + WIDTH
        if need > len(raw):
            raw = np.concatenate([raw, np.zeros(need - len(raw), np.uint8)])
        flat = self.embedding[raw[:need]].ravel()
        return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * DIM), (flat.itemsize * DIM * STRIDE, flat.itemsize))

    def chunk_maxima(self, raw: np.ndarray, where: bool = False):
        """Each chunk's largest responses, and with ``where`` the windows that gave them."""
        response = self.windows(raw) @ self.filters
        starts = chunk_starts(len(response))
        best = np.stack([response[s : s + CHUNK].max(axis=0) for s in starts])
        return (best, np.stack([s + response[s : s + CHUNK].argmax(axis=0) for s in starts])) if where else best

    def margin(self, text: str) -> float:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        starts, last = chunk_starts(windows_of(len(raw))), windows_of(len(raw))
        best = np.empty((len(starts), FILTERS), np.float32)
        # Chunks are those of the whole text; only so many are worked out at a time, to bound memory.
        for lo in range(0, len(starts), TOGETHER):
            some = starts[lo : lo + TOGETHER]
            stop = min(some[-1] + CHUNK, last)
            response = self.windows(raw[some[0] * STRIDE : (stop - 1) * STRIDE + WIDTH]) @ self.filters
            for k, s in enumerate(some, lo):
                best[k] = response[s - some[0] : s - some[0] + CHUNK].max(axis=0)
        best = np.maximum(best + self.shift, 0)
        return float(best.mean(axis=0, dtype=np.float64) @ self.mean_weight + best.max(axis=0) @ self.max_weight + self.bias[0])


def windows_of(size: int) -> int:
    """Windows that cover so many bytes; no bytes have one window of padding."""
    return max(1, -(-max(0, size - WIDTH) // STRIDE) + 1)


def chunk_starts(windows: int) -> list[int]:
    """Overlapping chunks that cover all windows."""
    return [0, *range(HOP, max(HOP, windows - (CHUNK - HOP)), HOP)] if windows > CHUNK else [0]


def train(texts: list[str], labels: list[int], counts: dict[int, int], epochs: int = 8, batch: int = 16, rate: float = 0.01, seed: int = 3) -> Model:
    """Adam on small batches; classes weigh as much as they have rows. Without rows of both classes: the prior."""
    rng = np.random.default_rng(seed)
    f32 = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    m = Model(f32(256, DIM, s=0.5), f32(WIDTH * DIM, FILTERS, s=0.15), np.zeros(FILTERS, np.float32), f32(FILTERS, s=0.1), f32(FILTERS, s=0.1), np.zeros(1, np.float32))
    total = sum(counts.values())
    prior = (counts.get(1, 0) + 0.5) / (total + 1)
    m.bias[0] = np.log(prior / (1 - prior))
    if len(set(labels)) < 2:
        m.mean_weight[:] = m.max_weight[:] = 0
        return m
    raws = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    have = np.bincount(labels, minlength=2)
    weight = [counts[c] / have[c] / total * len(labels) for c in (0, 1)]
    params = [getattr(m, f.name) for f in fields(m)]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(raws))
        for lo in range(0, len(order), batch):
            grads = [np.zeros_like(p) for p in params]
            ge, gf, gs, gm, gx, gb = grads
            for d in order[lo : lo + batch]:
                best, at = m.chunk_maxima(raws[d], where=True)
                act = np.maximum(best + m.shift, 0)
                mean, top, arg = act.mean(axis=0), act.max(axis=0), act.argmax(axis=0)
                z = float(mean @ m.mean_weight + top @ m.max_weight + m.bias[0])
                pull = np.float32((1 / (1 + np.exp(-np.clip(z, -60, 60))) - labels[d]) * weight[labels[d]] / batch)
                gm += pull * mean
                gx += pull * top
                gb += pull
                on = np.tile(pull * m.mean_weight / len(best), (len(best), 1))
                on[arg, np.arange(FILTERS)] += pull * m.max_weight
                on *= best + m.shift > 0
                gs += on.sum(axis=0)
                windows = m.windows(raws[d])
                used, back = np.unique(at, return_inverse=True)
                on_window = np.zeros((len(used), FILTERS), np.float32)
                np.add.at(on_window, (back.reshape(at.shape), np.arange(FILTERS)), on)
                gf += windows[used].T @ on_window
                on_bytes = (on_window @ m.filters.T).reshape(-1, WIDTH, DIM)
                place = used[:, None] * STRIDE + np.arange(WIDTH)
                inside = place < len(raws[d])
                byte = np.where(inside, raws[d][np.minimum(place, max(0, len(raws[d]) - 1))] if len(raws[d]) else 0, 0)
                np.add.at(ge, byte.ravel(), on_bytes.reshape(-1, DIM))
            step += 1
            pace = rate * (1 - 0.9 * epoch / epochs)
            for p, g, (a, v) in zip(params, grads, state, strict=True):
                a += 0.1 * (g - a)
                v += 0.01 * (g * g - v)
                p -= pace * (a / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return m


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row; a null or empty text is one window of padding.

    Rows are independent: repeated rows come out as often as they are there, rows with a null id too; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z = np.array([m.margin(t) for t in batch.column(1).to_pylist()], np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, learn) -> Model:
    """Fitted on ``sample``'s rows; without labels of both classes the model gives the prior."""
    return train(*sample(docs, labels, "quality", learn, PER_CLASS))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = crc_of_id() % 5 == 0
    scored = score(docs, fit(docs, labels, ~held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
