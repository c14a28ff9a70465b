"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (3 to 5, with its ends marked) and of
itself; an over-long run counts as several words, its overlapping pieces; a segment is the mean of its
words; a linear softmax on a segment gives its class. A text scores
as its most toxic segment, so a few words in a long text are not averaged away. Unseen misspellings
share n-gram vectors with the words they come from.

As all steps up to the softmax are linear, a word's share in the softmax's difference is one number;
scoring keeps that number for each word it has met.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import read_table, small_batches, text_or_empty
from siftwell.llm.labelled import crc_of_id, sample

#: Rows of each class that the model is fitted on, at most.
PER_CLASS = 2500
BUCKETS = 1 << 18
#: An n-gram takes part if it is in so many of the texts fitted on; rarer ones would only be learned by heart.
LEAST_TEXTS = 5
DIM = 8
#: Words of a segment; segments overlap by half.
SEGMENT = 16
THRESHOLD = 0.7
#: Characters of a longest word. Of a longer run, pieces of ``PIECE`` characters count as words, so that memory is bounded.
RUN = 62
PIECE = 10
_MEMO = 400_000
_WORD = re.compile(r"\w+")


def parts(run: str) -> list[str | tuple[int, str]]:
    """A word as it is; an over-long run as its bucket with each of its pieces, which overlap so that every n-gram is in one."""
    if len(run) <= RUN:
        return [run]
    marked = f"<{run}>"
    whole = zlib.crc32(marked.encode("utf-8", "surrogatepass")) % BUCKETS
    return [(whole, marked[i : i + PIECE]) for i in range(0, len(marked) - 4, PIECE - 4)]


def _crc_table() -> np.ndarray:
    """CRC-32's step for each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_STEP = _crc_table()


def bags(words: list[str | tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams in a row, word after word, and how many each word has.

    A word's bag is itself and its n-grams; a piece's is its run and the n-grams of the piece. The CRC-32 of
    all n-grams is worked out together: one step for each byte of the character that an n-gram grows by.
    """
    whole, marked = [], []
    for w in words:
        if isinstance(w, tuple):
            whole.append(w[0])
            marked.append(w[1])
        else:
            marked.append(f"<{w}>")
            whole.append(zlib.crc32(marked[-1].encode("utf-8", "surrogatepass")) % BUCKETS)
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    sizes = np.array([*map(len, marked)], np.int64)
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.repeat(np.cumsum(sizes), sizes)
    width = np.searchsorted(np.array([0x80, 0x800, 0x10000], np.uint32), chars, "right") + 1
    wide = int(width.max(initial=1))
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[width] if wide > 1 else None

    def after(state: np.ndarray, at: np.ndarray) -> np.ndarray:
        if wide == 1:
            return _STEP[(state ^ chars[at]) & 0xFF] ^ state >> np.uint32(8)
        for k in range(wide):
            left = width[at] - 1 - k  # bytes of the character that follow this one
            byte = chars[at] >> (6 * np.maximum(left, 0)).astype(np.uint32)
            byte = np.where(k == 0, byte | lead[at], byte & 0x3F | 0x80).astype(np.uint32)
            state = np.where(left >= 0, _STEP[(state ^ byte) & 0xFF] ^ state >> np.uint32(8), state)
        return state

    at = np.arange(len(chars))
    state = np.full(len(chars), 0xFFFFFFFF, np.uint32)
    word_of = np.repeat(np.arange(len(words)), sizes)
    found, owner = [np.array(whole, np.int64)], [np.arange(len(words))]
    for n in range(1, 6):
        more = at + n <= ends[at]
        at, state = at[more], state[more]
        state = after(state, at + n - 1)
        if n >= 3:
            found.append((~state % BUCKETS).astype(np.int64))
            owner.append(word_of[at])
    own = np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return np.concatenate(found)[order].astype(np.int32), np.bincount(own, minlength=len(words)).astype(np.int32)


def _all_bags(words: list[str | tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """``bags`` of any number of words, worked out by parts."""
    parts = [bags(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
    return np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])


def grams(word: str | tuple[int, str]) -> list[int]:
    """Buckets of one word's bag."""
    return bags([word])[0].tolist()


def segments(values: np.ndarray) -> np.ndarray:
    """Mean over each segment; a short text is one segment."""
    n = len(values)
    if n <= SEGMENT:
        return np.array([values.mean()]) if n else np.zeros(1)
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    start = np.append(np.arange(0, n - SEGMENT, SEGMENT // 2), n - SEGMENT)
    return (total[start + SEGMENT] - total[start]) / SEGMENT


@dataclass
class Model:
    embedding: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray

    known: np.ndarray  # which n-grams take part

    def shares(self) -> np.ndarray:
        """What each n-gram adds to the softmax's difference; nothing for one that takes no part."""
        return np.where(self.known, self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0]), 0).astype(np.float64)

    def word_values(self, words: list[str | tuple[int, str]], shares: np.ndarray | None = None) -> np.ndarray:
        """Each word's share: the mean over those of its n-grams that take part."""
        shares = self.shares() if shares is None else shares
        gram, size = bags(words)
        word = np.repeat(np.arange(len(words)), size)
        n = np.bincount(word, self.known[gram], len(words))
        return np.bincount(word, shares[gram], len(words)) / np.maximum(n, 1)

    def word_value(self, word: str | tuple[int, str]) -> float:
        return float(self.word_values([word])[0])

    def margin(self, values: list[float]) -> float:
        return float(segments(np.array(values)).max() + self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], counts: dict[int, int], rounds: int = 160, warm: int = 25, rate: float = 0.05, decay: float = 1e-5, tilt: float = 3.0, seed: int = 7) -> Model:
    """Full-batch Adam. For ``warm`` rounds every segment carries its text's label, then only the most toxic one does.

    Classes weigh as much as they have rows in the corpus, toxic ones ``tilt`` times that, as a missed one
    costs more. Without rows of both classes the model gives the prior.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32), np.zeros(BUCKETS, bool))
    total = sum(counts.values())
    if len(set(labels)) < 2:
        p = (counts.get(1, 0) + 0.5) / (total + 1)
        model.embedding[:] = 0
        model.bias[1] = np.log(p / (1 - p))
        return model
    number: dict[str | tuple[int, str], int] = {}
    # Flat arrays throughout: this runs on the driver.
    words, seg_start, doc_start = array("i"), array("i"), array("i")
    for t in texts:
        ids = array("i", [number.setdefault(w, len(number)) for run in _WORD.findall(t.lower()) for w in parts(run)] or [number.setdefault("", len(number))])
        doc_start.append(len(seg_start))
        for a in range(0, max(1, len(ids) - SEGMENT // 2), SEGMENT // 2):
            seg_start.append(len(words))
            words.extend(ids[a : a + SEGMENT])
    word, seg_start, doc_start = (np.frombuffer(x, np.int32) for x in (words, seg_start, doc_start))
    seg_len = np.diff(np.append(seg_start, len(word)))
    of_doc = np.repeat(np.arange(len(doc_start), dtype=np.int32), np.diff(np.append(doc_start, len(seg_start))))
    gram, bag_len = _all_bags(list(number))
    bag_start = np.append(0, np.cumsum(bag_len))
    in_texts = np.zeros(BUCKETS, np.int32)
    seg_end, doc_end = np.append(seg_start[1:], len(word)), np.append(doc_start[1:], len(seg_start))
    for a, z in zip(doc_start, doc_end, strict=True):
        own = np.unique(word[seg_start[a] : seg_end[z - 1]])
        in_texts[np.unique(np.concatenate([gram[bag_start[w] : bag_start[w + 1]] for w in own]))] += 1
    model.known = in_texts >= min(LEAST_TEXTS, 1 + len(texts) // 20)
    # From here on only the n-grams that take part have rows.
    rows = np.flatnonzero(model.known)
    use = model.known[gram]
    bags_n = len(bag_len)
    of_bag = np.repeat(np.arange(bags_n, dtype=np.int32), bag_len)[use]
    gram = (np.cumsum(model.known, dtype=np.int32) - 1)[gram[use]]
    bag_len = np.maximum(np.bincount(of_bag, minlength=bags_n), 1)
    embedding = model.embedding[rows]
    del number
    y = np.array(labels, np.float32)
    have = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, tilt * counts[1] / have[1], counts[0] / have[0]) / total
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (embedding, model.softmax, model.bias)]
    for step in range(1, rounds + 1):
        theta = model.softmax[:, 1] - model.softmax[:, 0]
        by_word = np.bincount(of_bag, (embedding @ theta)[gram], bags_n) / bag_len
        margin = np.add.reduceat(by_word.astype(np.float32)[word], seg_start) / seg_len + (model.bias[1] - model.bias[0])
        if step <= warm:
            chosen = np.arange(len(margin))
            pull = (1 / (1 + np.exp(-margin)) - y[of_doc]) * (weight / np.bincount(of_doc))[of_doc]
        else:
            top = np.maximum.reduceat(margin, doc_start)
            chosen = np.full(len(doc_start), len(margin))
            hit = np.flatnonzero(margin == top[of_doc])
            np.minimum.at(chosen, of_doc[hit], hit)
            pull = (1 / (1 + np.exp(-top)) - y) * weight
        on_word = np.zeros(bags_n)
        for k in range(0, len(chosen), 20_000):  # bounds what is copied at a time
            some = chosen[k : k + 20_000]
            size = seg_len[some]
            at = np.repeat(seg_start[some] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            on_word += np.bincount(word[at], np.repeat(pull[k : k + 20_000] / size, size), bags_n)
        on_gram = np.bincount(gram, (on_word / bag_len)[of_bag], len(rows)).astype(np.float32)
        on_theta = on_gram @ embedding + 1e-5 * theta
        slope = [on_gram[:, None] * theta + decay * embedding, np.stack([-on_theta, on_theta], 1), np.array([-pull.sum(), pull.sum()], np.float32)]
        for p, g, (m, v) in zip((embedding, model.softmax, model.bias), slope, state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.embedding[rows] = embedding
    return model


class Scorer:
    """What workers need of a model: each n-gram's share. Words that were met keep their value."""

    def __init__(self, model: Model):
        self.known, self.shares = model.known, model.shares().astype(np.float32)
        self.base = float(model.bias[1] - model.bias[0])
        self.name = zlib.crc32(self.shares.tobytes() + self.known.tobytes())

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        memo = _memo(self.name)
        out = np.empty(len(texts))
        for a, b in small_batches([t or "" for t in texts], 2_000_000):
            cut = [_WORD.findall((t or "").lower()) for t in texts[a:b]]
            cut = [[p for w in words for p in parts(w)] if words and len(max(words, key=len)) > RUN else words for words in cut]
            need = set(chain.from_iterable(cut))
            if len(memo) + len(need) > _MEMO:
                memo.clear()
            new = list(need.difference(memo))
            for k in range(0, len(new), 20_000):
                some = new[k : k + 20_000]
                memo.update(zip(some, self._values(some).tolist(), strict=True))
            for i, words in enumerate(cut, a):
                out[i] = segments(np.array([*map(memo.__getitem__, words)])).max() + self.base
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

    def _values(self, words: list) -> np.ndarray:
        gram, size = bags(words)
        word = np.repeat(np.arange(len(words)), size)
        return np.bincount(word, self.shares[gram], len(words)) / np.maximum(np.bincount(word, self.known[gram], len(words)), 1)


_MEMOS: dict[int, dict] = {}


def _memo(name: int) -> dict:
    """A worker's values for one model; they live on from task to task."""
    if name not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[name] = {}
    return _MEMOS[name]


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` for every row; a null or empty text scores as one empty segment.

    Rows are independent: repeated rows come out as often as they are there, rows with a null id too; other
    columns are ignored. The model has a fixed size, whatever the corpus, and goes to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.probabilities(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, learn) -> Model:
    """Fitted on ``sample``'s rows; without labels of both classes the model gives the prior."""
    return train(*sample(docs, labels, "toxic", learn, PER_CLASS))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, unchanged and with all columns, that score under ``threshold``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(Scorer(model)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.probabilities(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = crc_of_id() % 3 == 1
    scored = score(docs, fit(docs, labels, ~held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
