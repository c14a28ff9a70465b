"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (lower case, cut at white space), weighted by how often they occur. For each
of ``SAMPLES`` samples every weighted term gets a value from gamma and uniform variates that depend only
on the term and the sample; the term with the least value, with its quantised weight, is the sample.
Two texts agree on a sample with a probability equal to the generalised Jaccard similarity of their
weighted terms (sum of minima over sum of maxima), so the share of samples that agree estimates it.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import partitions, read_table, small_batches, text_or_empty

#: Samples of a fingerprint; the likeness has a standard error of at most 0.5 / sqrt(SAMPLES).
SAMPLES = 128
#: Weighted terms of one block in memory, so that a very long text is worked off in blocks.
BLOCK = 65_536
#: Weighted terms whose values are worked out together, so that they stay in the processor's cache.
ROWS = 192
_MEMO = 300_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: uniform bits from a counter."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _units(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers in (0, 1) from 64 bits: the upper and the lower half."""
    halves = bits.view("<u4").reshape(*bits.shape, 2)
    scaled = halves.astype(np.float32)
    scaled += np.float32(0.5)
    scaled *= np.float32(2.0**-32)
    return scaled[..., 1], scaled[..., 0]


_LOW, _HALF = np.uint64(0xFFFFFFFF), np.uint64(32)
_SEEDS = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _variates(terms: np.ndarray, samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2,1) rate r, log of a gamma(2,1) value c, uniform beta for terms and sample seeds that broadcast."""
    a = _mix(terms ^ samples)
    b = _mix(a + np.uint64(0x9E3779B97F4A7C15))
    c = _mix(b + np.uint64(0x9E3779B97F4A7C15))
    gamma = lambda bits: np.maximum(-np.log(np.multiply(*_units(bits))), np.float32(1e-6))
    return gamma(a), np.log(gamma(b)), _units(c)[0]


def _level(log_w: np.ndarray, rate: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return np.floor(log_w / rate + beta)


class Sampler:
    def __init__(self) -> None:
        self.memo: dict[str, int] = {}
        self.before = np.zeros(0, np.uint64), np.zeros((0, SAMPLES), np.uint64)  # pairs of the last batch and their values

    def _hashes(self, words: Counter) -> list[int]:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return [*map(memo.__getitem__, words)]

    def signatures(self, texts: list[str]) -> np.ndarray:
        """``len(texts) x SAMPLES`` numbers of 16 bits; 0 throughout for a text without terms, never 0 else."""
        out = np.zeros((len(texts), SAMPLES), np.uint16)
        for a, b in small_batches(texts, 1_000_000):
            self._batch(texts[a:b], out[a:b])
        return out

    def _batch(self, texts: list[str], out: np.ndarray) -> None:
        hashes: list[int] = []
        weights: list[int] = []
        starts = [0]
        for t in texts:
            terms = Counter(t.lower().split())
            hashes += self._hashes(terms)
            weights += terms.values()
            starts.append(len(hashes))
        if not hashes:
            return
        h, w = np.array(hashes, np.uint64), np.array(weights, np.uint64)
        # Equal (term, weight) pairs get one row; rows stand in an order that depends on the pair alone, so ties break alike everywhere.
        keys, first, row = np.unique(h ^ _mix(w), return_index=True, return_inverse=True)
        h, log_w = h[first], np.log(w[first].astype(np.float32))
        at = np.array(starts)
        best = np.full((len(texts), SAMPLES), np.uint64(0xFFFFFFFFFFFFFFFF))
        for lo in range(0, len(keys), BLOCK):
            hi = min(lo + BLOCK, len(keys))
            table = self._table(keys[lo:hi], h[lo:hi], log_w[lo:hi], lo)
            for d in range(len(texts)):
                r = row[at[d] : at[d + 1]]
                if hi - lo < len(keys):
                    r = r[(r >= lo) & (r < hi)]
                for k in range(0, len(r), 4096):
                    np.minimum(best[d], table[r[k : k + 4096] - lo].min(axis=0), out=best[d])
        full = np.diff(at) > 0
        chosen = (best[full] & _LOW).astype(np.int64)
        rate, _, beta = _variates(h[chosen], _SEEDS)
        level = _level(log_w[chosen], rate, beta).astype(np.int64).view(np.uint64)
        out[full] = 1 + _mix(h[chosen] ^ _mix(level + np.uint64(77))) % np.uint64(65535)

    def _table(self, keys: np.ndarray, h: np.ndarray, log_w: np.ndarray, lo: int) -> np.ndarray:
        """Each pair's value for each sample as sortable bits, above the pair's row number. Pairs that the last batch had keep their values."""
        old, values = self.before
        at = np.minimum(np.searchsorted(old, keys), max(0, len(old) - 1))
        same = old[at] == keys if len(old) else np.zeros(len(keys), bool)
        table = np.empty((len(keys), SAMPLES), np.uint64)
        table[same] = values[at[same]] & ~_LOW
        table[~same] = self._values(h[~same], log_w[~same])
        table |= np.arange(lo, lo + len(h), dtype=np.uint64)[:, None]
        self.before = keys, table
        return table

    @staticmethod
    def _values(h: np.ndarray, log_w: np.ndarray) -> np.ndarray:
        table = np.empty((len(h), SAMPLES), np.uint64)
        for k in range(0, len(h), ROWS):
            rate, log_c, beta = _variates(h[k : k + ROWS, None], _SEEDS)
            value = log_c - rate * (_level(log_w[k : k + ROWS, None], rate, beta) - beta + np.float32(1))
            bits = value.astype(np.float32).view(np.uint32)
            bits ^= np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
            table[k : k + ROWS] = bits.astype(np.uint64) << _HALF
        return table


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` for every row; null counts as empty, and an empty text has all zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sampler()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(">u2").tobytes().hex() for x in s.signatures(b.column(1).to_pylist())])], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


#: Sampled rows for each cut between buckets, and cuts at most.
PER_CUT, CUTS = 40, 25_000


def in_descending_order(docs: DataFrame) -> DataFrame:
    """``bucket, guard, doc_id, text``: rows dealt out by ranges of their order, each bucket with the row that follows its last.

    The order is descending doc_id (null last), then a hash of the text, then the text, so rows that share an id
    are dealt out too. The cuts come from a sample, which decides about balance only. The first row of a bucket also
    goes, as its guard, to the bucket before (the very first one to the last). Nothing else is doubled.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # ~id instead of -id, which the least id does not have.
    rows = rows.withColumn("at", F.struct(F.col("doc_id").isNull().alias("z"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("m"), F.xxhash64("text").alias("h")))
    many = min(4 * n, CUTS)
    share = min(1.0, PER_CUT * many / max(1, docs.count()))
    sampled = sorted(tuple(r["at"]) for r in rows.select("at").sample(share, 11).collect())
    cuts = sorted({sampled[len(sampled) * i // many] for i in range(1, many)}) if sampled else []
    rows = rows.withColumn("bucket", _bucket(cuts))
    firsts = sorted((r.bucket, tuple(r.top)) for r in rows.groupBy("bucket").agg(F.min("at").alias("top")).collect())  # one row a bucket
    marks = spark.createDataFrame([(b, top, firsts[i - 1][0]) for i, (b, top) in enumerate(firsts)], f"bucket int, top {_AT}, before int")
    own = F.struct("bucket", F.lit(False).alias("guard"))
    copies = F.when(F.col("at") == F.col("top"), F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("guard")))).otherwise(F.array(own))
    dealt = rows.join(F.broadcast(marks), "bucket").select(F.explode(copies).alias("to"), "at", "doc_id", "text")
    return dealt.select("to.bucket", "to.guard", "doc_id", "text", "at").repartition(n, "bucket").sortWithinPartitions("bucket", "guard", "at", "text").drop("at")


_AT = "struct<z:boolean,m:bigint,h:bigint>"


def _bucket(cuts: list[tuple[bool, int, int]]) -> Column:
    """How many cuts are not after ``at``: first among every k-th cut, then among the k from there."""
    if not cuts:
        return F.lit(0)
    k = int(len(cuts) ** 0.5) + 1
    table = lambda some: F.from_json(F.lit(json.dumps([{"z": z, "m": m, "h": h} for z, m, h in some])), f"array<{_AT}>")
    passed = lambda some: F.size(F.filter(some, lambda c: c <= F.col("at")))
    coarse = passed(table(cuts[::k]))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * k + passed(F.slice(table(cuts), (coarse - 1) * k + 1, F.lit(k)))).cast("int")


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as much of the following one's beginning."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Rows with equal doc_id follow each other by a hash of the text, then the text; null ids come last; a lone row
    follows itself. Repeated rows come out as often as they are there; other columns are ignored.
    Two empty texts are alike (1), an empty and a filled one are not (0). No rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        held = None  # the row before: bucket, doc_id, text, signature
        for batch in batches:
            bucket, guard, ids, texts = (batch.column(i).to_pylist() for i in range(4))
            for a, b in small_batches(texts, 3_000_000):
                # Each text stands beside its predecessor's edited text, whose words it mostly shares: one table of values serves both.
                pairs, asked, first = [], [], held
                for k in range(a, b):
                    if first and first[0] == bucket[k]:
                        pairs.append(k)
                        asked.append(edited(first[2], texts[k]))
                    asked.append(texts[k])
                    first = None if guard[k] else (bucket[k], ids[k], texts[k])
                signed = iter(sampler.signatures(asked))
                rows, new, after, open_pairs = [], [], [], set(pairs)
                for k in range(a, b):
                    if k in open_pairs:
                        new.append(edited(held[2], texts[k]))
                        after.append(next(signed))
                    now = (bucket[k], ids[k], texts[k], next(signed))
                    if k in open_pairs:
                        rows.append((held, now))
                    held = None if guard[k] else now
                if not rows:
                    continue
                after = np.array(after)
                own, nxt = np.array([x[3] for x, _ in rows]), np.array([y[3] for _, y in rows])
                show = lambda s: [v.astype(">u2").tobytes().hex() for v in s]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[1] for x, _ in rows], pa.int64()), pa.array([len(x[2]) for x, _ in rows], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
                        pa.array(show(own)), pa.array(show(after)), pa.array(likeness(own, after)), pa.array(likeness(own, nxt)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return in_descending_order(docs).mapInArrow(run, _OUT)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
