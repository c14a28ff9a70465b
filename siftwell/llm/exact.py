"""Exact deduplication by counting quotient filters.

A normalised text's 64-bit fingerprint splits into a quotient, which names a slot, and a remainder, which is
what a slot holds. Each partition builds a counting filter. Filters merge without loss, range by range of
quotients, by merging sorted remainders and adding counts. Fingerprints counted more than once route their
rows to byte verification, which groups by the normalised bytes; all others are unique without another look.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import join_per_key, materialize, partitions, read_table, text_or_empty

SPACE = b" \t\n\x0b\x0c\r"
#: Bits of a quotient, at least; remainders then take 48 bits at most.
QUOTIENT = 16
#: Fingerprints that a worker gathers before it makes a filter of them, and that one range holds on average.
GATHER, RANGE = 200_000, 2_000_000
#: Repeated fingerprints up to so many are broadcast (8 bytes each).
BROADCAST = 500_000


class CountingQuotientFilter:
    """Slots with a remainder, a count and three bits.

    Remainders of one quotient form a run, in order, at the slot that the quotient names or after it, where
    the runs before reach so far. Bits: 1 some remainder has this slot's quotient; 2 the slot goes on with
    the run of the slot before; 4 the remainder is not in the slot that its quotient names. A count of 255
    or more stands in a list beside the slots.
    """

    OCCUPIED, CONTINUES, SHIFTED = 1, 2, 4

    def __init__(self, bits: int, flags: np.ndarray, low: np.ndarray, high: np.ndarray, small: np.ndarray, many: np.ndarray):
        self.bits, self.flags, self.low, self.high, self.small, self.many = bits, flags, low, high, small, many

    @classmethod
    def of_sorted(cls, prints: np.ndarray, counts: np.ndarray, bits: int | None = None) -> CountingQuotientFilter:
        """From distinct fingerprints in ascending order: runs are laid out in one pass."""
        bits = bits if bits is not None else max(QUOTIENT, int(len(prints) * 4 // 3).bit_length())
        left = np.uint64(64 - bits)
        quotient = (prints >> left).astype(np.int64)
        rest = prints & np.uint64((1 << int(left)) - 1)
        order = np.arange(len(prints))
        slot = order + np.maximum.accumulate(quotient - order) if len(prints) else order
        size = max(1 << bits, int(slot[-1]) + 1 if len(slot) else 0)
        flags, low, high, small = np.zeros(size, np.uint8), np.zeros(size, np.uint32), np.zeros(size, np.uint16 if left <= 48 else np.uint32), np.zeros(size, np.uint8)
        flags[quotient] |= cls.OCCUPIED
        flags[slot[1:][quotient[1:] == quotient[:-1]]] |= cls.CONTINUES
        flags[slot[slot != quotient]] |= cls.SHIFTED
        low[slot], high[slot], small[slot] = rest & np.uint64(0xFFFFFFFF), rest >> np.uint64(32), np.minimum(counts, 255)
        return cls(bits, flags, low, high, small, counts[counts >= 255].astype(np.int64))

    @classmethod
    def build(cls, prints: np.ndarray, bits: int | None = None) -> CountingQuotientFilter:
        return cls.of_sorted(*np.unique(prints.astype(np.uint64), return_counts=True), bits)

    def __len__(self) -> int:
        return int(np.count_nonzero(self.flags))  # a slot without bits is empty

    def _remainders(self, used: np.ndarray) -> np.ndarray:
        return self.high[used].astype(np.uint64) << np.uint64(32) | self.low[used]

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order, and their counts. The n-th run belongs to the n-th quotient that has one."""
        used = np.flatnonzero(self.flags)
        run = np.cumsum(self.flags[used] & self.CONTINUES == 0) - 1
        quotient = np.flatnonzero(self.flags & self.OCCUPIED)[run].astype(np.uint64)
        counts = self.small[used].astype(np.int64)
        counts[counts == 255] = self.many
        return quotient << np.uint64(64 - self.bits) | self._remainders(used), counts

    def prints(self) -> np.ndarray:
        return self.items()[0]

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint is in; looks at its run alone."""
        quotient, rest = fingerprint >> (64 - self.bits), fingerprint & ((1 << (64 - self.bits)) - 1)
        if not self.flags[quotient] & self.OCCUPIED:
            return 0
        first = quotient
        while self.flags[first] & self.SHIFTED:  # back to where the cluster begins
            first -= 1
        runs = int(np.count_nonzero(self.flags[first : quotient + 1] & self.OCCUPIED))
        slot = first
        while True:
            runs -= not self.flags[slot] & self.CONTINUES
            if runs == 0:
                break
            slot += 1
        while slot < len(self.flags) and self.flags[slot]:
            if (int(self.high[slot]) << 32 | int(self.low[slot])) == rest:
                n = int(self.small[slot])
                return n if n < 255 else int(self.many[np.count_nonzero(self.small[:slot] == 255)])
            slot += 1
            if slot < len(self.flags) and not self.flags[slot] & self.CONTINUES:
                break
        return 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Lossless: equal fingerprints add their counts, all others stay. Both are in order, so nothing is sorted again."""
        (a, na), (b, nb) = self.items(), other.items()
        at = np.searchsorted(a, b)
        both = at < len(a)
        both[both] = a[at[both]] == b[both]
        na[at[both]] += nb[both]
        place = at[~both] + np.arange(np.count_nonzero(~both))
        prints, counts = np.empty(len(a) + len(place), np.uint64), np.empty(len(a) + len(place), np.int64)
        mine = np.ones(len(prints), bool)
        mine[place] = False
        prints[place], counts[place], prints[mine], counts[mine] = b[~both], nb[~both], a, na
        return self.of_sorted(prints, counts)

    def ranges(self, n: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """``n`` equal ranges of fingerprints, each a filter that spans its range with all its quotients."""
        prints, counts = self.items()
        cuts = np.searchsorted(prints, np.array([-(-(k << 64) // n) for k in range(n)], np.uint64))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(prints)], strict=True)):
            if b > a:
                yield k, self.of_sorted(prints[a:b], counts[a:b])

    def to_bytes(self) -> bytes:
        """Only the slots in use, and the bits that tell where they belong, which is what a merge needs."""
        prints, counts = self.items()
        gaps = np.diff(prints, prepend=np.uint64(0))  # ascending, so these stay small and exact
        return struct.pack("<q", len(prints)) + gaps.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        n = struct.unpack_from("<q", raw)[0]
        prints = np.cumsum(np.frombuffer(raw, np.uint64, n, 8), dtype=np.uint64)
        counts = np.frombuffer(raw, np.uint8, n, 8 + 8 * n).astype(np.int64)
        counts[counts == 255] = np.frombuffer(raw[8 + 9 * n :], np.int64)
        return cls.of_sorted(prints, counts)


class Merging:
    """Filters merged pairwise, like by like, so that each fingerprint takes part in few merges."""

    def __init__(self) -> None:
        self.held: list[CountingQuotientFilter] = []

    def add(self, new: CountingQuotientFilter) -> None:
        self.held.append(new)
        while len(self.held) > 1 and len(self.held[-2]) <= 2 * len(self.held[-1]):
            last = self.held.pop()
            self.held[-1] = self.held[-1].merge(last)

    def take(self) -> CountingQuotientFilter | None:
        out = None
        while self.held:
            out = self.held.pop() if out is None else self.held.pop().merge(out)
        return out


def normalise(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(None, SPACE)


def thin_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fp, text_sha256`` of every row's normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, fp, sha = [], [], []
            for t in b.column(1).to_pylist():
                raw = normalise(t)
                n.append(len(t))
                fp.append(xxhash.xxh3_64_intdigest(raw))
                sha.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sha)], ["doc_id", "n_chars", "fp", "text_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_chars long, fp long, text_sha256 string")


def repeated(thin: DataFrame) -> DataFrame:
    """Fingerprints that are there more than once (``fp, n``), by merging the partitions' filters.

    A filter has one entry for each distinct fingerprint, so a hot one is one entry from each partition. There
    are as many ranges as the rows need, so a task's share of the fingerprints does not grow with the input.
    """
    n = max(partitions(thin.sparkSession), -(-thin.count() // RANGE))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, raw, gathered = Merging(), [], 0

        def emit():
            whole = own.take()
            for k, part in whole.ranges(n) if whole else ():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.to_bytes()], pa.binary())], ["range", "filter"])

        for b in batches:
            raw.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            gathered += len(raw[-1])
            if gathered > GATHER:
                own.add(CountingQuotientFilter.build(np.concatenate(raw)))
                raw, gathered = [], 0
                if sum(map(len, own.held)) > 20 * GATHER:  # bounded memory; the merge below takes any number of filters
                    yield from emit()
        if raw:
            own.add(CountingQuotientFilter.build(np.concatenate(raw)))
        yield from emit()

    def merge(table: pa.Table) -> pa.Table:
        all_parts = Merging()
        for raw in table["filter"]:
            all_parts.add(CountingQuotientFilter.from_bytes(raw.as_py()))
        prints, counts = all_parts.take().items()
        twice = counts > 1
        return pa.table({"fp": prints[twice].view(np.int64), "n": counts[twice]})

    parts = thin.select("fp").mapInArrow(build, "range int, filter binary")
    return parts.groupBy("range").applyInArrow(merge, "fp long, n long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Every row with the row of its group that stays.

    Of equal normalised texts the row with the most code points stays, then the least doc_id. Null text
    is empty, and empty texts are one group. A null doc_id loses against any other; rows that are alike
    in id and length are all marked as kept. Bytes are compared by grouping on the normalised text: map
    tasks first fold their own copies, so a hot group arrives as one row from each task.
    """
    thin = materialize(thin_rows(docs), "exact-thin")
    twice = materialize(repeated(thin), "exact-repeated")
    route, few = twice.select("fp"), twice.count() <= BROADCAST
    suspects = _with_print(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    if few:
        suspects = suspects.join(F.broadcast(route), "fp", "left_semi")
    best = F.struct(F.col("n_chars").alias("n"), (-F.coalesce("doc_id", F.lit(2**63 - 1))).alias("minus"))
    groups = suspects.groupBy("fp", "body").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
    if not few:  # copies are folded by then, so no fingerprint is hot
        groups = groups.join(route, "fp", "left_semi")
    groups = groups.where("group_size > 1").select(F.sha2("body", 256).alias("text_sha256"), F.when(-F.col("best.minus") != 2**63 - 1, -F.col("best.minus")).alias("keep"), F.col("best.n").alias("keep_chars"), "group_size", F.col("group_size").alias("size"))
    joined = join_per_key(thin.select("doc_id", "n_chars", "text_sha256"), materialize(groups, "exact-groups"), "text_sha256", spread=["doc_id", "n_chars"])
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("n_chars") == F.col("keep_chars")))).alias("kept"), "text_sha256",
    )


def _with_print(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fp, body`` with the normalised bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            body = [normalise(t) for t in texts]
            fp = np.array([xxhash.xxh3_64_intdigest(x) for x in body], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(fp), pa.array(body, pa.binary())], ["doc_id", "n_chars", "fp", "body"])

    return docs.mapInArrow(run, "doc_id long, n_chars long, fp long, body binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
g AS (SELECT body, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size::BIGINT AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""
