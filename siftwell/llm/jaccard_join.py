"""Similarity join on word n-grams with a count-vector R-tree.

A document is the set of its distinct word shingles. Two documents link when the Jaccard similarity of
their sets reaches the threshold (3/4: seven times the intersection is at least three times the sum of
the sizes). The join is exact up to collisions of 64-bit hashes:

1. Shingles are counted into a sketch of fixed size. Any total order of shingles serves the next step;
   the sketch puts those that are common in the corpus last.
2. A set's prefix is its first quarter in that order, and one more. Linked sets share a prefix shingle, so
   for each prefix shingle the classes (distinct sets) that have it form a group, named by its least class.
   Copies are one class and groups of one end here.
3. In each group, shingles are hashed into coordinates (more of them for larger
   sets) and the counts are points of an R-tree. The sum of
   coordinate minima bounds the overlap from above, for nodes by their upper corners and then for points;
   what survives is verified on the sets. Classes that are already connected need no further look, so a
   group of near copies takes about one verification each, not all pairs.
4. Groups beyond a bounded size are dealt into chunks by size of set, each with the group's pivot. Members that
   stay unconnected to the pivot visit those other chunks that hold a possible partner: the sizes must agree,
   and what follows the shared shingle in the global order must suffice for a link. Visitors come in blocks of
   bounded size, so no task holds more than a chunk and a block, and no link is lost.
5. Components of the verified links are found by alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import digest_of, join_per_key, materialize, partitions, read_table, small_batches, text_or_empty

WORDS = 5
#: Least coordinates of a count vector; larger sets have more.
GROUPS = 64
#: Counters of the sketch, and the blocks in which partitions hand them over.
SKETCH, BLOCKS = 1 << 18, 16
#: Shingles of the sets of a chunk, on average; a task holds one chunk, or one chunk and a block of its visitors.
LIMIT = 500_000
#: Chunks of a split group are dealt by size of set, in so many bands for each doubling.
BANDS = 4
FANOUT = 32
_MEMO = 400_000
_NONE = 2**63 - 1


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, words: int = WORDS):
        self.n, self.memo = words, {}
        self.odd = _mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.array(list(map(memo.__getitem__, words)), np.uint64)
        n = min(self.n, len(h))
        size = len(h) - n + 1
        out = h[:size] * self.odd[0]
        for k in range(1, n):
            out += h[k : k + size] * self.odd[k]
        out = _mix(out + np.uint64(n))
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def level_of(size: int) -> int:
    """Coordinates of the count vector of a set: a power of two near an eighth of the size, so that the bound stays sharp."""
    return max(GROUPS, 1 << (size // 8).bit_length())


def vector(shingles: np.ndarray) -> np.ndarray:
    level = level_of(len(shingles))
    return np.bincount((shingles & np.uint64(level - 1)).astype(np.int64), minlength=level).astype(np.int32)


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1  # positive as a long


class CountTree:
    """An R-tree over count vectors, bulk-loaded in order of size; asks for points that may overlap enough."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes  # by ascending size
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        top, low, high = points, sizes, sizes
        while len(top) > FANOUT:
            at = np.arange(0, len(top), FANOUT)
            top, low, high = np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def candidates(self, point: np.ndarray, size: int, below: int) -> np.ndarray:
        """Numbers under ``below`` of points whose summed minima with ``point`` allow a link."""
        nodes = None
        for top, low, high in reversed(self.levels):
            nodes = np.arange(len(top)) if nodes is None else (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            nodes = nodes[nodes < len(top)]
            nodes = nodes[(4 * high[nodes] >= 3 * size) & (3 * low[nodes] <= 4 * size)]
            nodes = nodes[7 * np.minimum(top[nodes], point).sum(axis=1) >= 3 * (size + low[nodes])]
            if not len(nodes):
                return nodes
        leaf = np.arange(min(below, len(self.points))) if nodes is None else (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        leaf = leaf[leaf < min(below, len(self.points))]
        leaf = leaf[(4 * self.sizes[leaf] >= 3 * size) & (3 * self.sizes[leaf] <= 4 * size)]
        return leaf[7 * np.minimum(self.points[leaf], point).sum(axis=1) >= 3 * (size + self.sizes[leaf])]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles in common of two sorted sets."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))


def candidates(points: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each member with the smaller ones that the bound allows it to link with.

    Sets that can link differ by a third in size at most, so their vectors have the same number of
    coordinates or one has twice as many; folding its halves together makes them comparable.
    """
    level = np.array([len(p) for p in points])
    for g in np.unique(level):
        member = np.flatnonzero((level == g) | (level == 2 * g))
        if len(member) < 2:
            continue
        member = member[np.argsort(sizes[member], kind="stable")]
        own = level[member] == g
        tree = CountTree(np.stack([points[i] if len(points[i]) == g else points[i].reshape(2, g).sum(axis=0) for i in member]), sizes[member])
        for k in range(1, len(member)):
            found = tree.candidates(tree.points[k], int(tree.sizes[k]), k)
            if not own[k]:
                found = found[own[found]]
            if len(found):
                yield int(member[k]), member[found[::-1]]


def links(sets: list[np.ndarray], visits: np.ndarray, same: np.ndarray, every: bool) -> list[tuple[int, int, int]]:
    """Pairs (a, b, overlap) of linked sets.

    With ``every`` all of them, else (member, root of its component, 0) for each member that is connected to an
    earlier one; ``same`` marks members known to be connected. Where there are visitors, only they and their
    hosts are compared.
    """
    label, found, guests = np.arange(len(sets)), [], visits.any()
    if same.any():
        label[same] = np.flatnonzero(same)[0]
    for a, partners in candidates([vector(s) for s in sets], np.array([len(s) for s in sets])):
        if guests:
            partners = partners[visits[partners] != visits[a]]
        while True:
            if not every:
                partners = partners[label[partners] != label[a]]
            if not len(partners):
                break
            b, partners = int(partners[0]), partners[1:]
            both = overlap(sets[a], sets[b])
            if 7 * both < 3 * (len(sets[a]) + len(sets[b])):
                continue
            if every:
                found.append((max(a, b), min(a, b), both))
            else:
                low, high = sorted((int(label[a]), int(label[b])))
                label[label == high] = low
    return found if every else [(i, int(r), 0) for i, r in enumerate(label) if r != i]


def may_link(points: list[np.ndarray], sizes: np.ndarray, visits: np.ndarray) -> np.ndarray:
    """Which members of a group have a partner that the bound allows; where there are visitors, one of the other kind."""
    keep, guests = np.zeros(len(points), bool), visits.any()
    for a, partners in candidates(points, sizes):
        if guests:
            partners = partners[visits[partners] != visits[a]]
        if len(partners):
            keep[a] = True
            keep[partners] = True
    return keep


# --- steps on Spark --------------------------------------------------------------------------------


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), text_or_empty().alias("text")).withColumn("key", digest_of(F.col("text")))


def sketch(rows: DataFrame, words: int) -> np.ndarray:
    """How often the shingles of each counter are in the corpus: every row counts; the size is fixed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, total = Shingler(words), np.zeros(SKETCH, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo, hi in small_batches(texts):
                at = np.concatenate([shingle(t) for t in texts[lo:hi]])
                total += np.bincount((at & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
        for k, part in enumerate(np.split(total, BLOCKS)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype(np.uint32).tobytes()], pa.binary())], ["block", "counts"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint32).astype(np.int64) for c in parts["counts"])
        return pd.DataFrame({"block": parts["block"][:1], "counts": [total.tobytes()]})

    parts = rows.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect()
    total = np.zeros(SKETCH, np.int64)
    for r in parts:
        total.reshape(BLOCKS, -1)[r.block] = np.frombuffer(r.counts, np.int64)
    return total


def profile(rows: DataFrame, counts: np.ndarray, words: int) -> DataFrame:
    """``doc, key, cls, n, vec, keys``: a row, its set's class, size, count vector and prefix in order (null where the task had the class before)."""
    common = rows.sparkSession.sparkContext.broadcast((np.log2(counts + 1) * 1024).astype(np.uint64))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, rare = Shingler(words), set(), common.value
        for b in batches:
            texts, docs, digests = b.column(2).to_pylist(), b.column(0), b.column(1)
            for lo, hi in small_batches(texts):
                cls, n, vec, keys = [], [], [], []
                for t in texts[lo:hi]:
                    s = shingle(t)
                    c = class_of(s)
                    cls.append(c)
                    n.append(len(s))
                    new = len(s) and c not in seen
                    vec.append(vector(s).tobytes() if new else None)
                    if new:
                        seen.add(c)
                        if len(seen) > 1_000_000:
                            seen.clear()
                        rank = rare[(s & np.uint64(SKETCH - 1)).astype(np.int64)] << np.uint64(40) | s >> np.uint64(24)
                        last = len(s) - -(-3 * len(s) // 4)  # all up to the rank at this place, ties with it too
                        head = rank <= np.partition(rank, last)[last]
                        keys.append(s[head][np.argsort(rank[head], kind="stable")].view(np.int64))
                    else:
                        keys.append(None)
                yield pa.RecordBatch.from_arrays([docs[lo:hi], digests[lo:hi], pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(vec, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "key", "cls", "n", "vec", "keys"])

    return rows.select("doc", "key", "text").mapInArrow(run, "doc long, key binary, cls long, n long, vec binary, keys array<long>")


def prefix_groups(profiles: DataFrame) -> DataFrame:
    """``pivot, cls, n, rest``: for every prefix shingle of two classes or more, its classes under the least of them.

    ``rest``: of the set, how much comes from such a shingle on in the global order. If the shingle is the first
    that two sets share, their overlap is no larger than either's rest.
    """
    rows = profiles.where("keys IS NOT NULL").select(F.posexplode("keys").alias("pos", "key"), "cls", "n").select("key", "cls", "n", (F.col("n") - F.col("pos")).alias("rest"))
    rows = rows.repartition(partitions(profiles.sparkSession), "key").sortWithinPartitions("key", "cls")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_cls = None
        head = np.zeros(3, np.int64)  # class, size and rest that lead the run that reaches into this batch
        for b in batches:
            key, cls, n, rest = (b.column(i).to_numpy() for i in range(4))
            if not len(key):
                continue
            new_key = np.append(True, key[1:] != key[:-1])
            new_key[0] = key[0] != last_key or last_key is None
            new_cls = np.append(True, cls[1:] != cls[:-1])
            new_cls[0] = cls[0] != last_cls or last_cls is None
            starts = np.flatnonzero(new_key)
            which = np.cumsum(new_key) - 1  # -1: the run from before
            own = np.stack([cls, n, rest], 1)
            heads = np.concatenate([own[starts], head[None]])
            member = ~new_key & new_cls
            lead, rows = heads[which[member]], own[member]
            last_key, last_cls = key[-1], cls[-1]
            head = heads[which[-1]]
            if len(rows):
                both = np.unique(np.concatenate([np.column_stack([lead[:, 0], rows]), np.column_stack([lead[:, 0], lead])]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, i]) for i in range(4)], ["pivot", "cls", "n", "rest"])

    return rows.mapInArrow(runs, "pivot long, cls long, n long, rest long").groupBy("pivot", "cls", "n").agg(F.max("rest").alias("rest"))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Whole groups (columns pivot, chunk and block) of a stream sorted by them."""
    held: list[pd.DataFrame] = []
    for b in batches:
        rows = b.to_pandas()
        if not len(rows):
            continue
        at = rows[_PLACE].to_numpy()
        edge = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
        for part in np.split(np.arange(len(rows)), edge):
            g = rows.iloc[part[0] : part[-1] + 1]
            if held and (held[0][_PLACE].iloc[0] != g[_PLACE].iloc[0]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(g)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


_PLACE = ["pivot", "chunk", "block"]


def dealt(groups: DataFrame) -> DataFrame:
    """Adds ``chunk`` (0 in a group that is not split) and ``split``; a chunk has about ``LIMIT`` shingles at most.

    Chunks of a split group go by size of set; within a band, by hash.
    """
    band = F.floor(F.log2("n") * BANDS).cast("long")
    sizes = materialize(groups.groupBy("pivot").agg((F.sum("n") > LIMIT).alias("split"), F.count("*").alias("size")), "group-sizes")
    rows = join_per_key(groups, sizes, "pivot").withColumn("band", F.when(F.col("split"), band).otherwise(F.lit(-1).cast("long")))
    rows = materialize(rows, "groups-split")
    # Groups are as many as rows divided by LIMIT, times the bands.
    parts = rows.where("split").groupBy("pivot", "band").agg(F.ceil(F.sum("n") / LIMIT).cast("long").alias("parts"), F.count("*").alias("size"))
    place = F.struct("pivot", "band")
    parts = materialize(parts.withColumn("place", place).drop("pivot", "band"), "group-parts")
    cut = join_per_key(rows.where("split").withColumn("place", place), parts, "place", how="inner")
    cut = cut.withColumn("chunk", F.col("band") * 2**32 + F.pmod(F.xxhash64("cls"), F.col("parts"))).drop("place", "parts", "band")
    return rows.where("NOT split").withColumn("chunk", F.lit(0).cast("long")).drop("band").unionByName(cut)


def bounded(groups: DataFrame) -> DataFrame:
    """The rows ``pivot, chunk, block, cls, visit, same`` of members (with ``n, vec``) that the R-tree leaves a partner for."""
    names = ["pivot", "chunk", "block", "cls", "visit", "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        size = 0
        for g in _by_group(batches):
            keep = may_link([np.frombuffer(v, np.int32) for v in g["vec"]], g["n"].to_numpy(), g["visit"].to_numpy())
            g = g[keep]
            if len(g):
                out.append(g[names].to_numpy(np.int64))
                size += len(g)
            if size > 5000:
                yield _batch(out)
                out, size = [], 0
        if out:
            yield _batch(out)

    def _batch(parts):
        rows = np.concatenate(parts)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) if i < 4 else pa.array(rows[:, i].astype(bool)) for i in range(6)], names)

    n = partitions(groups.sparkSession)
    return groups.select(*names, "n", "vec").repartition(n, *_PLACE).sortWithinPartitions(*_PLACE, "cls").mapInArrow(run, "pivot long, chunk long, block long, cls long, visit boolean, same boolean")


def verified(members: DataFrame, words: int, every: bool) -> DataFrame:
    """``pivot, chunk, a, b, overlap``: what ``links`` finds among members with ``text``, as classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for g in _by_group(batches):
            cls = g["cls"].to_numpy()
            found = links([shingle(t) for t in g["text"]], g["visit"].to_numpy(), g["same"].to_numpy(), every)
            if not found:
                continue
            a, b, both = np.array(found, np.int64).T
            place = [pa.array(np.full(len(a), int(g[c].iloc[0]))) for c in _PLACE[:2]]
            yield pa.RecordBatch.from_arrays([*place, pa.array(cls[a]), pa.array(cls[b]), pa.array(both)], ["pivot", "chunk", "a", "b", "overlap"])

    n = partitions(members.sparkSession)
    rows = members.select(*_PLACE, "cls", "visit", "same", "text").repartition(n, *_PLACE).sortWithinPartitions(*_PLACE, "cls")
    return rows.mapInArrow(run, "pivot long, chunk long, a long, b long, overlap long")


def visiting(split: DataFrame, visitors: DataFrame, every: bool) -> DataFrame:
    """``pivot, chunk, block, cls, n, visit``: visitors beside the members of each chunk that may hold a partner of theirs."""
    reach = F.col("rest") * 7 - F.col("n") * 3  # three times the largest partner
    chunks = split.groupBy("pivot", "chunk").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(reach).alias("reach"))
    chunks = materialize(chunks, "chunks").withColumnRenamed("chunk", "host")
    # A chunk has about LIMIT shingles, so chunks are few; past a checked number they are joined by shuffle.
    v, c = visitors.alias("v"), (F.broadcast(chunks) if chunks.count() <= 500_000 else chunks).alias("c")
    sizes = (4 * F.col("high") >= 3 * F.col("n")) & (3 * F.col("low") <= 4 * F.col("n"))
    shared = (3 * F.col("low") <= F.col("rest") * 7 - F.col("n") * 3) & (3 * F.col("n") <= F.col("reach"))
    other = F.col("host") > F.col("chunk") if every else F.col("host") != F.col("chunk")
    calls = v.join(c, (F.col("v.pivot") == F.col("c.pivot")) & other & sizes & shared).select("v.pivot", F.col("host").alias("chunk"), "cls", "n")
    calls = materialize(calls, "visits")
    blocks = calls.groupBy("pivot", "chunk").agg(F.ceil(F.sum("n") / LIMIT).cast("long").alias("blocks"), F.count("*").alias("size"))
    place = F.struct("pivot", "chunk")
    blocks = materialize(blocks.withColumn("place", place), "visit-blocks")
    guests = join_per_key(calls.withColumn("place", place), blocks.drop("pivot", "chunk"), "place", how="inner")
    guests = guests.select("pivot", "chunk", F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block"), "cls", "n", F.lit(True).alias("visit"), F.lit(False).alias("same"))
    hosts = split.join(blocks.select("pivot", "chunk", "blocks"), ["pivot", "chunk"])
    hosts = hosts.select("pivot", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "cls", "n", F.lit(False).alias("visit"), "same")
    return guests.unionByName(hosts)


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` with the least node of each component of ``a, b``; alternating large and small stars."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("size")), "edges-least")
        large = join_per_key(both, least, "a", how="inner").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = materialize(large.where("a <> b"), "edges-down")
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("size")), "edges-least")
        small = join_per_key(down, least, "a", how="inner").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state


def search(docs: DataFrame, words: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Profiles of all rows; classes ``cls, n, doc, size`` of those with a set; and links ``a, b, overlap`` between classes.

    With ``every`` all links, else enough of them to connect what is linked.
    """
    rows = _rows(docs)
    profiles = materialize(profile(rows, sketch(rows, words), words), "shingle-profiles")
    classes = profiles.where("n > 0").groupBy("cls", "n").agg(F.min(F.struct("doc", "key")).alias("row"), F.count("*").alias("size"), F.first("vec", True).alias("vec"))
    classes = materialize(classes.select("cls", "n", "row.doc", "row.key", "size", "vec"), "shingle-classes")
    groups = materialize(dealt(materialize(prefix_groups(profiles), "prefix-groups")), "dealt-groups")
    vectors = classes.select("cls", "vec")
    no, zero = F.lit(False), F.lit(0).cast("long")

    def found(members: DataFrame, name: str) -> DataFrame:
        kept = materialize(bounded(members.join(vectors, "cls")), f"bounded-{name}")
        wanted = kept.select("cls").distinct().join(classes.select("cls", "doc", "key"), "cls")
        # One text for each class, though rows may repeat.
        texts = rows.join(wanted, ["doc", "key"]).groupBy("cls").agg(F.first("text").alias("text"))
        return materialize(verified(kept.join(texts, "cls"), words, every), f"verified-{name}")

    plain = groups.select("pivot", "chunk", zero.alias("block"), "cls", "n", no.alias("visit"), no.alias("same"))
    split = groups.where("split")
    if split.isEmpty():
        edges = found(plain, "groups")
    else:
        # The pivot of a split group is in every chunk.
        lead = split.where("cls = pivot").select("pivot", "n")
        everywhere = split.select("pivot", "chunk").distinct().join(lead, "pivot").select("pivot", "chunk", zero.alias("block"), F.col("pivot").alias("cls"), "n", no.alias("visit"), no.alias("same"))
        first = found(plain.where("cls <> pivot").unionByName(everywhere.unionByName(plain.join(split.select("pivot").distinct(), "pivot", "left_anti").where("cls = pivot"))), "groups")
        home = first.where("b = pivot").select("pivot", F.col("a").alias("cls")).distinct().withColumn("same", F.lit(True))
        marked = materialize(split.join(home, ["pivot", "cls"], "left").withColumn("same", F.coalesce("same", F.lit(False)) | (F.col("cls") == F.col("pivot"))), "split-members")
        visitors = marked if every else marked.where("NOT same")
        calls = visiting(marked.withColumn("same", no) if every else marked, visitors, every)
        edges = first.unionByName(found(calls, "visits"))
    return profiles, classes, edges.select("a", "b", "overlap").distinct()


def join_pairs(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """All links: ``class_a, class_b, doc_a, doc_b, similarity`` between classes of equal sets, and ``doc_id, n_shingles, class, n_links`` for every row.

    ``doc_a`` and ``doc_b`` are the classes' least ids; copies are not expanded into pairs. ``n_links`` counts the
    rows that a row is linked with, copies too, itself not. Rows without words have no class and no links.
    """
    profiles, classes, edges = search(docs, words, True)
    edges = materialize(edges, "links")
    known = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    end = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), known("doc").alias(f"doc_{x}"), F.col("size").alias(f"size_{x}"))
    pairs = materialize(edges.join(end("a"), "a").join(end("b"), "b"), "link-pairs")
    rows = [pairs.select(F.col(x).alias("cls"), F.col(f"size_{y}").alias("k")) for x, y in ("ab", "ba")]
    partners = rows[0].unionByName(rows[1]).groupBy("cls").agg(F.sum("k").alias("partners"))
    degree = materialize(classes.select("cls", "size").join(partners, "cls", "left").select("cls", "size", (F.col("size") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")), "link-degrees")
    placed = join_per_key(profiles.select("doc", "n", "cls"), degree, "cls")
    member = placed.select(known("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    similarity = F.col("overlap") / (F.col("n_a") + F.col("n_b") - F.col("overlap"))
    return pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "doc_a", "doc_b", similarity.alias("similarity")), member


def join_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc, key, n, component``: the component of every row, rows named by id (2**63 - 1 for null) and text digest."""
    profiles, classes, edges = search(docs, words, False)
    labels = components(edges)
    rooted = classes.select("cls", "doc", "size").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    rooted = materialize(rooted.select("cls", "doc", "size", F.coalesce("label", "cls").alias("root")), "rooted-classes")
    least = materialize(rooted.groupBy("root").agg(F.min("doc").alias("component"), F.count("*").alias("size")), "component-ids")
    of_class = materialize(join_per_key(rooted.select("cls", "root", F.col("size").alias("copies")), least, "root", how="inner").select("cls", "component", "root", F.col("copies").alias("size")), "class-components")
    return join_per_key(profiles.select("doc", "key", "n", "cls"), of_class, "cls")


def join_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Null and empty texts, and texts of white space, have an empty set and link with nothing; so each is
    its own component. Texts of fewer words than a shingle have one. Rows with a null doc_id can link
    others; a component of such rows alone has a null id. Repeated rows and ids come out as often as they are
    there, each by its own text. No rows in, no rows out; other columns are ignored.
    """
    known = lambda c: F.when(c != _NONE, c)
    out = join_rows(docs, words)
    return out.select(known(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), known(F.coalesce("component", "doc")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with one row of each component: the one of the least doc_id, then of the least text digest.

    Rows are told apart by id and text, so rows that share an id are judged one by one; of rows alike in both, one
    stays. Rows without words are linked with nothing and all stay. A null id comes after all others. All columns
    of the rows that stay are as they were. The rows of ``docs`` are read twice.
    """
    names = [f"_{k}" + "_" * max(map(len, docs.columns)) for k in ("doc", "key")]
    placed = materialize(join_rows(docs, words).where("n > 0").select("doc", "key", "root"), "placed-rows")
    best = placed.groupBy("root").agg(F.min(F.struct("doc", "key")).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    stays = materialize(best.select("best.doc", "best.key"), "rows-that-stay").withColumn("stays", F.lit(True))
    roots = materialize(best.select("root", F.col("rows").alias("size")), "roots-of-many").withColumn("many", F.lit(True))
    # What is not in a component of several rows needs no look; of the rest, all but the best go.
    linked = join_per_key(placed, roots, "root", how="inner").select("doc", "key").distinct()
    verdict = materialize(linked.join(stays, ["doc", "key"], "left").select("doc", "key", F.coalesce("stays", F.lit(False)).alias("stays")), "verdicts")
    named = docs.withColumn(names[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))).withColumn(names[1], digest_of(text_or_empty()))
    same = lambda v: (F.col(names[0]) == v["doc"]) & (F.col(names[1]) == v["key"])
    alone = named.join(verdict, same(verdict), "left_anti")
    kept = verdict.where("stays")
    first = named.join(kept, same(kept), "left_semi").dropDuplicates(names)
    return alone.unionByName(first).select(*docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
