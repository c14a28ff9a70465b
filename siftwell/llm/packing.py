"""Best-fit packing of token pieces into sequences, bettered by swap-based local search.

Documents are encoded, ended by a separator, cut only where they exceed a sequence, and their pieces are
packed in groups of bounded size. Each piece starts in a sequence of its own. Pieces are moved between underfull
sequences, the longest first and each into the fullest that takes it; then they are moved on, or exchanged
one for one or two for one, wherever that raises the sum of squared fills. Emptied sequences go.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.bpe import Merger, coder, id_bytes, ship_lexicon, ship_tokenizer
from siftwell.llm.common import materialize, read_table, text_or_empty

SEQUENCE = 2048
SEPARATOR = 0
#: Pieces that one task packs; each group can leave one sequence partly filled.
GROUP = 40_000
#: Bins in a row that may be unable to give before the search of a group ends.
PATIENCE = 100


def least_bins(lengths: list[int], size: int) -> int:
    """A bound from below: for each size ``a``, items that leave no room for ``a`` stand alone, and middling ones must fit beside those over half."""
    n = np.bincount(np.asarray(lengths, np.int64), minlength=size + 1)
    total = n * np.arange(size + 1)
    up, tokens = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(total))  # of sizes under the index
    a = np.arange(size // 2 + 1)
    half = size // 2 + 1
    alone = up[-1] - up[size - a + 1]
    over = up[size - a + 1] - up[half]
    beside = np.maximum(0, tokens[half] - tokens[a] - (over * size - (tokens[size - a + 1] - tokens[half])))
    return int((alone + over + -(-beside // size)).max())


def first_moves(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers after a first round of moves.

    Every item starts alone. From the longest on, each moves to the fullest bin that takes it, which is
    the move that raises the sum of squared fills most.
    """
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: a bin with room r is there
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = rooms >> n << n
        if fits:
            room = (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = size, len(bins)
            bins.append([])
        bins[b].append(i)
        if room - n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class _Offers:
    """What each underfull bin can give back for an item: nothing, one of its items, or any two of them.

    Items of one size are alike, so a bin has at most about sqrt(2 * size) different ones.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], fill: np.ndarray, size: int):
        self.bins, self.lengths, self.fill, self.size = bins, lengths, fill, size
        self.rows: dict[int, tuple[int, int]] = {}
        self.back, self.owner, self.items, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), 0
        self._add([b for b in range(len(bins)) if fill[b] < size])

    def _of(self, b: int) -> list[tuple[int, int, int]]:
        by_size: dict[int, list[int]] = {}
        for i in self.bins[b]:
            by_size.setdefault(self.lengths[i], []).append(i)
        one = [(n, same[0]) for n, same in by_size.items()]
        rows = [(0, -1, -1), *((n, i, -1) for n, i in one)]
        rows += [(n + m, i, j) for k, (n, i) in enumerate(one) for m, j in one[k + 1 :]]
        return rows + [(2 * n, same[0], same[1]) for n, same in by_size.items() if len(same) > 1]

    def _add(self, which: list[int]) -> None:
        rows, owner = [], []
        at = self.used
        for b in which:
            own = self._of(b)
            self.rows[b] = at, at + len(own)
            at += len(own)
            rows += own
            owner += [b] * len(own)
        if at > len(self.back):
            grow = max(at, 2 * len(self.back)) - len(self.back)
            self.back, self.owner = np.append(self.back, np.zeros(grow, np.int64)), np.append(self.owner, np.zeros(grow, np.int64))
            self.items = np.concatenate([self.items, np.zeros((grow, 2), np.int64)])
        if rows:
            new = np.array(rows, np.int64)
            self.back[self.used : at], self.items[self.used : at], self.owner[self.used : at] = new[:, 0], new[:, 1:], owner
        self.used = at

    def renew(self, b: int) -> None:
        lo, hi = self.rows.pop(b, (0, 0))
        self.back[lo:hi] = 1 << 40  # such a row asks for more than any item has
        if self.bins[b] and self.fill[b] < self.size:
            self._add([b])
        if self.used > 4096 and self.used > 3 * sum(z - a for a, z in self.rows.values()):
            live, self.used, self.rows = list(self.rows), 0, {}
            self._add(live)

    def best(self, low: int) -> tuple[int, int, list[int]] | None:
        """The change that raises the sum of squared fills most while it takes tokens out of ``low``: item, target, items back."""
        found, most = None, 0
        back, owner = self.back[: self.used], self.owner[: self.used]
        above, room = (self.fill - self.fill[low])[owner], (self.size - self.fill)[owner]
        room[slice(*self.rows.get(low, (0, 0)))] = -1
        for n, item in {self.lengths[i]: i for i in self.bins[low]}.items():
            moved = n - back
            gain = np.where((moved > 0) & (moved <= room), moved * (above + moved), 0)
            k = int(gain.argmax())
            if gain[k] > most:
                most, found = int(gain[k]), (item, int(owner[k]), [int(i) for i in self.items[k] if i >= 0])
        return found


def local_search(bins: list[list[int]], lengths: list[int], size: int, patience: int = PATIENCE) -> list[list[int]]:
    """Empty bins by moves and by exchanges, one for one or two for one, between any two underfull ones.

    Every change raises the sum of squared fills, so the search ends. The emptiest bin gives first; after one
    that cannot give any more, the next emptiest does. It ends at the bound that the sizes set, when no bin
    can give, or when ``patience`` bins in a row could not.
    """
    bins = [list(b) for b in bins]
    least = least_bins(lengths, size)
    fill = np.array([sum(lengths[i] for i in b) for b in bins], np.int64)
    offers, count, stuck = _Offers(bins, lengths, fill, size), len(bins), set()
    while count > least and len(stuck) < patience:
        low = min((b for b in offers.rows if b not in stuck), key=lambda b: fill[b], default=None)
        if low is None:
            break
        changed = False
        while bins[low] and (step := offers.best(low)):
            item, target, back = step
            bins[low].remove(item)
            bins[target].append(item)
            for i in back:
                bins[target].remove(i)
                bins[low].append(i)
            moved = lengths[item] - sum(lengths[i] for i in back)
            fill[low] -= moved
            fill[target] += moved
            offers.renew(target)
            offers.renew(low)
            changed = True
        if not bins[low]:
            count -= 1
        stuck = (set() if changed and bins[low] else stuck - {low} if not bins[low] else stuck) | ({low} if bins[low] else set())
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items of full size have a bin of their own; ties and repeats are items like any other."""
    if any(n > size for n in lengths):
        raise ValueError(f"no piece may be longer than {size}")
    bins = local_search(first_moves(lengths, size), lengths, size)
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(bins):
        at = 0
        for i in sorted(members):
            bin_of[i], offset[i] = b, at
            at += lengths[i]
    return bin_of, offset


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, separator: int = SEPARATOR) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``. A null or empty text is the separator alone.

    Rows are independent: repeated rows give their pieces as often as they are there, a null id stays null,
    and other columns are ignored.
    """
    spark = docs.sparkSession
    shipped = ship_tokenizer(spark, tokenizer)
    lexicon = ship_lexicon(spark, Merger(tokenizer).whole_words())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shipped, lexicon, id_bytes)
        end = np.array([separator], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for i, (words,) in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                words.append(end)
                raw = b"".join(words)
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    rows.append((i, k, k * size, len(part) // 4, zlib.crc32(part)))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id, offset`` to rows that have a ``length`` of at most ``size`` (null counts as 0).

    Rows are dealt at random into groups of about ``group`` and each group is packed by one task, so
    neither an id nor a hot source can swell a task. Then what each group's emptiest sequence holds is
    packed once more, together. No rows in, no rows out; repeated rows and ties are packed one by one.
    Columns of the input that are named as ours are replaced.
    """
    cut = materialize(cut.drop("sequence_id", "offset"), "pieces")
    groups = max(1, -(-cut.count() // group))
    first = _packed(cut, groups, size, "first")
    if groups == 1:
        return first.drop("_spare")
    first = materialize(first, "packed")
    spare = first.where("_spare").drop("_spare", "sequence_id", "offset")
    second = _packed(spare, max(1, -(-spare.count() // group)), size, "again")
    second = second.withColumn("sequence_id", -1 - F.col("sequence_id"))
    return first.where("NOT _spare").unionByName(second).drop("_spare")


def _packed(rows: DataFrame, groups: int, size: int, name: str) -> DataFrame:
    """``rows`` with ``sequence_id``, ``offset`` and whether theirs is the emptiest sequence of its group (``_spare``)."""
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(name)), F.lit(groups))
    own = "_group" + "_" * max(map(len, rows.columns), default=0)

    def run(table: pa.Table) -> pa.Table:
        lengths = [n or 0 for n in table["length"].to_pylist()]
        bins, offset = pack_lengths(lengths, size)
        fill = np.bincount(bins, lengths)
        low = int(fill.argmin())
        spare = (bins == low) & (fill[low] < size)
        key = table[own][0].as_py()
        added = {"sequence_id": pa.array(key * 2**32 + bins), "offset": pa.array(offset), "_spare": pa.array(spare)}
        table = table.drop_columns([own])
        for k, v in added.items():
            table = table.append_column(k, v)
        return table

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.withColumn(own, number).groupBy(own).applyInArrow(run, f"{fields}, sequence_id long, offset long, _spare boolean")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json")))
