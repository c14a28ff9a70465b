"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words are compiled into a minimal acyclic automaton (shared prefixes and suffixes). Its arcs
carry outputs that add up to the word's row in a table of token ids. The automaton is one flat file,
given to executors by ``SparkContext.addFile`` and memory-mapped by their workers. Words that it lacks
are merged by the tokenizer's ranked merges, exactly.

The ids are those of the ``tokenizers`` library for a BPE file whose words end in a suffix, with
normaliser NFC, white space, lower case. Special tokens in a text become their own ids, as there.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import os
import re
import shutil
import struct
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import materialize, small_batches, text_or_empty

#: Words of the corpus that are compiled into the lexicon, the most frequent first.
LEXICON_WORDS = 32_768
#: Words that a worker keeps resolved, twice: the latest ones, and those from before them.
MEMO_WORDS = 300_000
#: Distinct words that a worker counts before it hands the counts on.
COUNT_WORDS = 400_000

#: Words of at most so many bytes are merged together; a longer one by itself.
TOGETHER = 48

_NEVER = 1 << 62
_ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in shown:
            shown[b] = chr(spare)
            spare += 1
    return [shown[b] for b in range(256)]


class Merger:
    """Ranked merges of one word's bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.alphabet = _byte_alphabet()
        # One number for a pair and one for its rank with the token that it becomes.
        self.base = 1 + max(self.vocab.values())
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(self.vocab[a] * self.base + self.vocab[b], rank * self.base + self.vocab[a + b])
        self.first = [self.vocab[c] for c in self.alphabet]
        self.last = [self.vocab[c + self.suffix] for c in self.alphabet]
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self._ordered: tuple[np.ndarray, ...] | None = None

    def whole_words(self) -> dict[str, tuple[int]]:
        """The vocabulary's own whole words: those that the merges turn into one token."""
        back = {c: b for b, c in enumerate(self.alphabet)}
        found = {}
        for token, i in self.vocab.items():
            if token.endswith(self.suffix):
                try:
                    word = bytes(back[c] for c in token[: -len(self.suffix)]).decode()
                except UnicodeDecodeError:
                    continue
                if word and self.merge(word) == (i,):
                    found[word] = (i,)
        return found

    def merge(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        last = self.last[raw[-1]]
        if len(raw) > TOGETHER:
            return tuple(self._long([*map(self.first.__getitem__, raw[:-1]), last]))
        ids = [self.first[b] for b in raw]
        ids[-1] = last
        get, base = self.ranks.get, self.base
        # The rank of each neighbouring pair, with the token it becomes; after a merge only two of them change.
        pairs = [get(a * base + b, _NEVER) for a, b in pairwise(ids)]
        while pairs:
            best = min(pairs)
            if best == _NEVER:
                break
            i = pairs.index(best)
            token = ids[i] = best % base
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get(ids[i - 1] * base + token, _NEVER)
            if i < len(pairs):
                pairs[i] = get(token * base + ids[i + 1], _NEVER)
        return tuple(ids)

    def merge_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """``merge`` of each word; words of similar length take their merges in step, one each a round."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        lens = np.array([*map(len, raws)], np.int64)
        out: list[tuple[int, ...]] = [()] * len(words)
        for k in np.flatnonzero(lens > TOGETHER).tolist():
            out[k] = self.merge(words[k])
        least = 0
        for most in (6, 9, 12, 16, 24, TOGETHER):
            rows = np.flatnonzero((lens > least) & (lens <= most))
            least = most
            for a in range(0, len(rows), 4096):
                part = rows[a : a + 4096]
                flat, ends = self._in_step([raws[k] for k in part], lens[part])
                at = 0
                for k, end in zip(part.tolist(), ends, strict=True):
                    out[k] = tuple(flat[at:end])
                    at = end
        return out

    def _in_step(self, raws: list[bytes], lens: np.ndarray) -> tuple[list[int], list[int]]:
        """The ids of all words in a row, and where each word ends.

        A column is a word, a line a byte of it. ``order`` holds for the pair that starts there its rank and
        its line, so that a column's least value is the leftmost pair of the best rank.
        """
        if self._ordered is None:
            packed = np.array(sorted(self.ranks.items()), np.int64).reshape(-1, 2)
            pairs, ranks = packed[:, 0], packed[:, 1] // self.base
            becomes = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
            becomes[ranks] = packed[:, 1] % self.base
            # The token past either end is ``base``: no pair holds it.
            pairs = pairs // self.base * (self.base + 1) + pairs % self.base
            self._ordered = np.append(pairs, _NEVER), np.append(ranks, 0).astype(np.int32), becomes.astype(np.int32)
        pairs, ranks, becomes = self._ordered
        wide, never = self.base + 1, np.int32(np.iinfo(np.int32).max)

        def rank(left: np.ndarray, right: np.ndarray, line: np.ndarray) -> np.ndarray:
            key = left * np.int64(wide) + right
            at = np.searchsorted(pairs, key)
            return np.where(pairs[at] == key, ranks[at] * 64 + line, never)

        high, n = int(lens.max()), len(raws)
        spelled = np.zeros((n, high), np.uint8)
        inside = np.arange(high) < lens[:, None]
        spelled[inside] = np.frombuffer(b"".join(raws), np.uint8)
        # Lines 1 to high are the bytes; 0 and high + 1 lie past the ends.
        ids = np.full((high + 2, n), self.base, np.int32)
        ids[1:-1] = np.where(inside, np.array(self.first)[spelled], self.base).T
        ids[lens, np.arange(n)] = np.array(self.last)[spelled[np.arange(n), lens - 1]]
        order = np.full((high + 2, n), never)
        order[1:-2] = rank(ids[1:-2], ids[2:-1], np.arange(1, high, dtype=np.int32)[:, None])
        before = np.repeat(np.arange(-1, high + 1, dtype=np.int32)[:, None], n, 1)
        after = before + 2
        done, live = np.empty((high, n), np.int32), np.arange(n)
        while len(live):
            best = order.min(0)
            going = best != never
            if np.count_nonzero(going) < 0.7 * len(live):
                done[:, live[~going]] = ids[1:-1, ~going]
                ids, order, before, after, live, best = ids[:, going], order[:, going], before[:, going], after[:, going], live[going], best[going]
                going = np.ones(len(live), bool)
            col = np.flatnonzero(going)
            if not len(col):
                continue
            i = best[col] & 63
            token = becomes[best[col] >> 6]
            gone = after[i, col]
            nxt, prev = after[gone, col], before[i, col]
            ids[i, col], ids[gone, col] = token, -1
            order[gone, col] = never
            after[i, col], before[nxt, col] = nxt, i
            order[i, col] = rank(token, ids[nxt, col], i)
            order[prev, col] = rank(ids[prev, col], token, prev)
        done = done.T
        kept = (done >= 0) & (done != self.base)
        return done[kept].tolist(), np.cumsum(kept.sum(1)).tolist()

    def _long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list: a word may be a whole text."""
        n, ranks = len(ids), self.ranks
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j >= 0 and (r := ranks.get(ids[i] * self.base + ids[j])) is not None:
                heapq.heappush(heap, (r // self.base, i, ids[i], ids[j], r % self.base))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = to, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [x for x in ids if x >= 0]


# --- the lexicon -----------------------------------------------------------------------------------


def compile_lexicon(words: dict[str, tuple[int, ...]], path: str) -> None:
    """Write the minimal acyclic transducer of ``words`` to ``path``.

    States are added word by word in byte order; a state is frozen when the next word leaves it, and
    then replaced by an equal one that is already there.
    """
    entries = sorted((w.encode(), ids) for w, ids in words.items())
    known: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    reach: list[int] = []  # words that can be read from a state on
    spine: list[list] = [[False, []]]  # states of the word being added: final, arcs

    def freeze(down_to: int) -> None:
        while len(spine) > down_to:
            final, arcs = spine.pop()
            shape = (final, tuple(map(tuple, arcs)))
            state = known.get(shape)
            if state is None:
                state = known[shape] = len(frozen)
                frozen.append(shape)
                reach.append(final + sum(reach[t] for _, t in arcs))
            if spine:
                spine[-1][1][-1][1] = state

    before = b""
    for word, _ in entries:
        shared = len(os.path.commonprefix([before, word]))
        freeze(shared + 1)
        for b in word[shared:]:
            spine[-1][1].append([b, -1])
            spine.append([False, []])
        spine[-1][0] = True
        before = word
    freeze(0)
    keys, targets, outputs = [], [], []
    for s, (final, arcs) in enumerate(frozen):
        out = int(final)
        for b, t in arcs:
            keys.append(s * 256 + b)
            targets.append(t)
            outputs.append(out)
            out += reach[t]
    starts = np.cumsum([0, *(len(ids) for _, ids in entries)])
    parts = [
        np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64),
        np.array([f for f, _ in frozen], np.int64), np.array(starts, np.int64),
        np.array([i for _, ids in entries for i in ids], np.int64),
    ]
    head = np.array([len(frozen) - 1, max((len(w) for w, _ in entries), default=0), *map(len, parts)], np.int64)
    with open(path, "wb") as f:
        f.write(head.tobytes())
        for p in parts:
            f.write(p.tobytes())


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        flat = np.memmap(path, np.int64, "r")
        self.start, self.longest = int(flat[0]), int(flat[1])
        at, parts = 8, []
        for n in map(int, flat[2:8]):
            parts.append(flat[at : at + n])
            at += n
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = parts

    def find(self, words: list[bytes]) -> list[tuple[int, ...] | None]:
        """Token ids of each word, None where the lexicon lacks it. All words walk the arcs together."""
        found: list[tuple[int, ...] | None] = [None] * len(words)
        if not len(self.keys):
            return found
        live = np.array([i for i, w in enumerate(words) if 0 < len(w) <= self.longest], np.int64)
        if not len(live):
            return found
        lens = np.array([len(words[i]) for i in live])
        wide = np.zeros((len(live), int(lens.max())), np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in live), np.uint8)
        wide[np.arange(wide.shape[1]) < lens[:, None]] = flat
        state, row = np.full(len(live), self.start), np.zeros(len(live), np.int64)
        for k in range(wide.shape[1]):
            key = state * 256 + wide[:, k]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            row = row + np.where(ok, self.outputs[at], 0)
            state = np.where(ok, self.targets[at], 0)
            keep = ok & (lens > k + 1)
            for j in np.flatnonzero(ok & (lens == k + 1) & (self.final[state] == 1)):
                a, b = self.starts[row[j]], self.starts[row[j] + 1]
                found[live[j]] = tuple(self.ids[a:b].tolist())
            live, lens, wide, state, row = live[keep], lens[keep], wide[keep], state[keep], row[keep]
            if not len(live):
                break
        return found


# --- words of a text -------------------------------------------------------------------------------


class Splitter:
    """Cuts a text into the tokenizer's words, lower-cased and composed."""

    def __init__(self, path: str, special: Iterable[str]):
        self.path, self._library = path, None
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.marks = tuple(special)
        self.plain: set[str] = set()
        self.odd: set[str] = set()
        self.known: set[str] = set()
        self.newer: set[str] = set()

    def _is_plain(self, chars: set[str]) -> bool:
        for c in chars - self.plain - self.odd:
            kind = unicodedata.category(c)
            agreed = kind[0] == "L" and c.isalpha() or kind == "Nd" and c.isdecimal() or c in " \t\n\x0b\x0c\r\x85\xa0  " or not c.isalnum() and not c.isspace() and kind not in ("Cn", "Cs")
            (self.plain if agreed else self.odd).add(c)
        return chars <= self.plain

    def _composes_alike(self, chars: set[str]) -> bool:
        """Whether none of ``chars`` could be ordered or composed by one library's tables only.

        Marks and characters with a decomposition of later Unicode versions than 3.2 are not in all tables.
        """
        for c in chars - self.known - self.newer:
            old = unicodedata.ucd_3_2_0
            moves = unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or unicodedata.decomposition(c)
            alike = not moves or old.combining(c) == unicodedata.combining(c) and old.category(c) != "Cn" and old.decomposition(c) == unicodedata.decomposition(c)
            (self.known if alike else self.newer).add(c)
        return chars <= self.known

    def _plain_text(self, text: str) -> str | None:
        """The text composed and in lower case, None if it has characters on which the libraries may differ."""
        if text.isascii():
            return text.lower()
        if not self._composes_alike(set(text)):
            return None
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return low if self._is_plain(set(low)) else None

    def words(self, text: str) -> list[str]:
        low = self._plain_text(text)
        return self._by_library(text) if low is None else self.cut(low)

    @staticmethod
    def cut(low: str) -> list[str]:
        return (_ASCII_WORD if low.isascii() else _WORD).findall(low)

    def _by_library(self, text: str) -> list[str]:
        """Characters on which the regular expressions of the two libraries may differ."""
        from tokenizers import Tokenizer

        t = self._library = self._library or Tokenizer.from_file(self.path)
        back = {c: b for b, c in enumerate(_byte_alphabet())}
        return [bytes(back[c] for c in w).decode() for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]

    def pieces(self, text: str) -> list[str]:
        """Words, and special tokens as themselves."""
        if not any(m in text for m in self.marks):
            return self.words(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.words(part)
        return out


class Coder:
    """Encodes batches of texts; ``views`` are what a caller wants for each word, made from its ids."""

    def __init__(self, tokenizer: str, lexicon: str | None, views: list[Callable[[tuple[int, ...], Merger], object]]):
        self.merger = Merger(tokenizer)
        self.splitter = Splitter(tokenizer, list(self.merger.special))
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.views = views
        self.memo: list[dict[str, object]] = [{} for _ in views]
        self.before: list[dict[str, object]] = [{} for _ in views]

    def _learn(self, new: set[str]) -> None:
        """Resolve words that are not held: from the words held before, the lexicon, or by merges."""
        known = self.before[0]
        kept = [w for w in new if w in known]
        if kept:
            for memo, before in zip(self.memo, self.before, strict=True):
                memo.update((w, before[w]) for w in kept)
            new = new.difference(kept)
        words = list(new)
        found = self.lexicon.find([w.encode("utf-8", "surrogatepass") for w in words]) if self.lexicon else [None] * len(words)
        special = self.merger.special
        known = [(special[w],) if ids is None and w in special else ids for w, ids in zip(words, found, strict=True)]
        lacking = [k for k, ids in enumerate(known) if ids is None]
        for k, ids in zip(lacking, self.merger.merge_all([words[k] for k in lacking]), strict=True):
            known[k] = ids
        for memo, view in zip(self.memo, self.views, strict=True):
            memo.update(zip(words, [view(ids, self.merger) for ids in known], strict=True))

    def encode(self, texts: list[str]) -> Iterator[list[list]]:
        """For each text, for each view, the list of its words' values."""
        for a, b in small_batches(texts, 1_000_000):
            cut = [self.splitter.pieces(t) for t in texts[a:b]]
            need = set(chain.from_iterable(cut))
            new = need.difference(self.memo[0])
            if new and len(self.memo[0]) + len(new) > MEMO_WORDS:
                # Words in use are taken over from here when they come again; the others go at the next turn.
                self.before, self.memo, new = self.memo, [{} for _ in self.views], need
            if new:
                self._learn(new)
            for words in cut:
                yield [list(map(m.__getitem__, words)) for m in self.memo]


def plain_ids(ids: tuple[int, ...], _: Merger) -> tuple[int, ...]:
    return ids


def token_list(ids: tuple[int, ...], m: Merger) -> list[str]:
    return [m.token[i] for i in ids]


def id_text(ids: tuple[int, ...], _: Merger) -> str:
    return " ".join(map(str, ids))


def token_text(ids: tuple[int, ...], m: Merger) -> str:
    return " ".join(m.token[i] for i in ids)


def id_bytes(ids: tuple[int, ...], _: Merger) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_CODERS: dict[tuple, Coder] = {}


def coder(tokenizer: str, lexicon: str, *views: Callable) -> Coder:
    """A worker's coder of two files that were shipped; it lives on from task to task, so that words are resolved once a worker."""
    key = (tokenizer, lexicon, *(v.__qualname__ for v in views))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(SparkFiles.get(tokenizer), SparkFiles.get(lexicon), list(views))
    return _CODERS[key]


# --- on Spark --------------------------------------------------------------------------------------


def ship_file(spark: SparkSession, data: bytes, kind: str, ending: str) -> str:
    """Hand a file of fixed size to every executor, also to those that start later; returns its name for ``SparkFiles``.

    The driver's copy, from which executors fetch, goes when the driver ends.
    """
    name = f"{kind}-{hashlib.sha256(data).hexdigest()[:20]}.{ending}"
    if not any(x.endswith(name) for x in spark.sparkContext.listFiles):
        folder = tempfile.mkdtemp(prefix=f"{kind}-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def ship_tokenizer(spark: SparkSession, tokenizer: str) -> str:
    """Workers need not have the tokenizer's file where the driver has it."""
    with open(tokenizer, "rb") as f:
        return ship_file(spark, f.read(), "tokenizer", "json")


def ship_lexicon(spark: SparkSession, words: dict[str, tuple[int, ...]]) -> str:
    """Compile ``words`` and ship the file, which is bounded by the number of words."""
    with tempfile.TemporaryDirectory(prefix="lexicon-") as folder:
        path = os.path.join(folder, "lexicon")
        compile_lexicon(words, path)
        with open(path, "rb") as f:
            return ship_file(spark, f.read(), "lexicon", "bin")


def frequent_words(docs: DataFrame, tokenizer: str, n: int = LEXICON_WORDS) -> list[str]:
    """The words that occur most often in all texts: as many whole classes of frequency as ``n`` words hold."""

    shipped = ship_tokenizer(docs.sparkSession, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, counts = Splitter(SparkFiles.get(shipped), []), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(splitter.words(t))
                if len(counts) > COUNT_WORDS:
                    yield out()
                    counts = Counter()
        if counts:
            yield out()

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(count, "word string, n long")
    totals = rows.where(F.octet_length("word") <= 64).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    totals = materialize(totals.withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "word-counts")
    # A histogram of fixed size says how rare a word may be; so the driver gets n words at most, whatever the partitions.
    left, least = n, None
    for r in sorted(totals.groupBy("bin").agg(F.count("*").alias("k")).collect(), key=lambda r: -r.bin):
        left -= r.k
        if left < 0:
            break
        least = r.bin
    return [] if least is None else [r.word for r in totals.where(F.col("bin") >= least).select("word").collect()]


def corpus_lexicon(docs: DataFrame, tokenizer: str, n: int = LEXICON_WORDS) -> str:
    m = Merger(tokenizer)
    words = frequent_words(docs, tokenizer, n)
    return ship_lexicon(docs.sparkSession, dict(zip(words, m.merge_all(words), strict=True)))


def encode(docs: DataFrame, tokenizer: str, lexicon: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids array<int>, tokens array<string>`` for every row; a null text counts as empty."""
    shipped = ship_tokenizer(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shipped, lexicon, plain_ids, token_list)
        for batch in batches:
            for i, (ids, tokens) in zip(batch.column(0).to_pylist(), own.encode(batch.column(1).to_pylist()), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([[*chain.from_iterable(ids)]], pa.list_(pa.int32())), pa.array([[*chain.from_iterable(tokens)]], pa.list_(pa.string()))], ["id", "ids", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty().alias("text")).mapInArrow(run, "id long, ids array<int>, tokens array<string>").withColumnRenamed("id", id_col)


_DECODERS: dict[str, dict[int, str]] = {}


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``: the tokens of ``ids_col`` joined by one space, as the library does without a decoder. Null ids give null."""
    shipped = ship_tokenizer(rows.sparkSession, tokenizer)

    @F.pandas_udf("string")
    def tokens(ids):
        if shipped not in _DECODERS:  # read once a worker
            _DECODERS[shipped] = Merger(SparkFiles.get(shipped)).token
        token = _DECODERS[shipped]
        return ids.map(lambda x: None if x is None else " ".join(token[i] for i in x))

    return rows.withColumn("decoded", tokens(F.col(ids_col)))


def digests(docs: DataFrame, tokenizer: str, lexicon: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and the SHA-256 of its ids and of its decoded text.

    Null or empty text: 0 tokens and the digest of the empty string. Rows are independent, so repeated
    rows and repeated ids come out once each. Extra columns are ignored.
    """
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    shipped = ship_tokenizer(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(shipped, lexicon, id_text, token_text)
        for batch in batches:
            n, a, b = [], [], []
            for ids, tokens in own.encode(batch.column(1).to_pylist()):
                line = " ".join(ids)
                n.append(line.count(" ") + 1 if line else 0)
                a.append(sha(line))
                b.append(sha(" ".join(tokens)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from siftwell.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    return digests(docs, path, corpus_lexicon(docs, path))
