"""Chunkers: one text to an array of chunks, as columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import trim_all
from siftwell.functions.vectors import let

_EMPTY = "array<string>"


def windows(text: Column, size: int, step: int) -> Column:
    """Trimmed windows of ``size`` characters, a new one each ``step`` until the end is passed."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    return F.transform(starts, lambda i: trim_all(F.substr(text, i + 1, F.lit(size))))


def chunk_text(text: Column, size: int = 500, overlap: int = 50, separator: str = "\n\n") -> Column:
    """Segments packed greedily up to ``size``; a larger segment is cut into overlapping windows.

    A text that fits stays whole and untouched; null and empty texts have no chunks. Blank segments go.
    One pass over the lengths of the segments finds where chunks begin; they are then put together once.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the chunk size")
    gap = len(separator)

    def grouped(segments: Column) -> Column:
        # The length that is held after each segment, as one string of marks: "n" begins a chunk, "j" joins, "w" is cut into windows.
        lengths = F.transform(segments, F.length)

        def step(acc: Column, n: Column) -> Column:
            mark = F.when(n > size, "w").when(acc["held"] + n + gap <= size, F.when(acc["held"] == 0, "n").otherwise("j")).otherwise("n")
            held = F.when(n > size, F.lit(0)).when(mark == "j", acc["held"] + n + gap).otherwise(n)
            return F.struct(held.alias("held"), F.concat(acc["marks"], mark).alias("marks"))

        marks = F.aggregate(lengths, F.struct(F.lit(0).alias("held"), F.lit("").alias("marks")), step, lambda acc: acc["marks"])
        return let(F.split(F.regexp_replace(marks, "(?<=.)(?=[nw])", " "), " "), lambda runs: put_together(segments, runs))

    def put_together(segments: Column, runs: Column) -> Column:
        ends = let(F.transform(runs, F.length), lambda ls: running(ls))
        return let(ends, lambda e: F.flatten(F.transform(runs, lambda r, i: chunk(F.slice(segments, F.get(e, i) - F.length(r) + 1, F.length(r)), r))))

    def chunk(own: Column, run: Column) -> Column:
        joined = trim_all(F.array_join(own, separator))
        return F.when(run.startswith("w"), windows(F.get(own, F.lit(0)), size, size - overlap)).when(joined != "", F.array(joined)).otherwise(F.array().cast(_EMPTY))

    segments = F.filter(F.split(text, f"\\Q{separator}\\E", -1), lambda s: trim_all(s) != "")
    packed = let(segments, lambda s: F.when(F.size(s) > 0, grouped(s)).otherwise(F.array().cast(_EMPTY)))
    return F.when(text.isNull() | (text == ""), F.array().cast(_EMPTY)).when(F.length(text) <= size, F.array(text)).otherwise(packed)


_RUN = 64


def running(numbers: Column) -> Column:
    """Running totals of an array: whole runs are added up first, so that work does not grow with the square."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def all_of(runs: Column) -> Column:
        return F.transform(numbers, lambda n, i: (total(F.slice(runs, F.lit(1), F.floor(i / _RUN).cast("int"))) + total(F.slice(numbers, F.floor(i / _RUN).cast("int") * _RUN + 1, i % _RUN + 1))).cast("int"))

    return let(F.transform(F.sequence(F.lit(0), F.size(numbers), F.lit(_RUN)), lambda i: total(F.slice(numbers, i + 1, _RUN))), all_of)


def sentences(text: Column) -> Column:
    """Cut after . ! ? before white space, and at each pipe."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1|"), r"\|"), trim_all), lambda s: s != "")


def chunk_sentences(text: Column, per_chunk: int = 5, overlap: int = 1) -> Column:
    if not 0 <= overlap < per_chunk:
        raise ValueError("the overlap must be less than the sentences of a chunk")
    step = per_chunk - overlap

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i - step + per_chunk < F.size(s)))
        return F.when(F.size(s) <= per_chunk, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(s, i + 1, per_chunk), " ")))

    return F.when(text.isNull() | (text == ""), F.array().cast(_EMPTY)).otherwise(let(sentences(text), cut))


def markdown_chunks(text: str | None, size: int = 1000, overlap: int = 100) -> list[str | None]:
    """By lines, so that a chunk with its line breaks keeps to ``size`` unless one line or an open fence exceeds it.

    No chunk ends within a fence. Of each chunk as many last lines are carried into the next as ``overlap`` has
    fifties, the empty one after the last line break counted; an overlap under 50 carries all of it.
    """
    if not text or len(text) <= size:
        return [text]
    lines = text.split("\n")
    ends = np.cumsum([0, *(len(line) + 1 for line in lines)])  # where each line ends, break included
    fences = np.cumsum([line.strip().startswith("```") for line in lines])
    open_to_cut = np.flatnonzero(fences % 2 == 0)  # lines before which a chunk may end
    out, carried, first = [], [], 0
    while first < len(lines):
        before = sum(len(line) + 1 for line in carried)
        over = int(np.searchsorted(ends, size - before + ends[first], "right")) - 1  # the first line that is too much
        at = int(np.searchsorted(open_to_cut, max(over, first + 1)))  # a chunk has one line of its own at least
        stop = int(open_to_cut[at]) if at < len(open_to_cut) else len(lines)
        held = carried + lines[first:stop]
        if whole := ("\n".join(held) + "\n").strip():
            out.append(whole)
        held.append("")
        carried, first = held[-(overlap // 50) :], stop
    return out


def chunk_markdown(text: Column, size: int = 1000, overlap: int = 100) -> Column:
    @F.pandas_udf(_EMPTY)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: markdown_chunks(t, size, overlap))

    return run(text)


def chunk_documents(docs: DataFrame, id_col: str = "id", order_col: str | None = None, **options) -> DataFrame:
    """One row a chunk, with the document's columns, and chunk_id, chunk_index, total_chunks, original_id."""
    rows = docs.withColumn("_chunks", chunk_text(F.col("text"), **options))
    rows = rows.select(*[c for c in docs.columns if c != "text"], F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "text"))
    return rows.withColumn("original_id", F.col(id_col)).withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))
