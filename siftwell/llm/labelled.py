"""Bounded, balanced samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a text that may be sampled; longer ones are scored like any other, but not learned from.
MAX_CHARS = 30_000


def sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels of at most ``per_class`` rows of each class, and the rows that each class has.

    ``learn`` is the condition on doc_id for rows that may be learned from. Rows with a null id or label
    are left out. The choice follows a hash of the id and so is the same in every run. An id that is there
    several times counts once, with its least text; null text is empty. The sample is bounded by
    ``per_class`` and ``MAX_CHARS``. Without labels it is empty.
    """
    use = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {int(r.label): r.n for r in use.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # Each task keeps its first few; no rows are dealt by class.
    first = lambda c: use.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    ids = [(r.doc_id, int(r.label)) for c in sorted(counts) for r in first(c).collect()]
    if not ids:
        return [], [], counts
    kind = labels.schema["doc_id"].dataType.simpleString()
    chosen = F.broadcast(docs.sparkSession.createDataFrame(ids, f"doc_id {kind}, label int"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").where(F.length("text") <= MAX_CHARS)
    got = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r.doc_id)
    return [r.text for r in got], [int(r.label) for r in got], counts


def crc_of_id(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("long").cast("string"))
