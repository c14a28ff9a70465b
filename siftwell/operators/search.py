"""Exact similarity search: many queries against many documents, with predicates, score floor and explanations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.errors import RetrievalError
from siftwell.functions import text as tx
from siftwell.functions import vectors as vx

#: Queries that are sent to every task as one matrix; of more, and of documents then, the rows of a block on average.
QUERY_BLOCK, DOC_BLOCK = 4096, 16_384


def object_filter(meta: str, wanted: dict) -> Column:
    """All of ``wanted`` equal, in type too; dots in a key go into nested fields. ``meta`` is a VARIANT column."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    out = F.col(meta).isNotNull()
    for key, value in wanted.items():
        path = f"$.{key}"
        if value is None:
            out &= F.is_variant_null(F.try_variant_get(meta, path, "variant"))
        else:
            native = F.schema_of_variant(F.try_variant_get(meta, path, "variant"))
            same = {bool: ["BOOLEAN"], str: ["STRING"]}.get(type(value), ["BIGINT", "DOUBLE"])
            out &= F.coalesce((native.isin(same) | native.startswith("DECIMAL") & F.lit(isinstance(value, int | float) and not isinstance(value, bool))) & (F.try_variant_get(meta, path, kinds[type(value)]) == F.lit(value)), F.lit(False))
    return out


def apply_filter(docs: DataFrame, wanted: dict | Callable[[Column], Column] | Callable[[dict], bool] | None, meta: str = "meta", python: bool = False) -> DataFrame:
    """A mapping, a function of the meta column, or (``python``) a predicate on each row's meta as a dict."""
    if wanted is None:
        return docs
    if isinstance(wanted, dict):
        return docs.where(object_filter(meta, wanted))
    if not python:
        return docs.where(wanted(F.col(meta)))
    import json

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        return s.map(lambda m: bool(wanted(json.loads(m) if m else {})))

    return docs.where(test(F.to_json(meta)))


def top_k(queries: DataFrame, docs: DataFrame, k: int = 3, *, min_score: float | None = None, query_id: str = "query_id", order: str = "seq") -> DataFrame:
    """For each query its ``k`` best documents by cosine, ties by ``order`` (a key): query_id, rank, score and the documents' columns.

    Frames have ``embedding array<double>``. Work is one matrix product a batch of documents; each task keeps
    k rows a query, so what is shuffled depends on queries and tasks, not on documents. Up to ``QUERY_BLOCK``
    queries go to every task as one matrix. More are dealt, as the documents are, into blocks of bounded size, and
    each pair of blocks is one task's work: one scan of each side, and nothing goes through the driver. Zero vectors
    score 0, other dimensions are not compared. Scores are rounded to twelve places, so that copies tie.
    """
    if k < 0:
        raise RetrievalError.invalid_top_k(k)
    k = k or 3
    asked = queries.select(query_id, F.col("embedding").cast("array<double>").alias("embedding"))
    kind, order_kind = queries.schema[query_id].dataType.simpleString(), docs.schema[order].dataType.simpleString()
    plain = docs.select(F.col(order).alias("_order"), F.col("embedding").cast("array<double>").alias("_e"))
    schema = f"{query_id} {kind}, score double, _order {order_kind}"
    many = asked.count()
    if many <= QUERY_BLOCK:
        rows = asked.orderBy(query_id).collect()
        shared = docs.sparkSession.sparkContext.broadcast(_matrices([r[0] for r in rows], [r.embedding for r in rows]))
        best = plain.mapInPandas(lambda batches: _best(shared.value, batches, k, min_score, query_id), schema)
    else:
        rows, columns = -(-many // QUERY_BLOCK), max(1, -(-docs.count() // DOC_BLOCK))
        q = asked.withColumn("_q", F.pmod(F.xxhash64(query_id), F.lit(rows)).cast("int")).withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        d = plain.withColumn("_d", F.pmod(F.xxhash64("_order"), F.lit(columns)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

        def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = [*_best(_matrices(left[query_id].tolist(), left["embedding"].tolist()), [right], k, min_score, query_id)]
            return pd.concat(found) if found else pd.DataFrame({query_id: [], "score": [], "_order": []})

        best = q.groupBy("_q", "_d").cogroup(d.groupBy("_q", "_d")).applyInPandas(pair, schema)
    w = W.partitionBy(query_id).orderBy(F.desc("score"), "_order")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    own = [c for c in docs.columns if c not in (query_id, "rank", "score")]
    return ranked.join(docs.select(*own), ranked["_order"] == docs[order]).select(query_id, "rank", "score", *own)


def _matrices(ids: list, vectors: list) -> dict[int, tuple[list, np.ndarray]]:
    """Queries by dimension, as one matrix of unit vectors each."""
    out = {}
    for dim in {len(v) for v in vectors if v is not None}:
        own = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim]
        m = np.array([vectors[i] for i in own], np.float64)
        out[dim] = [ids[i] for i in own], m / np.where((n := np.linalg.norm(m, axis=1)) == 0, 1, n)[:, None]
    return out


def _best(by_dim: dict[int, tuple[list, np.ndarray]], batches: Iterable[pd.DataFrame], k: int, floor: float | None, name: str) -> Iterator[pd.DataFrame]:
    """The ``k`` best documents of ``batches`` for each query."""
    held: dict[int, pd.DataFrame] = {}
    for pdf in batches:
        dims = pdf["_e"].map(lambda v: -1 if v is None else len(v)).to_numpy()
        for dim, (ids, matrix) in by_dim.items():
            at = np.flatnonzero(dims == dim)
            if not len(at):
                continue
            e = np.stack(pdf["_e"].iloc[at].to_numpy()).astype(np.float64)
            n = np.linalg.norm(e, axis=1)
            order = pdf["_order"].to_numpy()[at]
            by_order = np.argsort(order, kind="stable")
            e = (e / np.where(n == 0, 1, n)[:, None])[by_order]
            for lo in range(0, len(ids), 512):  # bounds the matrix of scores
                scores = np.round(e @ matrix[lo : lo + 512].T, 12)
                pick = np.argsort(-scores.T, axis=1, kind="stable")[:, :k]
                new = pd.DataFrame({name: np.repeat(np.array(ids[lo : lo + 512], object), pick.shape[1]), "score": np.take_along_axis(scores.T, pick, 1).ravel(), "_order": order[by_order][pick].ravel()})
                both = pd.concat([held[dim, lo], new]) if (dim, lo) in held else new
                held[dim, lo] = both.sort_values([name, "score", "_order"], ascending=[True, False, True]).groupby(name, sort=False).head(k)
    for out in held.values():
        yield out[out["score"] >= floor] if floor is not None else out


def with_explanation(hits: DataFrame, query: str = "query", text: str = "text", meta: str | None = None) -> DataFrame:
    """Adds ``explanation``: terms of the query, those found in the text, their share and the similarity."""
    terms = tx.query_terms(F.col(query))
    hits = hits.withColumn("_terms", terms).withColumn("_matched", tx.matched(F.col("_terms"), F.col(text)))
    ratio = F.coalesce(F.size("_matched") / F.nullif(F.size("_terms"), F.lit(0)), F.lit(0.0))
    parts = [
        F.col("score"), F.concat(F.lit("Matched query with similarity score of "), F.format_string("%.1f", F.col("score") * 100), F.lit("%")).alias("reason"),
        F.col("_terms").alias("queryTerms"), F.col("_matched").alias("matchedTerms"), F.size("_matched").alias("matchCount"), ratio.alias("matchRatio"), F.col("score").alias("cosineSimilarity"),
        F.struct(F.col("score").alias("semanticScore"), ratio.alias("termMatch")).alias("relevanceFactors"),
    ]
    if meta:
        parts.append(F.col(meta).alias("metadata"))
    return hits.withColumn("explanation", F.struct(*parts)).drop("_terms", "_matched")


def text_search(docs: DataFrame, queries: DataFrame, k: int = 3, embed: Callable[[Column], Column] = vx.char_embed, **options) -> DataFrame:
    """``top_k`` for texts: ``queries(query_id, query)`` against ``docs(seq, text, ...)``; given embeddings on either side are kept."""
    hits = top_k(_embedded(queries, "query", embed), _embedded(docs, "text", embed), k, **options)
    return hits.join(queries.select("query_id", "query"), "query_id")


def _embedded(rows: DataFrame, text: str, embed: Callable[[Column], Column]) -> DataFrame:
    """Only rows without an embedding are embedded."""
    if "embedding" not in rows.columns:
        return rows.withColumn("embedding", embed(F.col(text)))
    if not rows.schema["embedding"].nullable:
        return rows
    kind = F.col("embedding").cast("array<double>")
    lacking = rows.where("embedding IS NULL").withColumn("embedding", embed(F.col(text)))
    return rows.where("embedding IS NOT NULL").withColumn("embedding", kind).unionByName(lacking)


class Retriever:
    """Defaults for k and filter around ``text_search``; a filter given with a call overrides the default. ``order`` is the documents' key."""

    def __init__(self, docs: DataFrame, k: int = 3, filter=None, embed=vx.char_embed, order: str = "seq"):  # noqa: A002
        self.docs, self.embed, self.order = docs, embed, order
        self.configure(k, filter)

    def configure(self, k: int | None = None, filter=None) -> None:  # noqa: A002
        self.k, self.filter = k or 3, filter

    def get_relevant(self, queries: DataFrame, k: int | None = None, *, filter=None, filters=None, explain: bool = False, min_score: float | None = None) -> DataFrame:  # noqa: A002
        wanted = filter if filter is not None else self.filter if self.filter is not None else filters
        hits = text_search(apply_filter(self.docs, wanted), queries, k or self.k, self.embed, min_score=min_score, order=self.order)
        return with_explanation(hits, meta="meta" if "meta" in self.docs.columns else None) if explain else hits
