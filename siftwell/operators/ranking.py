"""Weighted re-ranking of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.functions import text as tx

#: Factors and their default weights.
DEFAULT_WEIGHTS = {"semanticSimilarity": 0.5, "keywordMatch": 0.2, "recency": 0.15, "sourceQuality": 0.1, "contextRelevance": 0.05}
#: Parts of a source's name and the quality they stand for; the first that is found counts.
SOURCE_QUALITY = [("official", 1.0), ("documentation", 0.95), ("research", 0.9), ("blog", 0.7), ("tutorial", 0.75), ("forum", 0.6), ("social", 0.5), ("unknown", 0.5)]


def normalize(weights: dict[str, float]) -> dict[str, float]:
    """Divided by their sum unless that is within 0.01 of 1."""
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if abs(total - 1) > 0.01 and total else dict(weights)


class Weights:
    def __init__(self, weights: dict[str, float] | None = None):
        self.values = normalize(DEFAULT_WEIGHTS | (weights or {}))

    def set(self, weights: dict[str, float]) -> None:
        self.values = normalize(self.values | weights)

    def adjust(self, factor: str, by: float) -> None:
        if factor in self.values:
            self.values = normalize(self.values | {factor: min(1.0, max(0.0, self.values[factor] + by))})


def recency(date: Column, as_of: Column) -> Column:
    """exp(-days / 180), 0.1 at least; 0.5 where no date can be read."""
    when = F.try_to_timestamp(date.cast("string"))
    days = (F.unix_micros(as_of) - F.unix_micros(when)) / F.lit(86400e6)
    return F.when(when.isNull(), F.lit(0.5)).otherwise(F.greatest(F.lit(0.1), F.exp(-days / 180)))


def source_quality(source: Column) -> Column:
    low = F.lower(source)
    out = F.when(source.isNull() | (source == ""), F.lit(0.5))
    for part, value in SOURCE_QUALITY:
        out = out.when(low.contains(part), F.lit(value))
    return out.otherwise(F.lit(0.5))


def keyword_match(query: Column, text: Column) -> Column:
    terms = tx.query_terms(query)
    return F.coalesce(F.size(tx.matched(terms, text)) / F.nullif(F.size(terms), F.lit(0)), F.lit(0.0))


def score(hits: DataFrame, factors: dict[str, Column], weights: dict[str, float] = DEFAULT_WEIGHTS, weight_of: Column | None = None) -> DataFrame:
    """Adds ``weighted_score``, ``score_breakdown`` (score, weight and share of each factor) and ``original_score``.

    ``weight_of``, a map, gives each row its own weights for the factors that ``weights`` names.
    """
    given = weights
    weights = {k: F.lit(w) if weight_of is None else F.coalesce(weight_of[k], F.lit(0.0)) for k, w in given.items()}
    part = lambda k: F.coalesce(factors.get(k, F.lit(0.0)), F.lit(0.0))
    breakdown = F.struct(*(F.struct(part(k).alias("score"), w.alias("weight"), (part(k) * w).alias("contribution")).alias(k) for k, w in weights.items()))
    out = hits.withColumn("score_breakdown", breakdown).withColumn("original_score", F.col("score"))
    return out.withColumn("weighted_score", sum((F.col(f"score_breakdown.{k}.contribution") for k in weights), F.lit(0.0)))


def answer_quality(scored: DataFrame, query_id: str = "query_id") -> DataFrame:
    """``query_id, similarity, recency, source_quality, coverage``: means over the results of ``score``."""
    mean = lambda k, name: F.avg(F.col(f"score_breakdown.{k}.score")).alias(name)
    return scored.groupBy(query_id).agg(mean("semanticSimilarity", "similarity"), mean("recency", "recency"), mean("sourceQuality", "source_quality"), mean("keywordMatch", "coverage"))


def remove_duplicates(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Of results of a query that agree in their first hundred characters the best ranked stays."""
    w = W.partitionBy(query_id, "_print").orderBy(F.desc("weighted_score"), "rank")
    return hits.withColumn("_print", tx.fingerprint(F.col("text"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_print")


def boost(hits: DataFrame, patterns: list[str]) -> DataFrame:
    """Raises ``score`` by 0.05 for each learned pattern in the text, to 1 at most; order and weighted score stay."""
    found = F.size(F.filter(F.array(*map(F.lit, patterns)).cast("array<string>"), lambda p: F.contains(F.lower(F.col("text")), p)))
    return hits.withColumn("boosted", found > 0).withColumn("score", F.when(found > 0, F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0)) + 0.05 * found)).otherwise(F.col("score")))


def drop_low_quality(hits: DataFrame, source: str = "source") -> DataFrame:
    """For critical questions: no social, forum or comment sources that score under 0.6."""
    low = F.lower(F.coalesce(F.col(source), F.lit(""))).rlike("social|forum|comment") & (F.coalesce("score", F.lit(0.0)) < 0.6)
    return hits.where(~low)


def rerank(hits: DataFrame, k: int, as_of: Column, *, weights: dict[str, float] = DEFAULT_WEIGHTS, weight_of: Column | None = None, context_relevance: float = 0.5, critical: bool = False, patterns: list[str] | None = None) -> DataFrame:
    """Of up to 2k candidates a query (query_id, query, rank, score, text, source, date) the best k by weighted score."""
    scored = score(
        hits,
        {
            "semanticSimilarity": F.col("score"), "keywordMatch": keyword_match(F.col("query"), F.col("text")), "recency": recency(F.col("date"), as_of),
            "sourceQuality": source_quality(F.col("source")), "contextRelevance": F.lit(context_relevance or 0.5),
        },
        weights, weight_of,
    )
    # Sums of products differ in their last places by the order of work; ranks must not.
    scored = scored.withColumn("weighted_score", F.round("weighted_score", 9))
    out = remove_duplicates(scored)
    out = boost(out, patterns) if patterns else out
    out = drop_low_quality(out) if critical else out
    w = W.partitionBy("query_id").orderBy(F.desc("weighted_score"), "rank")
    return out.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= k)
