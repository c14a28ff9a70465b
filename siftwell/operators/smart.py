"""Smart retrieval: rules on queries, twice as many candidates as asked for, re-ranking, and learning from feedback.

Queries are a frame, and rules are columns over it, so a rule costs one expression for all queries. What is
learned is bounded (the last hundred queries, ten patterns) and kept on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators import ranking, rules
from siftwell.operators.search import Retriever


@dataclass
class QueryRule:
    """``condition`` says for which queries it holds; it may suggest, replace the query, or set some weights."""

    condition: Callable[[Column], Column]
    suggestion: str | None = None
    rewrite: Callable[[Column], Column] | None = None
    weights: dict[str, float] = field(default_factory=dict)
    priority: int = 0


def default_rules() -> dict[str, QueryRule]:
    word = lambda pattern: lambda q: q.rlike(f"(?i){pattern}")
    say = rules.SUGGEST
    return {
        "expand-short-query": QueryRule(lambda q: F.size(F.split(q, " ", -1)) == 1, say["expand-short-query"], priority=5),
        "suggest-technical-filters": QueryRule(word(rules.TECHNICAL), say["suggest-technical-filters"], priority=3),
        "boost-recent-for-news": QueryRule(word(rules.NEWS), say["boost-recent-for-news"], weights=rules.NEWS_WEIGHTS, priority=8),
    }


@dataclass
class SmartResponse:
    """``results``: query_id, final_rank, the document and its scores. ``decisions``, one row a query: query, original_query,
    applied_rules, suggestions, weights, results_modified."""

    results: DataFrame
    decisions: DataFrame


def _with(base: Column, weights: dict[str, float]) -> Column:
    """A map of weights with some of them replaced."""
    own = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    return F.transform_values(base, lambda k, v: F.coalesce(own[k], v))


class SmartRetriever:
    """Rules, search for 2k candidates, weighted scores, duplicates out, patterns, the best k.

    ``weights`` are the factors' weights. A rule's own weights count for a query only where a call brings weights
    too, as they replace some of those.
    """

    def __init__(self, retriever: Retriever, weights: dict[str, float] | None = None, enable_learning: bool = True):
        self.retriever, self.weights, self.enable_learning = retriever, ranking.Weights(weights), enable_learning
        self.rules, self.patterns, self.history = default_rules(), [], []

    def add_rule(self, name: str, rule: QueryRule) -> None:
        self.rules[name] = rule

    def _in_order(self) -> list[tuple[str, QueryRule]]:
        return sorted(self.rules.items(), key=lambda x: -x[1].priority)

    def decide(self, queries: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
        """``query_id, original_query, query, applied_rules, suggestions, weights`` (a map, normalised)."""
        original, now = F.col("query"), F.col("query")
        applied, said, base = [], [], F.create_map(*(F.lit(x) for kv in (ranking.DEFAULT_WEIGHTS | (weights or self.weights.values)).items() for x in kv))
        for name, rule in self._in_order():
            holds = F.coalesce(rule.condition(original), F.lit(False))
            applied.append(F.when(holds, F.lit(name)))
            if rule.suggestion:
                said.append(F.when(holds, F.lit(rule.suggestion)))
            if rule.rewrite:
                now = F.when(holds, rule.rewrite(now)).otherwise(now)
            if rule.weights and weights:
                base = F.when(holds, _with(base, rule.weights)).otherwise(base)
        listed = lambda cs: F.filter(F.array(*cs).cast("array<string>"), lambda x: x.isNotNull()) if cs else F.array().cast("array<string>")
        out = queries.select("query_id", original.alias("original_query"), now.alias("query"), listed(applied).alias("applied_rules"), listed(said).alias("suggestions"), base.alias("weights"))
        total = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, x: a + x)
        return out.withColumn("weights", F.transform_values("weights", lambda k, v: F.when(F.abs(total - 1) > 0.01, v / total).otherwise(v)))

    def get_relevant(self, queries: DataFrame, k: int, *, as_of: Column, filter=None, weights: dict[str, float] | None = None, context_relevance: float = 0.5, critical: bool = False, min_score: float | None = None, source: str = "source", date: str = "date") -> SmartResponse:  # noqa: A002
        """``queries`` (query_id, query, and an embedding where the retriever's documents have theirs)."""
        decided = self.decide(queries, weights)
        own = [c for c in queries.columns if c not in ("query_id", "query")]
        asked = decided.select("query_id", "query").join(queries.select("query_id", *own), "query_id") if own else decided.select("query_id", "query")
        hits = self.retriever.get_relevant(asked, 2 * k, filter=filter, min_score=min_score)
        missing = [F.lit(None).cast("string").alias(c) for c in (source, date) if c not in hits.columns]
        hits = hits.select("*", *missing).join(decided.select("query_id", "weights"), "query_id")
        hits = hits.withColumnsRenamed({k: v for k, v in ((source, "source"), (date, "date")) if k != v})
        best = ranking.rerank(hits, k, as_of, weights=dict.fromkeys(ranking.DEFAULT_WEIGHTS), weight_of=F.col("weights"), context_relevance=context_relevance, critical=critical, patterns=self.patterns)
        if "boosted" not in best.columns:
            best = best.withColumn("boosted", F.lit(False))
        modified = best.groupBy("query_id").agg(F.max("boosted").alias("results_modified"))
        decisions = decided.join(modified, "query_id", "left").withColumn("results_modified", F.coalesce("results_modified", F.lit(False)))
        return SmartResponse(best.drop("weights"), decisions)

    def provide_feedback(self, results: DataFrame, feedback: DataFrame | None = None) -> None:
        """Learn from ``results`` (query_id, query, score); ``feedback``: query_id, rating. Does nothing when learning is off."""
        if not self.enable_learning:
            return
        asked = rules.learn(results).join(results.select("query_id", "query").distinct(), "query_id")
        rated = asked.join(feedback.select("query_id", "rating"), "query_id", "left") if feedback is not None else asked.withColumn("rating", F.lit(0))
        last = rated.orderBy(F.desc("query_id")).limit(rules.HISTORY).collect()
        for r in reversed(last):
            self.history.append({"query": r.query.lower(), "resultCount": r.result_count, "avgScore": r.avg_score, "feedback": r.rating or 0, "queryLength": len(r.query.split(" "))})
        self.history = self.history[-rules.HISTORY :]
        self._derive(results.sparkSession)

    def _derive(self, spark) -> None:
        rows = [(i, h["query"], h["feedback"], h["queryLength"], float(h["avgScore"])) for i, h in enumerate(self.history)]
        frame = spark.createDataFrame(rows, "seq long, query string, feedback int, query_length int, avg_score double")
        if rules.too_many_short(frame).first()[0]:
            self.add_rule(rules.LEARNED, QueryRule(lambda q: F.size(F.split(q, " ", -1)) <= 2, rules.LEARNED_SUGGESTION, priority=10))
        if sum(h["feedback"] >= 4 for h in self.history) > 10:
            self.patterns = [r.term for r in rules.mine_patterns(frame).collect()]

    def insights(self, spark) -> dict:
        """What was learned, as numbers; without history all are 0."""
        rows = [(h["queryLength"], float(h["avgScore"]), h["feedback"]) for h in self.history]
        got = rules.insights(spark.createDataFrame(rows, "query_length int, avg_score double, feedback int")).first().asDict()
        return {**{k: v or 0 for k, v in got.items()}, "detected_patterns": len(self.patterns), "active_rules": len(self.rules), "successful_patterns": self.patterns, "weights": self.weights.values}

    def export_knowledge(self) -> str:
        return json.dumps({"rules": list(self.rules), "patterns": self.patterns, "history": self.history[-20:]})

    def import_knowledge(self, text: str) -> None:
        got = json.loads(text)
        self.patterns, self.history = got.get("patterns", self.patterns), got.get("history", self.history)


def create_smart_retriever(retriever: Retriever, **options) -> SmartRetriever:
    return SmartRetriever(retriever, **options)
