"""Rules on queries, and what is learned from the history of queries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY = 100
#: Words that tell a time-sensitive and a technical query.
NEWS, TECHNICAL = r"\b(latest|new|recent|current|today)\b", r"\b(code|api|function|error|bug)\b"
#: What the built-in rules say.
SUGGEST = {
    "boost-recent-for-news": "Time-sensitive query detected. Prioritizing recent documents.",
    "expand-short-query": "Single-word queries may return broad results. Consider adding more context.",
    "suggest-technical-filters": "Technical query detected. Consider filtering by source:documentation or source:official",
}
#: Weights that a time-sensitive query sets.
NEWS_WEIGHTS = {"recency": 0.4, "semanticSimilarity": 0.35}
#: The rule that is learned from short queries with poor results, and what it says.
LEARNED, LEARNED_SUGGESTION = "expand-short-queries", "Consider adding more specific terms to improve results"


@dataclass
class Rule:
    condition: Callable[[str, dict], bool]
    action: Callable[[str, dict], dict | None]
    priority: int = 0


@dataclass
class RuleEngine:
    """Rules by name, applied by descending priority; conditions see the query as asked, actions as changed so far."""

    rules: dict[str, Rule] = field(default_factory=dict)
    patterns: list[str] = field(default_factory=list)

    @classmethod
    def with_defaults(cls) -> RuleEngine:
        e, say = cls(), lambda name: lambda q, c: {"query": q, "suggestion": SUGGEST[name]}

        def news(q: str, c: dict) -> dict:
            if "weights" in c:
                c["weights"] = c["weights"] | NEWS_WEIGHTS
            return {"query": q, "suggestion": SUGGEST["boost-recent-for-news"]}

        e.add("expand-short-query", lambda q, c: len(q.split(" ")) == 1, say("expand-short-query"), 5)
        e.add("suggest-technical-filters", lambda q, c: bool(re.search(TECHNICAL, q, re.I)), say("suggest-technical-filters"), 3)
        e.add("boost-recent-for-news", lambda q, c: bool(re.search(NEWS, q, re.I)), news, 8)
        return e

    def add(self, name: str, condition, action, priority: int = 0) -> None:
        self.rules[name] = Rule(condition, action, priority)

    def apply(self, query: str, context: dict) -> dict:
        now, suggestions, applied = query, [], []
        for name, rule in sorted(self.rules.items(), key=lambda x: -x[1].priority):
            if rule.condition(query, context):
                got = rule.action(now, context) or {}
                now = got.get("query", now)
                suggestions += [got["suggestion"]] if got.get("suggestion") else []
                applied.append(name)
        return {"originalQuery": query, "modifiedQuery": now, "suggestions": suggestions, "appliedRules": applied}

    def export(self, history: list[dict]) -> str:
        return json.dumps({"rules": list(self.rules), "patterns": self.patterns, "history": history[-20:]})

    def load(self, text: str) -> list[dict]:
        got = json.loads(text)
        self.patterns = got.get("patterns", [])
        return got.get("history", [])


def query_flags(query: Column) -> list[Column]:
    """The built-in rules' conditions for a whole frame of queries."""
    return [query.rlike(f"(?i){NEWS}").alias("news"), (F.size(F.split(query, " ", -1)) == 1).alias("short"), query.rlike(f"(?i){TECHNICAL}").alias("technical")]


def bounded_history(history: DataFrame, order: list[Column], keep: int = HISTORY) -> DataFrame:
    """The last ``keep`` rows."""
    return history.orderBy(*[c.desc() for c in order]).limit(keep)


def mine_patterns(history: DataFrame, rating: str = "feedback", query: str = "query", order: str = "seq") -> DataFrame:
    """``term, n``: the ten words most found in well rated queries, three times at least; ties by first use.

    Nothing is learned from ten such queries or fewer.
    """
    good = history.where(F.col(rating) >= 4)
    words = good.select(F.col(order).alias("o"), F.posexplode(F.split(F.col(query), " ", -1)).alias("p", "term"))
    counts = words.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("o", "p")).alias("first")).where("n >= 3")
    return counts.where(good.agg(F.count("*") > 10).scalar()).orderBy(F.desc("n"), "first").limit(10).select("term", "n")


def too_many_short(history: DataFrame) -> DataFrame:
    """Whether more than five queries of two words or fewer scored under 0.6 on average."""
    return history.agg((F.count_if((F.col("query_length") <= 2) & (F.col("avg_score") < 0.6)) > 5).alias("expand_short_queries"))


def insights(history: DataFrame) -> DataFrame:
    rated = F.when(F.col("feedback") > 0, F.col("feedback"))
    return history.agg(
        F.count("*").alias("total_queries"), F.round(F.avg("query_length"), 2).alias("avg_query_length"), F.round(F.avg("avg_score"), 3).alias("avg_score"),
        F.round(F.coalesce(F.avg(rated), F.lit(0.0)), 2).alias("avg_rating"), F.count(rated).alias("rated"),
    )


def learn(results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One history row a query: its mean score (0 for missing ones) and number of results."""
    return results.groupBy(query_id).agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("avg_score"), F.count("*").alias("result_count"))


def running_average(rows: DataFrame, value: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*(by or [])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running_avg", F.avg(value).over(w))
