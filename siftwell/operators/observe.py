"""Metrics and telemetry over event frames, and their exports."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections import Counter
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import ConfigurationError


def metrics_summary(events: DataFrame, kind: str = "kind", value: str = "duration") -> DataFrame:
    """Number, mean and sum by kind; a missing value adds 0 and counts."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return events.groupBy(kind).agg(F.count("*").alias("total"), F.round(F.sum(v) / F.count("*"), 2).alias("avg_value"), F.round(F.sum(v), 2).alias("sum_value"))


def throughput(count: Column, millis: Column) -> Column:
    return count / F.nullif(millis / 1000, F.lit(0.0))


def metrics_report(rows: DataFrame) -> DataFrame:
    """One row a ``kind``: ``total``, and the mean of each of ``MEANS`` and the sum of each of ``SUMS`` that the rows have.

    Missing values add 0 and count, as published. Means are rounded to two places.
    """
    mean = lambda c: F.round(F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) / F.count("*"), 2).alias(f"avg_{c}")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"total_{c}")
    return rows.groupBy("kind").agg(F.count("*").alias("total"), *(mean(c) for c in MEANS if c in rows.columns), *(total(c) for c in SUMS if c in rows.columns))


MEANS = ("duration", "top_score", "throughput", "results_count", "tokens_per_second")
SUMS = ("doc_count",)
#: The published series, their kinds and help lines.
SERIES = [
    ("rag_queries_total", "counter", "Total number of queries"), ("rag_query_duration_avg", "gauge", "Average query duration in ms"),
    ("rag_embeddings_total", "counter", "Total number of embedding operations"), ("rag_documents_embedded", "counter", "Total documents embedded"),
    ("rag_errors_total", "counter", "Total number of errors"),
]


def prometheus(summary: dict[str, float]) -> str:
    """Text exposition of the five published series, from their values by name."""
    return "\n".join(f"# HELP {n} {text}\n# TYPE {n} {kind}\n{n} {summary.get(n, 0)}" for n, kind, text in SERIES)


def session_summary(events: DataFrame, session: str, kind: str = "event_type", ts: str = "ts") -> DataFrame:
    """Events by session: total, duration in seconds and counts by type as a map."""
    by = events.groupBy(session, kind).agg(F.count("*").alias("n"), F.min(ts).alias("a"), F.max(ts).alias("z"))
    return by.groupBy(session).agg(F.sum("n").alias("total"), (F.unix_micros(F.max("z").cast("timestamp")) - F.unix_micros(F.min("a").cast("timestamp"))).alias("duration_us"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))


def telemetry_csv(ts: Column, kind: Column, properties: Column) -> Column:
    """The line format timestamp,type,properties with the JSON unquoted."""
    return F.concat_ws(",", ts, kind, properties)


def telemetry_json(events: DataFrame, ts: str = "ts", kind: str = "event_type", properties: str = "properties") -> DataFrame:
    """``value``: one JSON object an event, to be written by ``df.write.text``."""
    return events.select(F.to_json(F.struct(F.col(ts).alias("timestamp"), F.col(kind).alias("eventType"), F.col(properties).alias("properties"))).alias("value"))


#: Event types by name.
EVENTS = {
    "RAG_QUERY": "rag.query", "DOCUMENT_ADD": "document.add", "DOCUMENT_UPDATE": "document.update", "DOCUMENT_DELETE": "document.delete",
    "EMBEDDING_CREATE": "embedding.create", "SEARCH_EXECUTE": "search.execute", "ERROR_OCCURRED": "error.occurred", "MODEL_LOAD": "model.load",
}


def _now() -> int:
    return int(time.time() * 1000)


class Metrics:
    """Driver-side records of single operations; ``frame`` hands them to ``metrics_report``."""

    KINDS = ("query", "embedding", "retrieval", "generation", "error")
    COLUMNS = "kind string, timestamp long, duration double, query string, result_count long, top_score double, doc_count long, dimension long, throughput double, k long, results_count long, model string, prompt_length long, response_length long, tokens_per_second double, operation string, error string, code string, context string"

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.rows: list[dict] = []
        self.began = _now()

    def _add(self, kind: str, **values) -> None:
        self.rows.append({"kind": kind, "timestamp": _now(), **values})

    def record_query(self, query: str, scores: list[float], duration: float) -> None:
        self._add("query", query=query, result_count=len(scores), top_score=float(scores[0]) if scores else 0.0, duration=float(duration))

    def record_embedding(self, doc_count: int, dimension: int, duration: float) -> None:
        self._add("embedding", doc_count=doc_count, dimension=dimension, duration=float(duration), throughput=doc_count / (duration / 1000) if duration else None)

    def record_retrieval(self, query: str, k: int, results_count: int, duration: float) -> None:
        self._add("retrieval", query=query, k=k, results_count=results_count, duration=float(duration))

    def record_generation(self, model: str, prompt_length: int, response_length: int, duration: float) -> None:
        self._add("generation", model=model, prompt_length=prompt_length, response_length=response_length, duration=float(duration), tokens_per_second=response_length / (duration / 1000) if duration else None)

    def record_error(self, operation: str, error: BaseException, **context) -> None:
        self._add("error", operation=operation, error=str(error), code=getattr(error, "code", None), context=json.dumps(context) if context else None)

    def raw(self) -> dict[str, list[dict]]:
        return {kind: [r for r in self.rows if r["kind"] == kind] for kind in self.KINDS}

    def frame(self, spark: SparkSession) -> DataFrame:
        names = [c.split()[0] for c in self.COLUMNS.split(", ")]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in self.rows], self.COLUMNS)

    def summary(self, spark: SparkSession) -> dict:
        """Totals and means by kind, the time since the start in ms, and errors a second."""
        up = max(1, _now() - self.began)
        got = {r.kind: {k: v for k, v in r.asDict().items() if k != "kind"} for r in metrics_report(self.frame(spark)).collect()}
        errors = got.get("error", {}).get("total", 0)
        return {"uptime": up, **{k: got.get(k, {"total": 0}) for k in self.KINDS}, "error_rate": round(errors / (up / 1000), 4)}

    def export_json(self, spark: SparkSession) -> str:
        return json.dumps({"summary": self.summary(spark), "raw": self.raw()}, indent=2)

    def export_prometheus(self, spark: SparkSession) -> str:
        s = self.summary(spark)
        return prometheus({"rag_queries_total": s["query"]["total"], "rag_query_duration_avg": s["query"].get("avg_duration", 0), "rag_embeddings_total": s["embedding"]["total"], "rag_documents_embedded": s["embedding"].get("total_doc_count", 0), "rag_errors_total": s["error"]["total"]})


METRICS = Metrics()


def measured(kind: str, into: Metrics = METRICS):
    """Record each call of a function as a query, an embedding or a retrieval; failures as errors.

    A query function returns hits with a score, an embedding function takes a list of texts and a dimension, a
    retrieval function takes a query and k and returns hits.
    """

    def wrap(fn):
        @wraps(fn)
        def run(*args, **kwargs):
            began = time.monotonic()
            try:
                out = fn(*args, **kwargs)
            except Exception as e:
                into.record_error(fn.__name__, e)
                raise
            took = (time.monotonic() - began) * 1000
            size = lambda x: len(x) if hasattr(x, "__len__") else 0
            if kind == "query":
                into.record_query(args[0], [h["score"] for h in out or []], took)
            elif kind == "embedding":
                into.record_embedding(len(args[0]) if isinstance(args[0], list | tuple) else 1, args[1] if len(args) > 1 else 768, took)
            elif kind == "retrieval":
                into.record_retrieval(args[0], args[1] if len(args) > 1 else 3, size(out), took)
            return out

        return run

    return wrap


class Telemetry:
    """A session's events on the driver; ``frame`` hands them to the frame functions above."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.events: list[dict] = []
        self.session, self.began = f"session_{_now()}_{uuid.uuid4().hex[:9]}", _now()

    def track(self, kind: str, **properties) -> None:
        self.events.append({"sessionId": self.session, "timestamp": _now(), "eventType": kind, "properties": properties})

    def track_query(self, query: str, model: str, result_count: int, duration: float) -> None:
        """The query itself is not kept, only its hash."""
        self.track(EVENTS["RAG_QUERY"], query=base36(hash32(query)), model=model, resultCount=result_count, duration=duration)

    def track_document_op(self, operation: str, count: int) -> None:
        self.track(operation, count=count)

    def track_error(self, error: BaseException, **context) -> None:
        self.track(EVENTS["ERROR_OCCURRED"], error=str(error), code=getattr(error, "code", None), **context)

    def by_type(self, kind: str) -> list[dict]:
        return [e for e in self.events if e["eventType"] == kind]

    def in_range(self, start: int, end: int) -> list[dict]:
        return [e for e in self.events if start <= e["timestamp"] <= end]

    def summary(self) -> dict:
        now = _now()
        return {"sessionId": self.session, "duration": now - self.began, "totalEvents": len(self.events), "eventCounts": dict(Counter(e["eventType"] for e in self.events)), "startTime": self.began, "endTime": now}

    def export(self, form: str = "json") -> str:
        if form == "json":
            return json.dumps({"session": self.summary(), "events": self.events}, indent=2)
        if form == "csv":
            return "\n".join(["timestamp,eventType,properties", *(f"{e['timestamp']},{e['eventType']},{json.dumps(e['properties'], separators=(',', ':'))}" for e in self.events)])
        raise ConfigurationError.invalid_value("form", form, "json or csv")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(e["sessionId"], e["timestamp"], e["eventType"], json.dumps(e["properties"])) for e in self.events]
        out = spark.createDataFrame(rows, "session string, millis long, event_type string, properties string")
        return out.withColumn("ts", F.timestamp_millis("millis")).drop("millis")


def hash32(text: str) -> int:
    """The hash of ``functions.text.hash32`` for one string, over UTF-16 units."""
    raw = text.encode("utf-16-le", "surrogatepass")
    h = 0
    for i in range(0, len(raw), 2):
        h = (h * 31 + raw[i] + 256 * raw[i + 1]) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def base36(n: int) -> str:
    out, left = "", abs(n)
    while left or not out:
        left, d = divmod(left, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return "-" * (n < 0) + out


LOG = logging.getLogger("siftwell")


def child_logger(name: str, **fields) -> logging.LoggerAdapter:
    """A logger whose records carry ``fields``, as JSON after the message."""

    class Fields(logging.LoggerAdapter):
        def process(self, message, kwargs):
            own = {**self.extra, **kwargs.pop("fields", {})}
            return f"{message} {json.dumps(own, default=str)}" if own else message, kwargs

    return Fields(LOG.getChild(name), fields)


def log_performance(operation: str, millis: float, log: logging.Logger | logging.LoggerAdapter = LOG, **fields) -> None:
    log.info("%s took %.1f ms %s", operation, millis, json.dumps(fields, default=str) if fields else "")


def log_error(error: BaseException, log: logging.Logger | logging.LoggerAdapter = LOG, **fields) -> None:
    log.error("%s: %s %s", getattr(error, "code", type(error).__name__), error, json.dumps({**getattr(error, "metadata", {}), **fields}, default=str))
