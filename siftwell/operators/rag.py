"""Answers from retrieved documents: prompts as columns, answers by a client on the executors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import clients
from siftwell.functions import vectors as vx
from siftwell.operators import prompts
from siftwell.operators.search import Retriever
from siftwell.operators.store import DocumentStore

#: Fixed value: the form of a prompt whose template is given as a text.
PLAIN = "Context:\n{c}\n\nQuestion: {q}\n\nAnswer:"


def default_prompt(contexts: DataFrame, template: Callable[[Column, Column], Column] | str | None = None, system: str | None = None) -> DataFrame:
    """Adds ``prompt`` to rows with ``query`` and ``context``: by a function of both, else in one of two fixed forms."""
    query, context = F.col("query"), F.col("context")
    if callable(template):
        prompt = template(query, context)
    else:
        prompt = prompts.fill(PLAIN if template else prompts.TEMPLATES["default"], context, query)
    return contexts.withColumn("prompt", F.concat(F.lit(f"{system}\n\n"), prompt) if system else prompt)


def generate_with_rag(hits: DataFrame, client: clients.Generator, model: str, *, manager: prompts.PromptManager | None = None, template: Callable[[Column, Column], Column] | str | None = None, system: str | None = None, scores: bool = False, meta: str | None = None, max_length: int | None = None) -> DataFrame:
    """``query_id, query, prompt, response, duration, prompt_length, response_length, tokens_per_second`` for each query of ``hits``.

    ``hits`` are ranked documents with their query; a query without hits is not in them and gets no answer. The
    last four are what ``observe.metrics_report`` takes as generations.
    """
    asked = hits.groupBy("query_id").agg(F.first("query").alias("query"))
    contexts = prompts.context(hits, scores=scores, meta=meta, max_length=max_length).join(asked, "query_id")
    filled = manager.generate(contexts) if manager else default_prompt(contexts, template, system)
    return clients.measured_answers(filled.select("query_id", "query", "prompt"), client, model)


def generate_legacy(retriever: Retriever, queries: DataFrame, client: clients.Generator, model: str, k: int = 3, prepend: str = "\nContext:\n") -> DataFrame:
    """The older form: retrieve, one fixed prompt, answer; ``query_id, prompt, response``."""
    return clients.generate(prompts.legacy_prompt(retriever.get_relevant(queries, k), prepend=prepend), client, model)


@dataclass
class Rag:
    retriever: Retriever
    store: DocumentStore
    embed: Callable[[Column], Column]


def init_rag(spark: SparkSession, docs: DataFrame, *, dim: int = 128, k: int = 2, base: Callable[[Column, int], Column] = vx.char_embed, base_dim: int = 768) -> Rag:
    """A store of ``docs`` (``id, text, batch_seq``) and a retriever over it; embeddings of ``base_dim`` are reduced to ``dim``."""
    embed = lambda text: vx.mrl_reduce(base(text, base_dim), dim, base_dim)
    store = DocumentStore(spark, embed)
    store.add(docs)
    return Rag(Retriever(store.docs, k, embed=embed), store, embed)
