"""Prompts from ranked documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Templates by name; {c} is the context, {q} the query.
TEMPLATES = {
    "default": "Context:\n{c}\n\nQuestion: {q}\n\nAnswer based on the context:",
    "conversational": "Here's some relevant information:\n\n{c}\n\nUser: {q}\n\nAssistant: Based on the information provided, ",
    "technical": "# Technical Documentation\n\n## Relevant Information\n{c}\n\n## Query\n{q}\n\n## Answer\nProvide a technical, accurate response:",
    "academic": "**Reference Material:**\n{c}\n\n**Research Question:** {q}\n\n**Analysis:** Provide a scholarly, well-reasoned response with citations where applicable:",
    "code": "Code Examples and Documentation:\n```\n{c}\n```\n\nQuestion: {q}\n\nProvide a code-focused answer with examples:",
    "concise": "Info: {c}\n\nQ: {q}\nA (be brief):",
    "detailed": "Background Information:\n{c}\n\nQuestion: {q}\n\nProvide a comprehensive, detailed answer covering all relevant aspects:",
    "qa": "Context Information:\n{c}\n\nQ: {q}\nA:",
    "instructional": "Reference Materials:\n{c}\n\nTask: {q}\n\nProvide step-by-step instructions:",
    "creative": "Inspiration:\n{c}\n\nPrompt: {q}\n\nWrite a creative response:",
}
TRUNCATED = "\n...(truncated)"


def fill(template: str, context: Column, query: Column) -> Column:
    """The template with both put in as they are."""
    before, after = template.split("{c}")
    middle, end = after.split("{q}")
    return F.concat(F.lit(before), context, F.lit(middle), query, F.lit(end))


def context(hits: DataFrame, by: str = "query_id", *, scores: bool = False, meta: str | None = None, max_length: int | None = None) -> DataFrame:
    """``by, context``: the documents of each query in rank order, headed by number and, if asked for, score and meta (a map)."""
    head = F.concat(F.lit("Doc "), F.col("rank").cast("string"))
    if scores:
        head = F.concat(head, F.coalesce(F.concat(F.lit(" (score: "), F.format_string("%.3f", F.col("score")), F.lit(")")), F.lit("")))
    if meta:
        pairs = F.array_join(F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
        head = F.concat(head, F.coalesce(F.concat(F.lit(" ["), pairs, F.lit("]")), F.lit("")))
    rows = hits.withColumn("_one", F.concat(head, F.lit(":\n"), "text"))
    out = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_one"))), lambda s: s["_one"]), "\n\n").alias("context"))
    if max_length:
        out = out.withColumn("context", F.when(F.length("context") > max_length, F.concat(F.substring("context", 1, max_length), F.lit(TRUNCATED))).otherwise(F.col("context")))
    return out


class PromptManager:
    def __init__(self, template: str = "default", templates: dict[str, str] | None = None, system: str | None = None, variables: dict[str, str] | None = None):
        self.templates, self.system, self.variables = TEMPLATES | (templates or {}), system, dict(variables or {})
        self.template = template

    def set_variables(self, variables: dict[str, str]) -> None:
        self.variables |= variables

    def clone(self) -> PromptManager:
        return PromptManager(self.template, self.templates, self.system, self.variables)

    def generate(self, contexts: DataFrame, template: str | None = None) -> DataFrame:
        """Adds ``prompt`` to rows with ``query`` and ``context``; an unknown template falls back to the default one."""
        text = self.templates.get(template or self.template, TEMPLATES["default"])
        prompt = fill(text, F.col("context"), F.col("query"))
        for name, value in self.variables.items():
            prompt = F.replace(prompt, F.lit("{" + name + "}"), F.lit(value))
        return contexts.withColumn("prompt", F.concat(F.lit(f"{self.system}\n\n"), prompt) if self.system else prompt)


def legacy_prompt(hits: DataFrame, by: str = "query_id", prepend: str = "\nContext:\n") -> DataFrame:
    """``by, prompt`` in the form ``Doc 1 (score=0.000)`` ... ``User: ... Assistant:``."""
    one = F.concat(F.lit("Doc "), F.col("rank").cast("string"), F.lit(" (score="), F.format_string("%.3f", F.coalesce("score", F.lit(0.0))), F.lit("):\n"), "text")
    joined = hits.groupBy(by).agg(F.first("query").alias("query"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))), lambda s: s["t"]), "\n\n").alias("c"))
    return joined.select(by, F.concat(F.lit(prepend), "c", F.lit("\n\nUser: "), "query", F.lit("\nAssistant:")).alias("prompt"))
