"""What a model server has to offer, and an offline stand-in. Real servers plug in here; the engine itself calls none."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.errors import EmbeddingError


class Generator(Protocol):
    def generate(self, model: str, prompt: str) -> str: ...


class Echo:
    """Answers with the prompt's last line."""

    def generate(self, model: str, prompt: str) -> str:
        return prompt.rsplit("\n", 1)[-1]


def fold_ndjson(lines: Iterable[str], keys: tuple[str, ...] = ("response", "content", "text")) -> str:
    """The texts of a stream of JSON lines, joined; lines that are no JSON are skipped."""
    return "".join(stream_ndjson(lines, keys))


def stream_ndjson(lines: Iterable[str], keys: tuple[str, ...] = ("response", "content", "text")) -> Iterator[str]:
    for line in lines:
        try:
            value = json.loads(line)
        except ValueError:
            continue
        part = value.get("message", value)
        yield next((str(part[k]) for k in keys if part.get(k)), "")


def generate(prompts: DataFrame, client: Generator, model: str = "default") -> DataFrame:
    """Adds ``response`` to rows with ``prompt``, in Arrow batches on the executors."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda p: client.generate(model, p))

    return prompts.withColumn("response", run("prompt"))


def measured_answers(prompts: DataFrame, client: Generator, model: str = "default") -> DataFrame:
    """``generate`` with what each answer took: ``duration`` in ms, lengths, and ``tokens_per_second`` (characters, as published)."""

    @F.pandas_udf("response string, duration double")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for p in s:
            began = time.monotonic()
            rows.append((client.generate(model, p), (time.monotonic() - began) * 1000))
        return pd.DataFrame(rows, columns=["response", "duration"], index=s.index)

    out = prompts.withColumn("_got", run("prompt")).select("*", "_got.response", "_got.duration").drop("_got")
    length = F.length("response")
    return out.withColumn("prompt_length", F.length("prompt")).withColumn("response_length", length).withColumn("tokens_per_second", length / F.nullif(F.col("duration") / 1000, F.lit(0.0)))


def embedder(fn: Callable[[list[str]], list[list[float]]], dim: int | None = None, batch: int = 20, retries: int = 1, concurrency: int = 1):
    """A column function for ``text_search`` and stores from a function on lists of texts.

    A task sends lists of ``batch`` texts, ``concurrency`` at a time, and keeps their order. Null texts give null.
    """

    def ask(part: list[str]) -> list[list[float]]:
        for left in range(retries, -1, -1):
            try:
                got = fn(part)
                break
            except Exception as e:  # noqa: BLE001
                if not left:
                    raise EmbeddingError.network_error(str(e)) from e
        if dim and (wrong := [len(v) for v in got if len(v) != dim]):
            raise EmbeddingError.dimension_mismatch(dim, wrong[0])
        return got

    def embed(text):
        @F.pandas_udf("array<double>")
        def run(s: pd.Series) -> pd.Series:
            at = [i for i, t in enumerate(s) if t is not None]
            parts = [[s.iloc[i] for i in at[a : a + batch]] for a in range(0, len(at), batch)]
            out: list[list[float] | None] = [None] * len(s)
            with ThreadPoolExecutor(concurrency) as pool:
                for i, v in zip(at, (v for part in pool.map(ask, parts) for v in part), strict=True):
                    out[i] = v
            return pd.Series(out, index=s.index, dtype=object)

        return run(text)

    return embed
