"""Conversations as summaries and transcripts, and what a document browser shows: kinds, filters, single documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "conv_id long, turn int, role string, text string"


def conversation_summary(messages: DataFrame) -> DataFrame:
    """``conv_id, messages, last_turn, mean_length`` of rows ``conv_id, turn, role, text``."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), F.avg(F.length("text")).alias("mean_length"))


def transcripts(messages: DataFrame) -> DataFrame:
    """``conv_id, transcript``: a line for each message, in order of turns."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda s: s["line"]), "\n").alias("transcript"))


def export_conversations(messages: DataFrame) -> DataFrame:
    """``value``: a JSON object for each conversation with its messages, to be written by ``df.write.text``."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return messages.groupBy("conv_id").agg(rows.alias("messages")).select(F.to_json(F.struct("conv_id", "messages")).alias("value"))


def import_conversations(lines: DataFrame) -> DataFrame:
    """The messages back from ``export_conversations``' lines; lines that are no such JSON are left out."""
    got = lines.select(F.from_json("value", "conv_id long, messages array<struct<turn: int, role: string, text: string>>").alias("c")).where("c.messages IS NOT NULL")
    return got.select("c.conv_id", F.explode("c.messages").alias("m")).select("conv_id", "m.turn", "m.role", "m.text")


def append_message(spark: SparkSession, messages: DataFrame, conv_id: int, role: str, text: str) -> DataFrame:
    """``messages`` and one more at the end of its conversation."""
    last = messages.where(F.col("conv_id") == conv_id).agg(F.max("turn")).first()[0]
    return messages.select(*(f.split()[0] for f in MESSAGE.split(", "))).unionByName(spark.createDataFrame([(conv_id, 0 if last is None else last + 1, role, text)], MESSAGE))


def categories(docs: DataFrame, column: str = "lang") -> DataFrame:
    """``category``: the values of a column that are not empty, once each."""
    return docs.where(F.col(column) != "").select(F.col(column).alias("category")).distinct()


def type_distribution(docs: DataFrame, kind: str = "type") -> DataFrame:
    """``kind, n``; a missing or empty kind is ``unknown``."""
    return docs.groupBy(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"))


def browse(docs: DataFrame, term: str | None = None, **equal: object) -> DataFrame:
    """Documents that hold ``term`` in any case and agree with the given columns."""
    wanted: Column = F.lit(True)
    if term:
        wanted &= F.lower("text").contains(term.lower())
    for column, value in equal.items():
        wanted &= F.col(column) == value
    return docs.where(wanted)


def get(docs: DataFrame, key: object, column: str = "id") -> DataFrame:
    """The document with a key, or none."""
    return docs.where(F.col(column) == key).limit(1)
