"""A keyed collection of documents: upsert, update, delete, pages, statistics, in memory or as Parquet."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwell.errors import ConfigurationError, RetrievalError, VectorStoreError
from siftwell.functions import vectors as vx
from siftwell.operators.search import apply_filter, text_search


def upsert(docs: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` (with ``batch_seq``, the last of a key wins) replace those of ``docs`` (with ``seq``) and keep their place.

    A missing key gets a new one, made of the call and the row, so that a task that runs again gives the same. New
    rows follow the old ones in their own order.
    """
    if dict(new.dtypes)[key] == "string":
        own = F.md5(F.concat(F.lit(uuid.uuid4().hex), F.to_json(F.struct("text", "batch_seq"))).cast("binary"))
        new = new.withColumn(key, F.coalesce(F.col(key), F.concat(F.lit("doc_"), own)))
    w = W.partitionBy(key)
    last = new.withColumn("_first", F.min("batch_seq").over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc("batch_seq")))).where("_n = 1").drop("_n")
    places = docs.select(key, F.col("seq").alias("_place"))
    top = docs.agg(F.coalesce(F.max("seq"), F.lit(-1))).scalar()
    placed = last.join(places, key, "left").withColumn("seq", F.coalesce("_place", top + 1 + F.col("_first")))
    kept = docs.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(placed.select(*[c for c in docs.columns if c in placed.columns]), allowMissingColumns=True)


def update(docs: DataFrame, changes: DataFrame, key: str = "id", merge: bool = True) -> DataFrame:
    """New ``text`` and ``meta`` (a map) for the keys in ``changes``; ``merge`` adds to the old meta, else replaces it. Unknown keys do nothing."""
    c = changes.select(F.col(key), F.col("text").alias("_text"), F.col("meta").alias("_meta"))
    old = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    # Later values win, without leaning on the session's policy for repeated keys.
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key("_meta", k), F.lit(False))), F.coalesce("_meta", F.create_map().cast("map<string,string>")))
    out = docs.join(c, key, "left")  # ``changes`` has a key once
    meta = F.when(F.col("_meta").isNull(), F.col("meta")).otherwise(merged if merge else F.col("_meta"))
    return out.withColumn("text", F.coalesce("_text", "text")).withColumn("meta", meta).select(*docs.columns)


def delete(docs: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return docs.join(keys.select(key), key, "left_anti")


def page(docs: DataFrame, limit: int | None = 100, offset: int = 0, order: str = "seq") -> DataFrame:
    out = docs.orderBy(order).offset(offset)
    return out.limit(limit) if limit else out


def stats(docs: DataFrame, order: str = "seq") -> DataFrame:
    return docs.agg(F.count("*").alias("count"), F.min_by(F.size("embedding"), order).alias("dimension"))


class DocumentStore:
    """Documents ``id, text, meta, embedding, seq`` as a frame; each change gives a new one. ``kind``: memory or parquet.

    A store in a folder keeps each state as a numbered version of its own. A version counts once it is written
    whole (Spark's ``_SUCCESS`` mark), so a change that breaks off leaves the version before. Opening writes nothing.
    ``on_progress`` is called with the documents embedded so far and all of them, after each batch of ``batch``.
    """

    SCHEMA = "id string, text string, meta map<string,string>, embedding array<double>, seq long"
    #: Versions that are kept: the present one and the one before, for readers that still use it.
    KEEP = 2

    def __init__(self, spark: SparkSession, embed: Callable[[Column], Column] = vx.char_embed, path: str | None = None, batch: int | None = None, on_progress: Callable[[int, int], None] | None = None):
        self.spark, self.embed, self.path, self.batch, self.on_progress = spark, embed, path.rstrip("/") if path else None, batch, on_progress
        self.closed = False
        self.docs = spark.createDataFrame([], self.SCHEMA)
        if path and (known := self._versions()):
            self.docs = spark.read.parquet(f"{self.path}/v{known[-1]}")

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """Whole versions, the latest last. A folder that is there but holds none of ours is not a store; other errors go up."""
        path, files = self._files()
        if not files.exists(path):
            return []
        names = [(x.getPath().getName(), x.getPath()) for x in files.listStatus(path)]
        if names and not any(re.fullmatch(r"v\d+", n) for n, _ in names):
            raise VectorStoreError.connection_error(self.path, "it holds something other than a store")
        whole = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(n[1:]) for n, p in names if re.fullmatch(r"v\d+", n) and whole(p))

    def _save(self, docs: DataFrame) -> None:
        if self.closed:
            raise VectorStoreError.connection_error(self.path or "memory", "it is closed")
        if not self.path:
            self.docs = docs
            return
        known = self._versions()
        new = f"{self.path}/v{known[-1] + 1 if known else 0}"
        docs.withColumn("dim", F.size("embedding")).write.mode("overwrite").parquet(new)
        self.docs = self.spark.read.parquet(new)
        path, files = self._files()
        for old in known[: len(known) + 1 - self.KEEP]:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"v{old}"), True)

    def close(self) -> None:
        """No more changes; frames that were taken stay readable."""
        self.closed = True

    def _embedded(self, rows: DataFrame) -> DataFrame:
        """Rows with an embedding keep it; only the others are embedded."""
        if "embedding" not in rows.columns:
            return rows.withColumn("embedding", self.embed(F.col("text")))
        have = rows.where(F.col("embedding").isNotNull())
        return have.unionByName(rows.where(F.col("embedding").isNull()).withColumn("embedding", self.embed(F.col("text"))))

    def add(self, rows: DataFrame) -> None:
        if rows.where(F.col("text").isNull() | (F.col("text") == "")).limit(1).count():
            raise VectorStoreError.invalid_document("text must not be empty")
        if not self.batch:
            self._save(upsert(self.docs, self._embedded(rows)))
            return
        # By ranges of batch_seq: each part is embedded and saved before the next one begins.
        low, high = rows.agg(F.min("batch_seq"), F.max("batch_seq")).first()
        total, done = rows.count(), 0
        for at in range(low, high + 1, self.batch) if total else ():
            part = rows.where(F.col("batch_seq").between(at, at + self.batch - 1))
            if n := part.count():
                done += n
                self._save(upsert(self.docs, self._embedded(part)))
                if self.on_progress:
                    self.on_progress(done, total)

    def update(self, changes: DataFrame, merge: bool = True) -> None:
        """New text is embedded anew unless ``changes`` bring an embedding; all other documents stay as they are."""
        mine = self.docs.select("id").join(changes, "id")
        given = mine.where(F.col("text").isNotNull())
        fresh = self._embedded(given).select("id", F.col("embedding").alias("_fresh"))
        out = update(self.docs, changes, merge=merge).join(fresh, "id", "left")
        self._save(out.withColumn("embedding", F.coalesce("_fresh", "embedding")).select(*self.docs.columns))

    def delete(self, ids: list[str]) -> None:
        self._save(self.docs.where(~F.col("id").isin(ids)))

    def get(self, key: str):
        return self.docs.where(F.col("id") == key).limit(1).first()

    def page(self, limit: int | None = 100, offset: int = 0) -> DataFrame:
        return page(self.docs, limit, offset)

    def clear(self) -> None:
        self._save(self.docs.limit(0))

    def stats(self) -> DataFrame:
        return stats(self.docs)

    def vacuum(self, files: int = 1) -> None:
        self._save(self.docs.coalesce(files))

    def search(self, queries: DataFrame, k: int = 3, filter=None, **options) -> DataFrame:  # noqa: A002
        if queries.where(F.col("query").isNull() | (F.col("query") == "")).limit(1).count():
            raise VectorStoreError.invalid_query("it must not be empty")
        docs = apply_filter(self.docs, filter)
        if self.path and docs.isEmpty():
            raise RetrievalError.filter_no_results() if filter is not None else RetrievalError.empty_vector_store()
        return text_search(docs, queries, k, self.embed, **options)


def create_store(spark: SparkSession, kind: str = "memory", **options) -> DocumentStore:
    if kind.lower() not in ("memory", "inmemory", "parquet"):
        raise ConfigurationError.invalid_value("kind", kind, "memory or parquet")
    return DocumentStore(spark, **options)
