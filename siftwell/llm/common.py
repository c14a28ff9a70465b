"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ``materialize`` wrote, by whoever keeps account of it.
_SCRATCH: ContextVar[list[str]] = ContextVar("scratch", default=[])  # noqa: B039  the one account of those who keep none


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    A folder of our own is set only where the session names none, as in local tests.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="siftwell-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts lineage: a lost executor costs only the tasks that it ran.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete what ``materialize`` wrote but for the last ``keep``; for when no result that reads it is in use any more."""
    conf, held = spark.sparkContext._jsc.hadoopConfiguration(), _SCRATCH.get()
    while len(held) > keep:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(held.pop(0))
        path.getFileSystem(conf).delete(path, True)


@contextmanager
def own_account():
    """Within, ``release`` sees only what was written within."""
    token = _SCRATCH.set([])
    try:
        yield
    finally:
        _SCRATCH.reset(token)


#: A key is hot if it has one in so many of all rows; there are no more hot keys than that.
HOT_KEYS = 10_000


def join_per_key(left: DataFrame, right: DataFrame, key: str, size: str = "size", how: str = "left", spread: list[str] | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key and, as ``size``, the rows of ``left`` that have it.

    Hot keys are split: their rows of ``left`` are dealt over copies of their row of ``right``, as many as keep
    each share below 1 in ``HOT_KEYS`` of all rows. The hot keys and their copies, at most ``HOT_KEYS`` whatever
    the data, are broadcast; ``right`` itself need not be small. ``spread`` names the columns of ``left`` that
    tell its rows apart (all, if not given). ``right`` is read more than once and should be a written table.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    ends = max(map(len, [*left.columns, *right.columns])) * "_"
    copies, salt = f"_copies{ends}", f"_salt{ends}"
    hot = right.where(F.col(size) * HOT_KEYS >= F.lit(total)).select(key, F.ceil(F.col(size) * HOT_KEYS / F.lit(max(1, total))).cast("long").alias(copies))
    dealt = F.coalesce(F.pmod(F.xxhash64(*(spread or left.columns)), F.greatest(copies, F.lit(1))), F.lit(0).cast("long"))
    rows = left.join(F.broadcast(hot), key, "left").withColumn(salt, dealt).drop(copies)
    each = F.sequence(F.lit(0).cast("long"), F.greatest(F.coalesce(copies, F.lit(1)), F.lit(1)) - 1)
    few = right.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(each)).drop(copies, size)
    return rows.join(few, [key, salt], how).drop(salt)


def digest_of(text: Column) -> Column:
    """128 bits that stand for a text; with the id they name a row."""
    return F.unhex(F.md5(text.cast("binary")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(texts: list, limit: int = 4_000_000):
    """Index ranges of ``texts`` of about ``limit`` characters, one text at least."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t)
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
