"""Secret scans over an incremental blob ledger.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The ledger holds, for each blob
and version of the rules, what a scan found. A scan reads only the blobs that have no entry for the
present rules, once each; findings are then joined back to all rows (paths) that hold the blob. A ledger
in a folder lives on from run to run, with every version that a path ever had.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import join_per_key, materialize, read_table, text_or_empty

LEDGER = "blob string, rules string, kinds array<string>, starts array<long>, ends array<long>"
HISTORY = "path string, version string, blob string"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs of hexadecimal digits are cut by nothing but other characters
_HINTS = ("passw", "secret", "token", "api")

#: Kinds in the order of results. The first three are the base; the others are our additions, with hints of which
#: every match of the pattern holds one.
KINDS = ("assign", "access", "hex", "private_key", "web_token", "prefixed")
_MORE = {
    "private_key": (re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("PRIVATE KEY-----",)),
    "web_token": (re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), ("eyJ",)),
    "prefixed": (re.compile(r"(?:gh[opsur]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"), ("_", "xox")),
}
#: Changes with the rules above, the hints too: a text that a hint passed over counts as scanned.
RULES = hashlib.sha256("\n".join([_ASSIGN.pattern, _ACCESS.pattern, _HEX.pattern, *_HINTS, *(x for p, hints in _MORE.values() for x in (p.pattern, *hints))]).encode()).hexdigest()[:16]


def find(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points) of every finding, by start and then kind."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    for k, name in enumerate(KINDS[3:], 3):
        pattern, hints = _MORE[name]
        if any(h in text for h in hints):
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    found.sort()
    return [(KINDS[k], a, b) for a, k, b in found]


def blobs(rows: DataFrame) -> DataFrame:
    """Adds ``blob``. A null text is the empty blob."""
    return rows.withColumn("blob", F.sha2(text_or_empty().cast("binary"), 256))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan_new(rows: DataFrame, ledger: DataFrame, rules: str = RULES) -> DataFrame:
    """Ledger entries for the blobs of ``rows`` that ``ledger`` lacks under ``rules``.

    One row stands for each unseen blob: a thin pass picks it, so that copies are not read twice, and a
    hot group of copies shrinks to one row before its text moves. Null and empty texts are one blob.
    """
    addressed = blobs(rows.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))).withColumn("rep", F.coalesce("doc_id", F.lit("")))
    reps = addressed.groupBy("blob").agg(F.min("rep").alias("rep"))
    reps = reps.join(ledger.where(F.col("rules") == rules).select("blob"), "blob", "left_anti")
    # Rows alike in id and text are one before the scan; they are together already.
    unseen = addressed.join(reps, ["blob", "rep"], "left_semi").dropDuplicates(["blob", "rep"]).select("blob", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            col = lambda k, kind: pa.array([[x[k] for x in f] for f in found], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rules] * b.num_rows), col(0, pa.string()), col(1, pa.int64()), col(2, pa.int64())], ["blob", "rules", "kinds", "starts", "ends"])

    return unseen.mapInArrow(run, LEDGER)


def update(rows: DataFrame, ledger: DataFrame | None = None, rules: str = RULES) -> DataFrame:
    """The ledger after a scan of ``rows``, written to the shared folder."""
    new = materialize(scan_new(rows, ledger if ledger is not None else empty_ledger(rows.sparkSession), rules), "blob-ledger")
    return new if ledger is None else ledger.unionByName(new)


class Ledger:
    """A ledger in a folder that the driver and all executors share; each commit adds to it and changes nothing.

    ``entries`` are findings by blob and version of the rules, ``history`` the blob of each version of each path.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        return self._table("entries", LEDGER)

    def history(self) -> DataFrame:
        return self._table("history", HISTORY)

    def commit(self, rows: DataFrame, version: str, path: str = "doc_id", rules: str = RULES) -> int:
        """Take ``rows`` (``path``, ``text``) as ``version`` of their paths; returns how many blobs had to be scanned.

        Scans only blobs that no version before had, or all that these rules have not seen. Entries are written
        first: a commit that broke off is simply made again. A path that is there twice has two blobs; null is a
        path like any other.
        """
        before = self.entries().where(F.col("rules") == rules).count()
        scan_new(rows.select(F.col(path).alias("doc_id"), "text"), self.entries(), rules).write.mode("append").parquet(f"{self.folder}/entries")
        now = blobs(rows.select(F.col(path).cast("string").alias("path"), "text")).select("path", F.lit(version).alias("version"), "blob").distinct()
        old = self.history().where(F.col("version") == version)
        same = now["path"].eqNullSafe(old["path"]) & (now["blob"] == old["blob"])
        now.join(old, same, "left_anti").write.mode("append").parquet(f"{self.folder}/history")
        return self.entries().where(F.col("rules") == rules).count() - before

    def found(self, rules: str = RULES) -> DataFrame:
        """``path, version, blob, kinds, starts, ends`` of every version of every path that holds a finding."""
        return self.history().join(self.entries().where((F.col("rules") == rules) & (F.size("kinds") > 0)).drop("rules"), "blob")


def _of_rows(addressed: DataFrame, ledger: DataFrame, rules: str, spread: list[str]) -> DataFrame:
    """``addressed`` (with ``blob``) with ``kinds, starts, ends``.

    Blobs without findings take part as well, so that the rows of a hot one are split too.
    """
    held = materialize(addressed.groupBy("blob").agg(F.count("*").alias("size")), "blob-sizes")
    known = ledger.where(F.col("rules") == rules).drop("rules").join(held, "blob")
    known = materialize(known, "blob-findings")
    return join_per_key(addressed, known, "blob", spread=spread)


def findings(rows: DataFrame, ledger: DataFrame, rules: str = RULES) -> DataFrame:
    """``rows`` (all paths, copies too) with the ``kinds``, ``starts`` and ``ends`` that the ledger has for their blob.

    Columns of ``rows`` that are named so are replaced. A hot blob's rows are split over tasks.
    """
    own = rows.drop("kinds", "starts", "ends")
    addressed = own if "blob" in own.columns else blobs(own)
    return _of_rows(addressed, ledger, rules, [c for c in addressed.columns if c != "text"]).drop("blob")


def spans_column(only: int | None = None):
    names = list(KINDS[:only])
    keep = F.filter(F.arrays_zip("kinds", "starts", "ends"), lambda s: s["kinds"].isin(names))
    return F.coalesce(F.array_join(F.transform(keep, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ","), F.lit(""))


def report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: counts by base kind, the digest of the base spans and all spans.

    Null and empty texts have none. Repeated rows come out as often as they are there; very long texts are read
    whole; other columns are ignored. No rows in, no rows out.
    """
    ledger = update(docs, ledger)
    thin = materialize(blobs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "blob-rows")
    rows = findings(thin, ledger)
    count = lambda k: F.coalesce(F.size(F.filter("kinds", lambda x: x == k)), F.lit(0)).cast("long").alias(f"n_{k}")
    return rows.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(spans_column(3).cast("binary"), 256).alias("base_sha256"), spans_column().alias("spans"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def masked(docs: DataFrame, ledger: DataFrame, by: str = "*") -> DataFrame:
    """``docs`` with every code point of a finding replaced by ``by``.

    A null text stays null; clean texts and all other columns, whatever their names, are untouched. Repeated rows
    come out as often as they are there. ``docs`` is read twice.
    """
    fields = docs.schema
    at = fields.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, ends = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            columns = list(b.columns[:-2])
            if any(starts):
                texts = columns[at].to_pylist()
                for i, (ss, es) in enumerate(zip(starts, ends, strict=True)):
                    for s, e in zip(ss or (), es or (), strict=True):
                        texts[i] = texts[i][:s] + by * (e - s) + texts[i][e:]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-2])

    ends = "_" * max(map(len, docs.columns))
    names = [f"{k}{ends}" for k in ("_blob", "_starts", "_ends")]
    keyed = docs.withColumn(names[0], F.sha2(text_or_empty().cast("binary"), 256))
    held = materialize(keyed.groupBy(names[0]).agg(F.count("*").alias("size")), "blob-sizes")
    entries = ledger.where(F.col("rules") == RULES).select(F.col("blob").alias(names[0]), F.col("starts").alias(names[1]), F.col("ends").alias(names[2]))
    known = materialize(entries.join(held, names[0]), "blob-findings")
    joined = join_per_key(keyed, known, names[0], spread=[c for c in docs.columns if c == "doc_id"] or [names[0]])
    return joined.select(*docs.columns, *names[1:]).mapInArrow(run, fields)
