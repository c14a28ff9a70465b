"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before kept; ``run`` writes
each stage's rows as Parquet to the shared folder and reads them again. All stages but the last return
the columns of ``documents``, and any others that the rows have, whatever their names. An empty table goes
through all stages. Rows are told apart by doc_id and text, so repeated ids and null ids are no special case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import jaccard_join, lines, packing, secrets, toxicity
from siftwell.llm.common import materialize, own_account, read_table, release
from siftwell.llm.labelled import crc_of_id
from siftwell.session import ship

#: Not expressible in SQL: the classifier and the packing.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that op10 learns from.

    A null or empty text scores as one empty segment; a very long one is scored whole. Repeated rows share their
    verdict. Without labels of both classes every row has the same score, the share of toxic labels.
    """
    ship(spark)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), crc_of_id() % 3 != 1)
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; a document of which nothing is left goes as a whole.

    Null texts come out empty and stay, as do texts that were blank before. Of repeated lines those of the least
    doc_id stay, then of the least place; a null id comes last. Rows alike in id and text share their decisions.
    ``n_chars`` follows the text where it changed.
    """
    ship(spark)
    names = {c: c for c in docs.columns if c not in ("n_lines", "n_removed")}
    spare = {c: f"{c}_" + "_" * max(map(len, docs.columns)) for c in docs.columns if c not in names}
    cut = lines.deduplicate(docs.withColumnsRenamed(spare))
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    left = cut.where(~(changed & (F.trim("text") == ""))).drop("n_lines", "n_removed")
    return left.withColumnsRenamed({v: k for k, v in spare.items()}).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect, the one with the least doc_id stays, then of the least text digest.

    Rows are judged one by one even where ids repeat or are null (these come last); of rows alike in id and text one
    stays. Texts without words are linked with nothing and stay.
    """
    ship(spark)
    return jaccard_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in place, so that documents and offsets stay. Null texts stay null; all rows stay."""
    ship(spark)
    return secrets.masked(docs, secrets.update(docs)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's pieces with their place in a sequence. A null or empty text is one separator; repeated rows are packed each."""
    import public_tokenizers

    ship(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage wrote for itself goes as soon as its result is written."""
    docs = read_table(spark, sf_dir, "documents")
    with own_account():
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            release(spark, keep=1)
    return docs
