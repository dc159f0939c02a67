"""Pipeline of the training corpus: each stage applies one operator of tickframe.llm.

STAGES are (name, function) in order. A function takes (spark, docs, sf_dir)
and returns a DataFrame; each result is written as Parquet and read again as
the docs of the next stage. All but the last return the columns of documents.

Odd rows: a null or empty text passes the quality stage by the score of a text
without features, has no lines and no benchmark item, is a near duplicate of
the other texts without a word (the smallest doc_id stays), and has no tokens.
Rows with a null doc_id lose no line and stay as near duplicates only where
their group has no other row; of repeated rows one stays. Other columns of the
table are not read, so none can clash. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import bpe, decontamination, lines, quality, simhash
from tickframe.llm.shared import shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
KEEP_FROM = 0.7
#: Near duplicates of the corpus beside those that SimHash links: word shingles and similarity.
SHINGLE, SIMILARITY = 5, 0.8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least KEEP_FROM."""
    weights = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs.select(*COLUMNS), weights).where(F.col("score") >= KEEP_FROM).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier overlapping document has; n_chars counts what is left."""
    rows = lines.deduplicated(docs.select(*COLUMNS))
    count = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", count).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return simhash.representatives(docs.select(*COLUMNS), SHINGLE, SIMILARITY, simhash.THRESHOLD)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = decontamination.tiled(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return rows.where(F.size("found") == 0).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the text decoded from them."""
    rows = bpe.encoded(docs.select("doc_id", "source", "text"))
    return rows.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents.

    A stage's files lie in the shared folder (spark.checkpoint.dir) and are
    removed once the next stage is written; the last one's stay for the reader.
    """
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs


#: A learned classifier and patience diff have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
