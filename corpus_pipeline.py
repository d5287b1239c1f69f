"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of documents.  Rows without an id pass the stages that
decide by id.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ridgeline.llm.decontaminate import contaminated
from ridgeline.llm.language import with_language
from ridgeline.llm.neardup import near_duplicates
from ridgeline.llm.packing import packed
from ridgeline.llm.pii import sanitised
from ridgeline.session import importable_in_tasks, staged

VOCABULARY = "byte_bpe_50k.json"
BATCH, DEFAULT_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), "10000"
LEAST_LANGUAGE_SCORE = 0.3  # learned languages have 0.37 or more in the tables at hand, others in Latin letters 0.25 or less, other scripts 0


def _small_batches(spark: SparkSession) -> None:
    """Rows hold whole texts: fewer of them at a time go to Python, unless the session has set a number."""
    if spark.conf.get(BATCH[0], None) in (None, DEFAULT_ROWS):
        spark.conf.set(*BATCH)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled rows teach; texts of other scripts or without letters go."""
    _small_batches(spark)
    return with_language(docs, LEAST_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, once."""
    _small_batches(spark)
    kept = near_duplicates(docs).where("doc_id = class_id").select("doc_id").distinct()
    first = F.row_number().over(W.partitionBy("doc_id").orderBy("text"))
    chosen = docs.join(kept, "doc_id", "left_semi").select(F.struct("*").alias("row"), first.alias("first")).where("first = 1")
    return chosen.select("row.*").unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy, edited or not, of a benchmark item."""
    _small_batches(spark)
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data and terms that disclose it are masked in the text, n_chars follows."""
    _small_batches(spark)
    return sanitised(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048 tokens."""
    _small_batches(spark)
    return packed(docs, public_tokenizers.path(VOCABULARY), added=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii),
          ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on the documents of sf_dir; what a stage keeps is written to the shared folder and read by the next."""
    importable_in_tasks(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs)
    return docs
