"""Registered queries of this folder: each applies one operator to its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import oracles
from ridgeline.llm.align import alignment_digests
from ridgeline.llm.decontaminate import contaminated
from ridgeline.llm.frames import encoded
from ridgeline.llm.language import identified
from ridgeline.llm.lexical import ranked
from ridgeline.llm.neardup import near_duplicates
from ridgeline.llm.ngramjoin import similar_documents
from ridgeline.llm.packing import packed
from ridgeline.llm.passages import repeated_passages
from ridgeline.llm.pii import span_digests
from ridgeline.llm.sharding import placed
from ridgeline.llm.topk import nearest
from ridgeline.llm.warc import page_digests
from ridgeline.session import importable_in_tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op1_pii_sanitisation": oracles.PII, "op2_warc_captures": oracles.WARC, "op6_top_k": oracles.TOP_K,
                           "op11_ngram_join": oracles.NGRAM_JOIN, "op12_lexical_search": oracles.LEXICAL_SEARCH}
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    """Register fn(spark, sf_dir) under its name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable_in_tasks(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


@query
def op8_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_token_frames(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), added=True)


@query
def op10_best_fit_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), added=True)


@query
def op4_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_language_id(spark, sf_dir):
    return identified(table(spark, sf_dir, "documents"))


@query
def op2_warc_captures(spark, sf_dir):
    return page_digests(table(spark, sf_dir, "pages"))


@query
def op3_sharding(spark, sf_dir):
    return placed(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def op6_top_k(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op7_repeated_passages(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


@query
def op1_pii_sanitisation(spark, sf_dir):
    return span_digests(table(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark, sf_dir):
    return alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


@query
def op11_ngram_join(spark, sf_dir):
    return similar_documents(table(spark, sf_dir, "documents"))


@query
def op12_lexical_search(spark, sf_dir):
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
