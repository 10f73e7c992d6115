"""From raw documents to token ids: quality, exact and near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtriage.llm import bpe, exactdedup, linecrf, mixing, simhash
from flowtriage.llm.common import documents, store, tokenizer_path
from flowtriage.session import released

#: Bits in which the fingerprints of near copies may differ.
NEAR_BITS = 4


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, learned from the labels, does not reject."""
    field = linecrf.learned_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return linecrf.keep_good(docs, field)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one with the smallest id."""
    return exactdedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links (at most NEAR_BITS of 64 bits apart), directly or over others, the one with the smallest id."""
    return simhash.drop_near_copies(docs, most=NEAR_BITS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources takes them."""
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a digest of what they decode to."""
    path = tokenizer_path()
    ids = bpe.encode(docs.select("doc_id", "text", "lang", "source"), path).select("doc_id", "lang", "source", "ids")
    return bpe.decode(ids, path).select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_good), ("exact_dedup", drop_exact_copies), ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources), ("bpe", to_tokens),
]

#: The first stage is a learned model, which SQL cannot express.
ORACLE_SQL = None


@released
def stored_stage(docs: DataFrame, spark: SparkSession, sf_dir: str, name: str, stage) -> DataFrame:
    """The rows of a stage as a table of its own; all that the stage has stored besides is gone."""
    return store(stage(spark, docs, sf_dir), name)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage is written as Parquet and read again by the next.

    Within a scratch block the tables of the stages go with it.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored_stage(docs, spark, sf_dir, name, stage)
    return STAGES[-1][1](spark, docs, sf_dir)
