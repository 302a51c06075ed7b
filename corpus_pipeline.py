"""A training corpus from the documents table: five stages, each over all that the one before kept."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.llm.common import materialise
from partweave.llm.minhash import one_per_group
from partweave.llm.packing import pack_documents
from partweave.llm.pii import mask_pii
from partweave.llm.quality import quality_filter
from partweave.llm.queries import tokenizer_file
from partweave.llm.suffix_dedup import without_repeats


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without boilerplate lines."""
    return _recounted(quality_filter(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    return one_per_group(docs, k=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that start twice or more in what is left, wherever they stand."""
    return _recounted(without_repeats(docs, width=200))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return _recounted(mask_pii(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the pieces in sequences of 2048 tokens."""
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("personal data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokens, fingerprints and a trained model are beyond SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None
