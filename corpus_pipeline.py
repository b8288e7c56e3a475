"""A pipeline from raw documents to token ids.

Known languages only, one document of each group of near duplicates, no benchmark passages, no personal data, then sampled segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import decontaminate, language, near_dedup, pii, sentencepiece_sampling
from tidegauge.llm._frames import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without a letter go."""
    return language.keep_known(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near duplicates.

    Texts that are null or have no word are like nothing and stay, as do rows of a null id; rows of one id go or stay together.
    """
    return near_dedup.keep_one(docs)


def clear_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is of benchmark passages; null and empty texts stay, as all do if the benchmark is empty."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind; n_chars is of the new text, null if that is null. Repeated rows stay."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document and draw: id, language, source, and the sampled segmentation of the whole text as token ids.

    A null or empty text has one draw, of no tokens; repeated rows have the same draws each.
    """
    got = sentencepiece_sampling.sample_segmentations(docs.select("doc_id", "text", "lang", "source"), drop=("text",))
    return got.select("doc_id", "lang", "source", F.explode("draws").alias("d")).select("doc_id", "lang", "source", "d.*")


STAGES = [
    ("language identification", identify),
    ("near-duplicate removal", deduplicate),
    ("benchmark decontamination", clear_benchmark),
    ("personal data redaction", redact),
    ("sentencepiece encoding", encode),
]

#: SQL can express neither the learned models nor the sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents; each one's rows are kept in the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if n == 0 else written(docs), sf_dir)
    return docs


QUERIES = {"pipeline": run}
