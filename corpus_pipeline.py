"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.

A stage begins by deleting what the operator of the stage before has stored for itself, as its result is written by then.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from verbascope.llm import bpe, classifier, exact_dedup, mixing, simhash
from verbascope.llm.common import cleaned, shared_folder


#: Tables that the operator of the last stage has stored for itself.
_LEFT: list[str] = []


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold go. The model learns from labelled rows of docs itself."""
    cleaned(spark, _LEFT, list)
    model = classifier.train(classifier.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return classifier.accepted_documents(docs, model)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return cleaned(spark, _LEFT, exact_dedup.keep_one, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a similarity of 0.8 or more over five-word shingles the row with the smallest id stays."""
    return cleaned(spark, _LEFT, simhash.one_of_each, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return cleaned(spark, _LEFT, mixing.mixed_documents, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256, n_text_chars."""
    return cleaned(spark, _LEFT, bpe.digest_documents, docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("simhash", near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned scores, fingerprints and merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        result = stage(spark, docs, sf_dir)
        result.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
