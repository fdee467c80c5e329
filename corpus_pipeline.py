"""From raw documents to packed training sequences: quality filter, language filter, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and works on all of it. All but the last return the
columns of the documents table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from learnlens.llm import langid, packing, quality, simhash
from learnlens.llm.common import drop_folder, shared_folder


#: One minus the distance to the nearest language, at least. Documents of a learned language score 0.42 to 0.97, whatever their length; letter
#: noise and texts in other languages score below 0.2.
LEAST_LANGUAGE_SCORE = 0.25


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score 0.5 or more."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language: those without any letter go, and those far from every language that the documents hold."""
    return langid.identified_documents(docs, least=LEAST_LANGUAGE_SCORE).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: fingerprints of three-word shingles, linked at 3 or fewer differing bits."""
    return simhash.representatives(docs, words=3, distance=3).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL: model scores, profile distances, XXH64 and token ids are beyond it. The tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; each stage's rows are written to the shared folder and read again by the next.

    What a stage wrote is deleted once the next has written its own; the last result stays for the caller.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    return docs
