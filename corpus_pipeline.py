"""A corpus pipeline: quality rules, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads again as
the next stage's docs. All but the last return the columns of documents. Null, empty, very long and repeated texts, null and
repeated doc_ids and more columns are handled as the operators say; of an empty table nothing is left after the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from silvaflow.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from silvaflow.llm.common import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject (operator 9)."""
    return quality_rules.drop_poor(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised text, the smallest doc_id (operator 1)."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest doc_id (operator 8)."""
    return near_dedup.drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rates ask for them (operator 10). None comes twice: the stages before have just taken copies out, and
    what is left of a scarce domain isn't repeated to reach its target."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), most=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the text they decode to (operator 4)."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("encoding", encode)]

#: Outliers, order MinHash, a trained classifier and BPE are beyond SQL; tests hold run() against the operators, and each
#: operator against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
