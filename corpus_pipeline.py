"""A training corpus from the table ``documents``, stage by stage.

Each stage is given what the one before kept, written and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxline.llm import bpe, decontaminate, near_duplicates, quality_model, repeated_spans
from fluxline.llm.common import file_bytes, table
from fluxline.session import stored

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the positive-unlabelled classifier does not reject."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.keep_good(docs, model, QUALITY_THRESHOLD)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates; rows
    without an id, and rows that share the id of one that stays, stay too."""
    judged = near_duplicates.near_duplicates(docs, shingle=SHINGLE_WORDS)
    gone = judged.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that also stand earlier; ``n_chars`` follows."""
    cut = repeated_spans.drop_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage stands."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    return bpe.round_trip_digests(docs, file_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")),
                                  public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_duplicate", near_duplicate),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

# The tokenizer's merges and the fitted classifier are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
