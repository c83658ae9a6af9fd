"""A training corpus from ``documents``: five stages, each an operator of ``revlens.llm``.

Every stage gets (spark, docs, sf_dir), where ``docs`` is all that its predecessor kept,
and returns the columns of ``docs``; the last one returns packed pieces with their ids.

Defined results: null and empty texts pass the classifier as its bias says, are cut
nowhere, cost the mix nothing and are packed as their end id; an empty table gives no
rows at every stage; further columns of ``docs`` are handed on.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.llm import mixing, near_duplicates, packing, quality_model, repeats  # noqa: E402
from revlens.llm.tables import stored  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    weights = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # The row travels as one column, so that its names meet none of these.
    rows = docs.select(F.struct("*").alias("doc"), "text")
    scored = quality_model.score(rows, weights, ["doc"], "score")
    return scored.where(F.col("score") >= quality_model.THRESHOLD).select("doc.*")


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.without_near_duplicates(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the long strings that occur more than once."""
    cut = repeats.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets ask for."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 1024; ``packing.sequences`` joins them."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicate_removal),
    ("suffix_repeats", repeat_removal),
    ("mixing", mix),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table, each one's rows written before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
