"""Registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import (centroids, mixing, near_duplicates, neighbours, packing, phrases, quality_model, quality_rules,
                         records, repeats, sharding, stream_dedup, url_filter)
from revlens.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).drop("tie")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    weights = quality_model.train(docs, _table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, weights, ["doc_id"])
    return scored.select("doc_id", F.coalesce(quality_model.held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= quality_model.THRESHOLD).cast("int").alias("predicted"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut_digest(_table(spark, sf_dir, "documents"))


def _vocabulary(name: str) -> str:
    import public_tokenizers  # its folder, like any vocabulary, is a parameter of the operators

    return public_tokenizers.path(name)


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    data, index = f"{folder}/records", f"{folder}/index"
    records.write_records(_table(spark, sf_dir, "documents"), data, _vocabulary("word_bpe_49k.json"))
    return records.starts(records.build_index(spark, data, index)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), with_ids=True)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.decisions(spark, f"{sf_dir}/documents.parquet").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_quality_rules, op3_quality_model, op4_neighbours, op5_suffix_repeats,
                              op6_records, op7_near_duplicates, op8_url_filter, op9_sharding, op10_packing,
                              op11_exact_dedup, op12_phrases, op13_clusters)
}
