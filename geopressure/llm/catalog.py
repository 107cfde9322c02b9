"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopressure.llm import (
    byte_bpe,
    decontaminate,
    embedding_dedup,
    filter_audit,
    html_text,
    near_dedup,
    oracles,
    personal_data,
    quality,
    ranked_search,
    secret_scan,
    token_count,
    top_k,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """Piece counts of all documents."""
    pieces = token_count.load_pieces(public_tokenizers.path(vocabulary))
    return token_count.token_counts(_table(spark, sf_dir, "documents"), pieces)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    found = html_text.main_texts(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    docs = _table(spark, sf_dir, "documents")
    found = personal_data.find(docs, personal_data.fit(docs))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k))
    line = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    return found.select(
        "doc_id",
        *[of_kind(k).cast("long").alias(f"n_{k}") for k in personal_data.KINDS],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors of every fiftieth."""
    vectors = _table(spark, sf_dir, "embeddings")
    found = top_k.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of all documents."""
    data = byte_bpe.load_ranks(public_tokenizers.path(ranks))
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), data, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secret_scan.per_document(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    index = ranked_search.build_index(_table(spark, sf_dir, "documents"))
    found = ranked_search.search(index, _table(spark, sf_dir, "benchmark"), 10)
    return found.withColumn("rank", F.col("rank").cast("int"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove in every order of them, by source."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_html_text": op3_html_text,
        "op4_toxicity": op4_toxicity,
        "op5_personal_data": op5_personal_data,
        "op6_decontaminate": op6_decontaminate,
        "op7_top_k": op7_top_k,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_secrets": op9_secrets,
        "op10_quality": op10_quality,
        "op11_embedding_dedup": op11_embedding_dedup,
        "op12_ranked_search": op12_ranked_search,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB statement, for those that SQL can express."""
    return {
        "op1_near_dedup": oracles.NEAR_DEDUP,
        "op6_decontaminate": oracles.decontaminate_sql(),
        "op7_top_k": oracles.TOP_K,
        "op9_secrets": oracles.secrets_sql(),
        "op11_embedding_dedup": oracles.EMBEDDING_DEDUP,
        "op12_ranked_search": oracles.RANKED_SEARCH,
        "op13_filter_audit": oracles.FILTER_AUDIT,
    }
