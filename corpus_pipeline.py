"""A training-corpus pipeline over the operators of :mod:`geopressure.llm`.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and
reread as the next stage's ``docs``. All stages but the last return the columns of ``documents``, and
any others, whatever their names.

Every stage reads whole texts of any length. A null text counts as empty, is never a copy or an
overlap, and stays null. Rows that repeat with id and text are scored alike and become one in the
near-duplicate stage; so do ties, where the least doc_id stays. An empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopressure.llm import byte_bpe, decontaminate, near_dedup, personal_data, quality
from geopressure.llm.store import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts."""
    return quality.keep_good(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component on five-word shingles, that of the smallest id."""
    return near_dedup.keep_one(docs, near_dedup.near_duplicates(docs, width=5))


def drop_benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return personal_data.redact(docs, personal_data.fit(docs))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality", keep_good_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_overlaps),
    ("personal_data", mask_personal_data),
    ("byte_bpe", encode_tokens),
]

#: Trained classifiers and the field over personal data are beyond SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each result written to the shared folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
