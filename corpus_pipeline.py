"""A training-corpus pipeline over ``documents``: five stages, each on what its predecessor kept.

1. toxicity        documents predicted toxic go
2. near_dedup      one document of each group of near-duplicates stays
3. decontaminate   documents into which a benchmark item leaked go
4. secrets         findings are masked in the texts
5. sentencepiece   the texts as ids, with a check that decoding gives them back and that the library gives the same

All stages but the last return the columns of documents; the last returns
``doc_id, n_tokens, ids_crc32, exact, ids`` (32-bit little-endian ids).  Nulls,
empty texts, repeated rows and empty tables have the results that the operators
define.  SQL cannot express stages 1, 4 and 5, so there is no ``ORACLE_SQL``; the
tests hold the pipeline against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import minhash, pieces, secrets_cnn, templates, toxicity
from helixframe.llm.storage import dropped, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_cnn.redacted(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.encoded(docs, model, with_ids=True).select("doc_id", "n_tokens", "ids_crc32", F.expr("exact AND parity").alias("exact"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
