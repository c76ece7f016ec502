"""One query for each operator, with production parameters over whole tables.

The operators keep their own results; the queries bring them into the form of the
contracts. ORACLES holds DuckDB SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_model, line_dedup, mixing, near_duplicates, nearest, personal_data, secrets, token_counts, toxicity
from .common import crc_mod, table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: F.Column, kind: str) -> F.Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")


def _span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(_count(spans, k) for k in kinds),
        F.sha2(_joined(F.filter(spans, lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85).drop("group_id", "h")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), copy_chars=line_dedup.COPY_CHARS, counts=("n_lines", "n_kept"))
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _span_digest(personal_data.find_personal_data(docs, personal_data.fit(docs)), personal_data.KINDS)


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents")).documents.select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.tokenizer_path("piece_bpe_32k.model"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 7) == 2
    # a row without doc_id is in no fold, so it is learned from
    fitted = language_model.fit(docs, ~F.coalesce(held_out, F.lit(False)))
    return language_model.score(docs, fitted).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on_folds(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secrets.find_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_line_dedup": op2_line_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_decontamination": op4_decontamination,
    "op5_personal_data": op5_personal_data,
    "op6_source_mix": op6_source_mix,
    "op7_token_counts": op7_token_counts,
    "op8_language_model": op8_language_model,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
}

__all__ = ["ORACLES", "QUERIES"]
