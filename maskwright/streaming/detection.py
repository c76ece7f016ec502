"""Detection on streams: the operators up to validation keep no state, so they run on a stream as on a table.

Entity resolution needs all of a document; on a stream it runs per micro-batch, on
documents that arrive whole, through foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import redaction
from ..sources.blocks import blocks_of


def documents_stream(spark: SparkSession, folder: str, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of Parquet files as they arrive in a folder."""
    return blocks_of(spark.readStream.schema(schema).parquet(folder), key, text)


def validated_stream(blocks: DataFrame) -> DataFrame:
    """doc_id, block_seq, entity_type, text, start, end of spans that stay, for a stream or a table of blocks."""
    kept = redaction.local(blocks).select("doc_id", "block_seq", F.explode("kept").alias("c"))
    return kept.select("doc_id", "block_seq", "c.entity_type", "c.text", "c.start", "c.end")


def redact_batches(sink: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: redacts the documents of a batch and gives (blocks, manifest) to sink."""

    def run(batch: DataFrame, _: int) -> None:
        done = redaction.redact(batch)
        sink(done.blocks, done.manifest)

    return run
