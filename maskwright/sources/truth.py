"""Ground truth: JSON files of annotated blocks, and where they are in a document.

A file is {document_hash, blocks: [{container_path, text, entities: [{entity_type, text,
start, end}]}]}. Defined cases: files or lists that are empty give no rows; blocks without
entities have one row in blocks_of and none in entities_of; blocks that repeat are kept; a
path that a document does not have, or that is null, is found nowhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "document_hash string, blocks array<struct<container_path:string,text:string,entities:array<struct<entity_type:string,text:string,start:int,end:int>>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from files of one document a line, which Spark can split."""
    return spark.read.schema(SCHEMA).json(path)


def blocks_of(truth: DataFrame) -> DataFrame:
    """document_hash, path, text, entities: one row for each annotated block."""
    return truth.select("document_hash", F.explode("blocks").alias("b")).select("document_hash", F.col("b.container_path").alias("path"), "b.text", "b.entities")


def located(annotated: DataFrame, blocks: DataFrame, document: str = "document_hash") -> DataFrame:
    """annotated (see blocks_of) with block_seq, block_text and found. blocks: path, block_seq, text, and the column `document` of the same name in both."""
    there = blocks.select(document, "path", "block_seq", F.col("text").alias("block_text"))
    return annotated.join(there, [document, "path"], "left").withColumn("found", F.col("block_text").isNotNull())


def entities_of(found: DataFrame, document: str = "document_hash") -> DataFrame:
    """block, entity_type, start, end of the blocks that were found: the truth of operators/evaluate."""
    spans = found.where("found").select(F.concat_ws("/", document, "path").alias("block"), F.explode("entities").alias("e"))
    return spans.select("block", "e.entity_type", "e.start", "e.end")
