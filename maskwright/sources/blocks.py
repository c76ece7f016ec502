"""Blocks: the paragraphs that all operators work on.

blocks(doc_id long, row long, block_seq int, path string, text string); text is normalised
as below, blank ones are left out. Every line of a text is one paragraph. row is a hash of
the whole text, which tells documents apart that share a doc_id or have none.

Defined cases: null and empty texts have no blocks; an empty table gives an empty one;
rows that repeat give their blocks again; texts of any length are cut whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import read

# Characters that each become one space, so that positions stay.
AS_SPACE = "–—�\t "
BLANK = r"(?U)\S"


def normalised(text: Column) -> Column:
    return F.translate(text, AS_SPACE, " " * len(AS_SPACE))


def blocks_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One block for each line that is not blank; block_seq counts all lines from 0."""
    lines = rows.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("row"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("block_seq", "text"))
    path = F.format_string("body / paragraph=%d", F.col("block_seq"))
    return lines.select("doc_id", "row", "block_seq", path.alias("path"), normalised(F.col("text")).alias("text")).where(F.col("text").rlike(BLANK))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(read(spark, f"{sf_dir}/documents.parquet"), "doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(read(spark, f"{sf_dir}/pages.parquet"), "page_id", "html")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a document; its turns follow each other. block_seq is a long: 2**32 times the turn, and the line."""
    rows = read(spark, f"{sf_dir}/conversations.parquet")
    lines = rows.select(F.col("conv_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row"), "turn", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    seq = F.col("turn").cast("long") * (1 << 32) + F.col("line")
    path = F.format_string("turn=%d / paragraph=%d", F.col("turn"), F.col("line"))
    return lines.select("doc_id", "row", seq.alias("block_seq"), path.alias("path"), normalised(F.col("text")).alias("text")).where(F.col("text").rlike(BLANK))


def once(blocks: DataFrame, element: str) -> DataFrame:
    """Blocks whose element was met before in the document (merged cells) are left out; the first path stays."""
    first = blocks.groupBy("doc_id", element).agg(F.min("block_seq").alias("block_seq"))
    return blocks.join(first, ["doc_id", element, "block_seq"], "left_semi")


def runs_text(runs: Column) -> Column:
    """The text of a paragraph from its runs."""
    return normalised(F.array_join(F.transform(runs, lambda r: F.coalesce(r, F.lit(""))), ""))


def run_offsets(runs: Column) -> Column:
    """array<struct<idx, start, end, text>> of runs (array<string>), in the paragraph's text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<idx:int,start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        end = (acc["at"] + F.length(r)).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("idx"), acc["at"].alias("start"), end.alias("end"), r.alias("text")))).alias("out"))

    return F.aggregate(runs, start, step, lambda acc: acc["out"])
