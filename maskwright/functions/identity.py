"""What tells the rows of documents apart.

A document is named by its doc_id and, in column `row`, by a hash of the text it came from.
So rows that share a doc_id but differ in text are documents of their own, and so are rows
without a doc_id; rows that agree in both are one document. While it is worked on, the
two stand as one struct in column doc_id: unlike a bare null, a struct that holds one
equals its like in joins. Tables without `row` name documents by doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame) -> DataFrame:
    """doc_id and row as one struct, in column doc_id."""
    row = F.col("row") if "row" in df.columns else F.lit(0)
    return df.withColumn("doc_id", F.struct(F.col("doc_id").alias("doc_id"), row.cast("long").alias("row"))).drop("row")


def unpacked(df: DataFrame) -> DataFrame:
    """The reverse: columns doc_id and row, in place of the struct."""
    return df.select(*(c for name in df.columns for c in ([F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.row").alias("row")] if name == "doc_id" else [F.col(name)])))
