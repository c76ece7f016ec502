"""What the operators share: reading tables, cutting lineage, small column helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import discard, free, join_split, read, release, sliced_join, stored

__all__ = ["WORD", "crc_mod", "discard", "free", "join_split", "release", "sliced_join", "stored", "table"]

#: A word, as all contracts of this subpackage define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> F.Column:
    """crc32 of the column's text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
