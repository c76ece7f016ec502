"""Entity resolution inside a document: mentions to canonical ids, aliases, e-mail owners.

mentions(doc_id, block_seq, ord, entity_type, text). Everything is keyed by doc_id; order
dependence is expressed by the block in which something is seen first, so nothing walks
through blocks one after the other. Windows rank the distinct entities of one document
and type, never its mentions.

doc_id may be of any type; a null doc_id equals none in joins, so the redaction plan passes
structs (see functions/identity). Defined cases: no mentions give an empty store; mentions
that repeat count once; names that are empty after normalising are a name of their own;
mentions in one place are ordered by their texts; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import strip

# Titles that are not part of a name.
TITLES = ("mr", "ms", "mrs", "dr", "shri", "prof", "shree")
_TITLE = r"(?U)\b(?:" + "|".join(TITLES) + r")\b\.?"


def normal_name(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), _TITLE, ""), r"(?U)\s+", " "))


def normal_text(text: Column) -> Column:
    return F.lower(strip(text))


def normal(kind: Column, text: Column) -> Column:
    return F.when(kind == "PERSON", normal_name(text)).otherwise(normal_text(text))


@dataclass
class Store:
    """keys: doc_id, entity_type, norm, id, first_block. entities: doc_id, id, entity_type, original, first_block. owners: doc_id, email_id, person_id."""

    keys: DataFrame
    entities: DataFrame
    owners: DataFrame


def first_seen(mentions: DataFrame) -> DataFrame:
    """One row per document and key: its first block and place there, its text there, whether it is a short name."""
    norm = normal(F.col("entity_type"), F.col("text"))
    named = mentions.select("doc_id", "block_seq", "ord", "entity_type", "text", norm.alias("norm"))
    short = (F.col("entity_type") == "PERSON") & ~F.col("norm").contains(" ")
    seen = F.struct("block_seq", short.cast("int").alias("phase"), "ord", "text")
    first = named.groupBy("doc_id", "entity_type", "norm").agg(F.min(seen).alias("seen"))
    return first.withColumn("short", short).withColumn("first_block", F.col("seen.block_seq"))


def aliases(keys: DataFrame) -> DataFrame:
    """doc_id, norm, full: short names that fit exactly one full name seen no later than their own first block."""
    full = keys.where((F.col("entity_type") == "PERSON") & ~F.col("short"))
    tokens = full.select("doc_id", F.col("norm").alias("full"), F.col("first_block").alias("full_block"), F.explode(F.array_distinct(F.split("norm", " "))).alias("norm"))
    short = keys.where("short").select("doc_id", "norm", "first_block")
    met = short.join(tokens, ["doc_id", "norm"]).where("full_block <= first_block")
    return met.groupBy("doc_id", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("full").alias("full")).where("n = 1").drop("n")


def owners(keys: DataFrame, emails: DataFrame) -> DataFrame:
    """doc_id, email_id, person_id.

    keys: doc_id, entity_type, norm, id, first_block. emails: doc_id, norm, block_seq of
    every mention. An address belongs to a person if, at one of its mentions, exactly one
    person (by id) seen so far shares two name parts with it, or all if the name has fewer;
    the earliest such mention decides.
    """
    person = keys.where("entity_type = 'PERSON'").select("doc_id", F.col("id").alias("person_id"), F.col("norm").alias("name"), F.col("first_block").alias("person_block"), F.array_distinct(F.split("norm", " ")).alias("parts"))
    person = person.select("*", F.explode("parts").alias("part"))
    local = F.regexp_extract("norm", "^([^@]*)", 1)
    asked = emails.distinct().select("doc_id", "norm", "block_seq", F.explode(F.array_distinct(F.split(local, "[._-]"))).alias("part"))
    shared = asked.join(person, ["doc_id", "part"]).where("person_block <= block_seq")
    fits = shared.groupBy("doc_id", "norm", "block_seq", "person_id", "name").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("parts")).alias("size")).where("n >= least(2, size)")
    single = fits.groupBy("doc_id", "norm", "block_seq").agg(F.count_distinct("person_id").alias("n"), F.min("person_id").alias("person_id")).where("n = 1")
    first = single.groupBy("doc_id", "norm").agg(F.min(F.struct("block_seq", "person_id")).alias("first"))
    ids = keys.where("entity_type = 'EMAIL'").select("doc_id", "norm", F.col("id").alias("email_id"))
    return first.join(ids, ["doc_id", "norm"]).select("doc_id", "email_id", F.col("first.person_id").alias("person_id"))


def resolve(mentions: DataFrame) -> Store:
    seen = first_seen(mentions)
    alias = aliases(seen)
    own = seen.join(alias, ["doc_id", "norm"], "left").withColumn("full", F.when(F.col("short"), F.col("full")))
    heads = own.where("full IS NULL")
    rank = F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy("seen", "norm"))
    numbered = heads.withColumn("id", F.concat_ws("_", "entity_type", F.lpad(rank.cast("string"), 3, "0")))
    # lpad cuts what is longer, so numbers from 1000 on are written as they are
    numbered = numbered.withColumn("id", F.when(rank > 999, F.concat_ws("_", "entity_type", rank.cast("string"))).otherwise(F.col("id")))
    entities = numbered.select("doc_id", "id", "entity_type", F.col("seen.text").alias("original"), "first_block")
    direct = numbered.select("doc_id", "entity_type", "norm", "id", "first_block")
    named = direct.where("entity_type = 'PERSON'").select("doc_id", F.col("norm").alias("full"), "id")
    indirect = own.where("full IS NOT NULL").join(named, ["doc_id", "full"]).select("doc_id", "entity_type", "norm", "id", "first_block")
    keys = direct.unionByName(indirect)
    emails = mentions.where("entity_type = 'EMAIL'").select("doc_id", normal_text(F.col("text")).alias("norm"), "block_seq")
    return Store(keys, entities, owners(keys, emails))
