"""The whole redaction of a table of blocks: detect, fuse, validate, resolve, propagate, rewrite."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import packed, unpacked
from ..functions.tables import stored
from ..operators import detect, entities, fuse, rewrite, synthesize, validate


@dataclass
class Redaction:
    """blocks: with redacted text. manifest: one row per replaced span. store: entities of each document.

    All of them name documents by doc_id and row (see functions/identity).
    """

    blocks: DataFrame
    manifest: DataFrame
    store: entities.Store
    synthetic: DataFrame


def local(blocks: DataFrame) -> DataFrame:
    """blocks with kept: each block's own validated spans. Narrow: nothing is shuffled up to here. A candidate that contradicts its text is an error."""
    guarded = detect.detect(blocks).withColumn("candidates", fuse.guarded(F.col("candidates"), F.col("text")))
    resolved = guarded.withColumn("resolved", fuse.resolve(F.col("candidates")))
    return resolved.withColumn("kept", validate.local_spans(F.col("text"), F.col("resolved"))).drop("candidates", "resolved")


def mentions(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "block_seq", F.posexplode("kept").alias("ord", "c")).select("doc_id", "block_seq", "ord", "c.entity_type", "c.text", "c.start", "c.end")


def redact(blocks: DataFrame) -> Redaction:
    """blocks: doc_id (which may be null or shared), row where it is (see functions/identity), block_seq, text.

    Rows that agree in doc_id, row and block_seq are one block; the manifest lists its spans
    once, and each of the rows is rewritten.
    """
    named = packed(blocks)
    # detection is the costly part: it runs once, and only blocks with spans are written
    kept = stored(local(named).where(F.size("kept") > 0).select("doc_id", "block_seq", "kept"))
    store = entities.resolve(mentions(kept))
    store = entities.Store(stored(store.keys), stored(store.entities), store.owners)
    synthetic = stored(synthesize.replacements(store.entities, store.owners))
    # only documents that have entities can hold them elsewhere
    some = named.join(store.entities.select("doc_id").distinct(), "doc_id", "left_semi")
    spanned = rewrite.final_spans(kept, rewrite.propagate(some, store.entities))
    manifest = stored(rewrite.with_replacements(spanned, store.keys, synthetic))
    open_store = entities.Store(unpacked(store.keys), unpacked(store.entities), unpacked(store.owners))
    return Redaction(unpacked(rewrite.redact(named, manifest)), unpacked(manifest), open_store, unpacked(synthetic))
