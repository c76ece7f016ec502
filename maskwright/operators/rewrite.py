"""Propagation of known values, replacement in the text, and mapping to runs.

doc_id is any column that names documents; null never equals null in it, so the redaction
plan passes structs (see functions/identity). Blocks of one document that repeat are one
block: spans are found once for them, and each of them is rewritten.

Defined cases: null texts have no spans and stay null; empty tables give empty ones; texts
of any length are rewritten whole; equal edits count once; columns of other names stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import escaped, spans_of
from ..sources.blocks import normalised
from . import fuse
from .detect import CANDIDATES
from .entities import TITLES, normal

# Words that show that a single word is the name of a company.
COMPANY_WORDS = ("limited", "ltd", "ltd.", "private", "pvt", "llp", "corporation", "inc", "inc.", "plc", "llc", "group")
ALWAYS = ("EMAIL", "PHONE", "CREDIT_CARD", "SSN", "IP_ADDRESS")


def searchable(entities: DataFrame, strict_titles: bool = False) -> DataFrame:
    """doc_id, entity_type, value: what is searched in all blocks of the document. A titled name is also searched without its title."""
    words = F.split(F.regexp_replace("original", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    kind = F.col("entity_type")
    marked = F.arrays_overlap(F.transform(words, F.lower), F.array(*map(F.lit, COMPANY_WORDS)))
    eligible = ((kind == "PERSON") & (F.size(words) >= 2)) | ((kind == "COMPANY") & ((F.size(words) >= 2) | marked)) | kind.isin(*ALWAYS)
    bare = F.regexp_replace("original", r"(?iu)^(?:" + "|".join(TITLES) + r")\.?\s+", "")
    forms = F.array("original") if strict_titles else F.array_distinct(F.array(F.col("original"), F.when((kind == "PERSON") & bare.contains(" "), bare).otherwise(F.col("original"))))
    return entities.where(eligible).select("doc_id", "entity_type", F.explode(forms).alias("value")).distinct()


def literal_pattern(value: Column) -> Column:
    """A pattern for the value itself, at word boundaries where its edges are letters or digits, in any case."""
    edge = lambda c: F.when(c.rlike(r"^[\p{L}\p{N}]"), F.lit(r"\b")).otherwise(F.lit(""))
    return F.concat(F.lit("(?iu)(?U)"), edge(F.substring(value, 1, 1)), escaped(value), edge(F.substring(value, -1, 1)))


def propagate(blocks: DataFrame, entities: DataFrame) -> DataFrame:
    """doc_id, block_seq, found: candidates with source propagation for blocks that hold known values.

    Both sides are keyed by doc_id; a block meets only values of its own document that it
    contains, so patterns are compiled for true hits.
    """
    known = searchable(entities).select(F.col("doc_id").alias("d"), "entity_type", "value")
    met = blocks.select("doc_id", "block_seq", "text").join(known, (F.col("doc_id") == F.col("d")) & F.contains(F.lower("text"), F.lower("value")))
    hits = met.withColumn("s", F.explode(spans_of(F.col("text"), literal_pattern(F.col("value")))))
    one = F.struct("entity_type", F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(1.0).alias("confidence"), F.lit("propagation").alias("source"))
    return hits.groupBy("doc_id", "block_seq").agg(F.array_sort(F.collect_set(one)).cast(CANDIDATES).alias("found"))


def final_spans(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, block_seq, spans: own (blocks: doc_id, block_seq, kept) and propagated ones, fused once more."""
    joined = blocks.join(found, ["doc_id", "block_seq"], "full_outer")
    own = F.transform(F.col("kept"), lambda c: F.struct(*(c[n].alias(n) for n in ("entity_type", "text", "start", "end", "confidence", "source")))).cast(CANDIDATES)
    none = F.array().cast(CANDIDATES)
    return joined.withColumn("spans", fuse.resolve(F.concat(F.coalesce(own, none), F.coalesce("found", none)))).select("doc_id", "block_seq", "spans")


def with_replacements(spanned: DataFrame, keys: DataFrame, synthetic: DataFrame) -> DataFrame:
    """One row per span: doc_id, block_seq, entity_type, start, end, original_text, replacement_text."""
    spans = spanned.select("doc_id", "block_seq", F.explode("spans").alias("s")).select("doc_id", "block_seq", "s.entity_type", "s.start", "s.end", F.col("s.text").alias("original_text"))
    named = spans.withColumn("norm", normal(F.col("entity_type"), F.col("original_text")))
    ids = keys.select("doc_id", "entity_type", "norm", "id")
    made = synthetic.select("doc_id", "id", "synthetic")
    out = named.join(ids, ["doc_id", "entity_type", "norm"], "left").join(made, ["doc_id", "id"], "left")
    return out.select("doc_id", "block_seq", "entity_type", "start", "end", "original_text", F.coalesce("synthetic", "original_text").alias("replacement_text")).distinct()


def spliced(text: Column, edits: Column) -> Column:
    """text with edits (array<struct<start, end, replacement>>, disjoint, by start) put in."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        return F.struct(e["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["replacement"]).alias("out"))

    return F.aggregate(edits, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(blocks: DataFrame, replaced: DataFrame) -> DataFrame:
    """blocks with redacted: every span replaced."""
    edits = replaced.groupBy("doc_id", "block_seq").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.col("replacement_text").alias("replacement")))).alias("edits"))
    joined = blocks.join(edits, ["doc_id", "block_seq"], "left")
    return joined.withColumn("redacted", F.when(F.col("edits").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("edits")))).drop("edits")


def run_spans(offsets: Column, start: Column, end: Column) -> Column:
    """array<struct<run_index, start_in_run, end_in_run, text_in_run>>: what a span covers in each run (offsets: idx, start, end, text)."""
    covered = F.filter(offsets, lambda r: (r["start"] < end) & (start < r["end"]))

    def inside(r: Column) -> Column:
        low, high = F.greatest(start, r["start"]) - r["start"], F.least(end, r["end"]) - r["start"]
        return F.struct(r["idx"].alias("run_index"), low.alias("start_in_run"), high.alias("end_in_run"), F.substring(r["text"], low + 1, high - low).alias("text_in_run"))

    return F.transform(covered, inside)


def checked_run_spans(offsets: Column, start: Column, end: Column, text: Column) -> Column:
    """run_spans, or an error: for places that are not inside the runs, that no run covers, or whose runs hold another text (after normalisation)."""
    whole = F.array_join(F.transform(offsets, lambda r: r["text"]), "")
    held = F.substring(whole, start + 1, end - start)
    problem = (
        F.when((start < 0) | (start >= end), F.lit("a span needs 0 <= start < end"))
        .when(end > F.length(whole), F.lit("a span ends behind the last run"))
        .when(normalised(held) != normalised(text), F.lit("the runs hold another text than the span"))
    )
    spans = run_spans(offsets, start, end)
    kind = "array<struct<run_index:int,start_in_run:int,end_in_run:int,text_in_run:string>>"
    return F.when(problem.isNotNull(), F.raise_error(problem).cast(kind)).otherwise(spans.cast(kind))


def rewrite_runs(offsets: Column, edits: Column) -> Column:
    """New texts of runs: a replacement goes where its span begins, the rest of the span leaves the runs it covers."""

    def one(r: Column) -> Column:
        own = F.filter(edits, lambda e: (e["start"] < r["end"]) & (r["start"] < e["end"]))
        local = F.transform(
            own,
            lambda e: F.struct((F.greatest(e["start"], r["start"]) - r["start"]).alias("start"), (F.least(e["end"], r["end"]) - r["start"]).alias("end"), F.when(e["start"] >= r["start"], e["replacement"]).otherwise("").alias("replacement")),
        )
        return spliced(r["text"], local)

    return F.transform(offsets, one)
