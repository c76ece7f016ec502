"""Audits of a detection and checks of a redaction.

The checks name documents by doc_id and, where both tables have it, row (see
functions/identity), so documents that share a doc_id or have none are checked each by
itself. Defined cases: empty tables give empty audits, and a gate that passes; null texts
hold nothing; blocks that repeat count once as leaks and once as unplaced; ties stand in
the order of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import packed, unpacked
from ..functions.spans import spans_of
from .evaluate import snippet
from .rewrite import literal_pattern

# Types of which no original may be left anywhere.
CRITICAL = ("PERSON", "EMAIL", "PHONE", "CREDIT_CARD", "SSN", "IP_ADDRESS", "DATE_OF_BIRTH")

# Looser forms that hint at something missed.
HINTS = {
    "titled_name": r"(?U)\b(?:Mr\.|Ms\.|Mrs\.|Shri|Shree|Dr\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b",
    "company_name": r"(?U)\b[A-Z][a-zA-Z0-9&]*(?:\s+[A-Z][a-zA-Z0-9&]*){1,4}\s+(?:Limited|Private Limited|LLP|Corporation|Pvt\.\s+Ltd\.|Ltd\.)",
    "email": r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "mobile": r"(?U)\b(?:\+91|91)?[6789]\d{9}\b",
}
KEYWORDS = ("director", "email", "phone", "telephone", "address", "registered office", "promoter", "pan")


def decisions(validated: DataFrame) -> DataFrame:
    """entity_type, decision, reason, n. validated: blocks with an array `validated`."""
    return validated.select(F.explode("validated").alias("v")).groupBy("v.entity_type", "v.decision", "v.reason").agg(F.count(F.lit(1)).alias("n"))


def disagreement(judged: DataFrame) -> DataFrame:
    """sources, n: which detectors overlap each span that stays. judged: blocks with `candidates` and `validated`."""
    kept = judged.select("candidates", F.explode("validated").alias("v")).where("v.decision = 'KEEP'")
    met = F.filter("candidates", lambda c: (c["start"] < F.col("v.end")) & (F.col("v.start") < c["end"]))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(met, lambda c: c["source"]))), " + ")
    return kept.groupBy(names.alias("sources")).agg(F.count(F.lit(1)).alias("n"))


def rejections(validated: DataFrame, n: int = 10) -> DataFrame:
    """reason, text, n, total: the n most frequent rejected texts of each reason."""
    rows = validated.select(F.explode("validated").alias("v")).where("v.decision = 'REJECT'").groupBy("v.reason", "v.text").agg(F.count(F.lit(1)).alias("n"))
    total = rows.groupBy("reason").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("reason").orderBy(F.desc("n"), "text")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).join(total, "reason").select("reason", "text", "n", "total")


def missed(judged: DataFrame, n: int | None = 25) -> DataFrame:
    """doc_id, block_seq, hint, text, start, end, context: loose matches that overlap no validated span, kept or not; n: how many are reported."""
    hints = F.concat(*(F.transform(spans_of(F.col("text"), p, "@" if name == "email" else ""), _hint(name)) for name, p in HINTS.items()))
    free = F.filter(hints, lambda h: ~F.exists(F.col("validated"), lambda v: (v["start"] < h["end"]) & (h["start"] < v["end"])))
    rows = judged.select("doc_id", "block_seq", F.col("text").alias("whole"), F.explode(free).alias("h")).select("doc_id", "block_seq", "h.hint", "h.text", "h.start", "h.end", snippet(F.col("whole"), F.col("h.start"), F.col("h.end")).alias("context"))
    return rows if n is None else rows.orderBy("doc_id", "block_seq", "start", "hint").limit(n)


def _hint(name: str):
    return lambda s: F.struct(F.lit(name).alias("hint"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end"))


def _searched(text: Column, kind: Column, original: Column) -> Column:
    """Whether a text holds an original: addresses and bare numbers anywhere, others as whole words, in this case."""
    anywhere = (kind == "EMAIL") | original.rlike(r"^[0-9]+$")
    return F.when(anywhere, F.contains(text, original)).otherwise(F.call_function("rlike", text, F.regexp_replace(literal_pattern(original), r"^\(\?iu\)", "")))


def _named(redacted: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    by_row = "row" in redacted.columns and "row" in manifest.columns
    return tuple(packed(df if by_row else df.drop("row")) for df in (redacted, manifest))


def leaks(redacted: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id, row, block_seq, entity_type, original_text: critical originals that a redacted block of their document still holds.

    An original that is only there because of one of the block's replacements is no leak.
    """
    redacted, manifest = _named(redacted, manifest)
    originals = manifest.where(F.col("entity_type").isin(*CRITICAL) & (F.length(F.trim("original_text")) > 3)).select("doc_id", "entity_type", "original_text").distinct()
    new = manifest.groupBy("doc_id", "block_seq").agg(F.collect_set("replacement_text").alias("new"))
    met = redacted.select("doc_id", "block_seq", "redacted").join(originals, "doc_id").where(F.contains("redacted", "original_text") & _searched(F.col("redacted"), F.col("entity_type"), F.col("original_text")))
    known = met.join(new, ["doc_id", "block_seq"], "left").withColumn("new", F.coalesce(F.col("new"), F.array().cast("array<string>")))
    explained = F.exists("new", lambda r: ~_searched(F.replace(F.col("redacted"), r, F.lit("")), F.col("entity_type"), F.col("original_text")))
    return unpacked(known.where(~explained).select("doc_id", "block_seq", "entity_type", "original_text").distinct())


def unplaced(redacted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of other types whose replacement is in no such block."""
    redacted, manifest = _named(redacted, manifest)
    rows = manifest.where(~F.col("entity_type").isin(*CRITICAL))
    there = redacted.select(F.col("doc_id").alias("d"), F.col("block_seq").alias("b"), "redacted")
    return unpacked(rows.join(there, (F.col("doc_id") == F.col("d")) & (F.col("block_seq") == F.col("b")) & F.contains("redacted", "replacement_text"), "left_anti"))


def gate(redacted: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: total, critical, contextual, leaks, unplaced, passed. Only leaks decide."""
    critical = F.col("entity_type").isin(*CRITICAL).cast("long")
    none = F.lit(0).cast("long")
    parts = (
        manifest.select(F.lit(1).cast("long").alias("total"), critical.alias("critical"), none.alias("leaks"), none.alias("unplaced"))
        .unionAll(leaks(redacted, manifest).select(none, none, F.lit(1).cast("long"), none))
        .unionAll(unplaced(redacted, manifest).select(none, none, none, F.lit(1).cast("long")))
    )
    one = parts.agg(*(F.coalesce(F.sum(c), none).alias(c) for c in ("total", "critical", "leaks", "unplaced")))
    return one.select("total", "critical", (F.col("total") - F.col("critical")).alias("contextual"), "leaks", "unplaced", (F.col("leaks") == 0).alias("passed"))


def structure(blocks: DataFrame) -> DataFrame:
    """container, documents, blocks, characters."""
    container = F.regexp_extract("path", r"^(\w+)", 1)
    return blocks.groupBy(container.alias("container")).agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("characters"))


#: Counts that a redaction must not change.
KEPT_COUNTS = ("paragraphs", "tables", "cells", "sections", "header_paragraphs", "footer_paragraphs")


def element_counts(elements: DataFrame) -> DataFrame:
    """file and eleven counts: paragraphs and runs of body, cells, headers and footers, and tables, rows and cells; sections besides.

    elements: file, path, runs (array<string>), one row for each paragraph as docx.read gives
    them. A header that several sections share counts in each, as a cell that is merged does.
    """
    kind = F.regexp_extract("path", r"^(\w+)", 1)
    place = lambda name: F.regexp_extract("path", rf"{name}=(\d+)", 1)
    rows = elements.select("file", kind.alias("kind"), F.size("runs").alias("runs"), *(place(n).alias(n) for n in ("table", "row", "cell", "section")))

    def of(what: str, value) -> list[Column]:
        here = F.col("kind") == what
        return [F.count_if(here).alias(f"{value}paragraphs"), F.coalesce(F.sum(F.when(here, F.col("runs"))), F.lit(0)).alias(f"{value}runs")]

    in_table = F.col("kind") == "table"
    distinct = lambda cond, *names: F.count_distinct(F.when(cond, F.struct(*names)))
    return rows.groupBy("file").agg(
        *of("body", ""),
        distinct(in_table, "table").alias("tables"),
        distinct(in_table, "table", "row").alias("rows"),
        distinct(in_table, "table", "row", "cell").alias("cells"),
        *of("table", "cell_"),
        *of("header", "header_"),
        *of("footer", "footer_"),
        distinct(F.col("section") != "", "section").alias("sections"),
    )


def structure_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, count, before, after, same: KEPT_COUNTS of two tables of element_counts; a file that only one has differs in all of them."""

    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.select("file", F.explode(F.array(*(F.struct(F.lit(c).alias("count"), F.col(c).cast("long").alias(name)) for c in KEPT_COUNTS))).alias("x")).select("file", "x.*")

    both = tall(before, "before").join(tall(after, "after"), ["file", "count"], "full_outer")
    return both.withColumn("same", F.coalesce(F.col("before") == F.col("after"), F.lit(False)))


def fragmented(runs: DataFrame, paragraphs: int = 200, n: int = 10) -> DataFrame:
    """Words that are split between two runs. runs: doc_id, block_seq, run_idx, text; the first n places in the first paragraphs of each document."""
    order = Window.partitionBy("doc_id", "block_seq").orderBy("run_idx")
    pairs = runs.where(F.col("block_seq") < paragraphs).withColumn("next", F.lead("text").over(order))
    split = pairs.where(F.col("text").rlike(r"(?U)[^\W_]$") & F.col("next").rlike(r"(?U)^[^\W_]"))
    word = F.concat(F.regexp_extract("text", r"(?U)(\S+)\s*$", 1), F.regexp_extract("next", r"(?U)^\s*(\S+)", 1))
    context = F.concat(F.lit("..."), F.right(F.col("text"), F.lit(15)), F.lit(" | "), F.left(F.col("next"), F.lit(15)), F.lit("..."))
    first = Window.partitionBy("doc_id").orderBy("block_seq", "run_idx")
    out = split.select("doc_id", "block_seq", "run_idx", F.col("text").alias("run_text_1"), F.col("next").alias("run_text_2"), word.alias("word"), context.alias("context"))
    return out.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n).drop("nth")


def keyword_hints(blocks: DataFrame, n: int = 20) -> DataFrame:
    """doc_id, block_seq, keyword, characters: blocks with a word that goes with personal data, by the first such word in list order; the first n of each document."""
    low = F.lower("text")
    word = F.coalesce(*(F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in KEYWORDS))
    first = Window.partitionBy("doc_id").orderBy("block_seq")
    rows = blocks.select("doc_id", "block_seq", word.alias("keyword"), F.length("text").alias("characters")).where("keyword IS NOT NULL")
    return rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n).drop("nth")
