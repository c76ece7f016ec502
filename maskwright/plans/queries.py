"""Queries of the library over the driver's tables, each with DuckDB SQL where SQL can say it.

Texts are read whole and tables are read in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import left_of, spans_of
from ..functions.tables import shared_dir, stored
from ..operators import audit, detect, entities, evaluate, fuse, models, rewrite, synthesize, validate
from ..sources import blocks as sources
from ..sources import truth
from . import fixtures, redaction

Query = Callable[[SparkSession, str], DataFrame]
RUN = 40  # characters of a run where a table has none


def _long(df: DataFrame) -> DataFrame:
    """Integers as long, as SQL has them."""
    return df.select(*(F.col(n).cast("long").alias(n) if t in ("int", "bigint", "smallint") else F.col(n) for n, t in df.dtypes))


def _exploded(blocks: DataFrame, array: F.Column) -> DataFrame:
    rows = blocks.select("doc_id", "block_seq", F.explode(array).alias("s"))
    return rows.select("doc_id", "block_seq", "s.*")


def _by(*names: str) -> Query:
    """Spans of single detectors."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _exploded(sources.documents(spark, sf_dir), F.concat(*(detect.REGEX[n](F.col("text")) for n in names)))
        return _long(found.select("doc_id", "block_seq", "entity_type", "start", "end", "text"))

    return run


def blocks_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(sources.documents(spark, sf_dir).select("doc_id", "block_seq", "text"))


def _counts(read: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _long(evaluate.profile(detect.detect(read(spark, sf_dir))).groupBy("entity_type").agg(F.sum("raw").alias("n")))

    return run


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(sources.documents(spark, sf_dir)).withColumn("resolved", fuse.resolve(F.col("candidates")))


def fuse_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _exploded(_resolved(spark, sf_dir), F.col("resolved"))
    return _long(found.select("doc_id", "block_seq", "entity_type", "start", "end", "text"))


def _judged_of(blocks: DataFrame) -> DataFrame:
    """blocks with candidates, resolved and validated."""
    resolved = detect.detect(blocks).withColumn("resolved", fuse.resolve(F.col("candidates")))
    kinds = F.filter("resolved", lambda c: c["entity_type"] != "DATE")
    return resolved.withColumn("validated", validate.validate(F.col("text"), kinds))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged_of(sources.documents(spark, sf_dir))


def validate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.decisions(_judged(spark, sf_dir)))


def audit_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.disagreement(_judged(spark, sf_dir)))


def audit_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.rejections(_judged(spark, sf_dir)))


def audit_missed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.missed(_judged(spark, sf_dir), n=None))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions that stay, written once: they are few and used often."""
    return stored(redaction.mentions(redaction.local(sources.documents(spark, sf_dir))))


def entity_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(entities.resolve(_kept(spark, sf_dir)).entities)


def synthetic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = entities.resolve(_kept(spark, sf_dir))
    return synthesize.replacements(store.entities, store.owners).select("doc_id", "id", "original", "synthetic")


def propagate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = entities.resolve(_kept(spark, sf_dir))
    found = rewrite.propagate(sources.documents(spark, sf_dir), store.entities)
    return _long(_exploded(found, F.col("found")).select("doc_id", "block_seq", "entity_type", "start", "end", "text"))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redaction.redact(sources.documents(spark, sf_dir))
    return _long(done.blocks.select("doc_id", "block_seq", "redacted"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(redaction.redact(sources.documents(spark, sf_dir)).manifest.drop("row"))


def assurance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = redaction.redact(sources.documents(spark, sf_dir))
    return _long(audit.gate(done.blocks, done.manifest))


def assurance_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check finds what is there: run against the texts as they were, every critical original is a leak."""
    blocks = sources.documents(spark, sf_dir)
    done = redaction.redact(blocks)
    return _long(audit.leaks(blocks.withColumn("redacted", F.col("text")), done.manifest.withColumn("replacement_text", F.lit("#"))).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")))


def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.structure(sources.documents(spark, sf_dir)))


def keyword_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.keyword_hints(sources.documents(spark, sf_dir)))


def _runs(blocks: DataFrame) -> DataFrame:
    """doc_id, block_seq, run_idx, text: blocks cut into runs of RUN characters."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / RUN).cast("int")), lambda i: F.substring("text", i * RUN + 1, F.lit(RUN)))
    return blocks.select("doc_id", "block_seq", F.posexplode(cuts).alias("run_idx", "text"))


def fragmented_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.fragmented(_runs(sources.documents(spark, sf_dir))).select("doc_id", "block_seq", "run_idx", "run_text_1", "run_text_2"))


def run_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / RUN).cast("int")), lambda i: F.substring("text", i * RUN + 1, F.lit(RUN)))
    emails = sources.documents(spark, sf_dir).withColumn("runs", sources.run_offsets(cuts)).withColumn("s", F.explode(spans_of(F.col("text"), detect.EMAIL)))
    rows = emails.select("doc_id", "block_seq", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode(rewrite.run_spans(F.col("runs"), F.col("s.start"), F.col("s.end"))).alias("r"))
    return _long(rows.select("doc_id", "block_seq", "start", "end", "r.*"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, true spans (addresses of mail and IPv4) and predictions that differ from them by a rule: every third document has none, every fifth is off by one."""
    blocks = sources.documents(spark, sf_dir).withColumn("block", F.concat_ws("/", "doc_id", "block_seq"))
    found = F.concat(detect.REGEX["email"](F.col("text")), detect.REGEX["ipv4"](F.col("text")))
    true_spans = stored(blocks.select("doc_id", "block", F.explode(found).alias("s")).select("doc_id", "block", fuse.canonical(F.col("s.entity_type")).alias("entity_type"), "s.start", "s.end"))
    off = (F.col("doc_id") % 5 == 0).cast("int")
    predicted = true_spans.where("doc_id % 3 <> 0").withColumn("start", F.col("start") + off)
    return blocks.select("block", "text"), true_spans.drop("doc_id"), predicted.drop("doc_id")


def metrics_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, true_spans, predicted = _scored(spark, sf_dir)
    return _long(evaluate.strict(true_spans, predicted))


def metrics_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, true_spans, predicted = _scored(spark, sf_dir)
    return _long(evaluate.overlapping(true_spans, predicted))


def metrics_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, true_spans, predicted = _scored(spark, sf_dir)
    scored = evaluate.ratios(evaluate.overlapping(true_spans, predicted, normalised=True))
    return _long(scored.select("entity_type", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1"))))


def metrics_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(evaluate.token_counts(*_scored(spark, sf_dir)))


def metrics_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, true_spans, predicted = _scored(spark, sf_dir)
    means = evaluate.averages(evaluate.strict(true_spans, predicted))
    return means.select("kind", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def number_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit runs of documents with the rules on what stands before them."""
    found = sources.documents(spark, sf_dir).select("doc_id", "block_seq", "text", F.explode(spans_of(F.col("text"), r"[0-9]{3,}", detect.has_digit)).alias("s"))
    numbers = found.select("doc_id", "block_seq", "text", "s.start", F.col("s.text").alias("number"))
    before = F.lower(left_of(F.col("text"), F.col("start"), 20))
    return _long(numbers.select("doc_id", "block_seq", "start", "number", detect.luhn_valid(F.col("number")).alias("luhn"), before.alias("before")))


def detect_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors of what the tables do not hold: national ids, IPv6, dates, companies, addresses."""
    names = ("ssn", "ipv6", "date", "registry", "company", "street", "office", "place_pin")
    found = fixtures.frame(spark, "texts").select("doc_id", F.explode(F.concat(*(detect.REGEX[n](F.col("text")) for n in names))).alias("s"))
    return _long(found.select("doc_id", "s.entity_type", "s.start", "s.end", "s.text"))


def fuse_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.frame(spark, "spans").withColumn("source", F.lit("x")).withColumn("text", F.lit("x"))
    one = F.struct("entity_type", "text", "start", "end", "confidence", "source")
    arrays = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return _long(arrays.select("doc_id", F.explode(fuse.resolve(F.col("c"))).alias("r")).select("doc_id", "r.entity_type", "r.start", "r.end", "r.confidence", F.size("r.sources").alias("n_sources")))


def validate_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.frame(spark, "contexts").withColumn("at", F.instr("text", F.col("value")) - 1)
    one = F.struct("entity_type", F.col("value").alias("text"), F.col("at").alias("start"), (F.col("at") + F.length("value")).alias("end"), F.lit(0.9).alias("confidence"), F.lit("x").alias("source"))
    judged = rows.select("doc_id", F.explode(validate.validate(F.col("text"), F.array(one))).alias("v"))
    return judged.select("doc_id", "v.entity_type", "v.text", "v.decision", "v.reason")


def alias_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve(fixtures.frame(spark, "mentions")).keys.select("doc_id", "entity_type", "norm", "id")


def email_link_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.resolve(fixtures.frame(spark, "mentions")).owners.select("doc_id", "email_id", "person_id")


def redact_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents united with themselves: each row is rewritten as if it stood alone."""
    blocks = sources.documents(spark, sf_dir)
    done = redaction.redact(blocks.unionAll(blocks)).blocks
    return _long(done.groupBy("doc_id", "block_seq", "redacted").agg(F.count(F.lit(1)).alias("n")))


def redact_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without a doc_id: none of them takes another's replacements."""
    done = redaction.redact(sources.documents(spark, sf_dir).withColumn("doc_id", F.lit(None).cast("long"))).blocks
    return _long(done.groupBy("block_seq", "redacted").agg(F.count(F.lit(1)).alias("n")))


def redact_one_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents of which many share a doc_id."""
    done = redaction.redact(sources.documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id") % 10)).manifest
    return _long(done.select("doc_id", "block_seq", "entity_type", "start", "end", "original_text", "replacement_text"))


def truth_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of mail as ground truth, written and read as JSON, and looked up by path; every fifth document has paths that are wrong."""
    blocks = sources.documents(spark, sf_dir).withColumn("document_hash", F.col("doc_id").cast("string"))
    wrong = F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")
    entity = F.transform(detect.REGEX["email"](F.col("text")), lambda s: F.struct(F.lit("EMAIL").alias("entity_type"), s["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    one = F.struct(F.concat("path", wrong).alias("container_path"), "text", F.col("entities"))
    made = blocks.withColumn("entities", entity).where(F.size("entities") > 0).groupBy("document_hash").agg(F.collect_list(one).alias("blocks"))
    path = f"{shared_dir(spark)}/maskwright-truth-{uuid.uuid4().hex}"
    made.write.json(path)
    found = truth.located(truth.blocks_of(truth.read_lines(spark, path)), blocks)
    rows = found.select("document_hash", "path", "found", F.explode("entities").alias("e"), F.coalesce(F.col("text") == F.col("block_text"), F.lit(False)).alias("same_text"))
    return _long(rows.select("document_hash", "path", "found", "same_text", "e.start", "e.end", F.col("e.text").alias("text")))


def _elements(blocks: DataFrame) -> DataFrame:
    """Blocks as paragraphs of files: by block_seq in turn of the body, of tables, of headers and of footers."""
    n = F.col("block_seq")
    path = (
        F.when(n % 4 == 0, F.format_string("body / paragraph=%d", n))
        .when(n % 4 == 1, F.format_string("table / table=%d / row=%d / cell=%d / paragraph=%d", F.floor(n / 40), F.floor(n / 8) % 5, F.floor(n / 4) % 2, n))
        .when(n % 4 == 2, F.format_string("header / section=%d / paragraph=%d", F.floor(n / 16), n))
        .otherwise(F.format_string("footer / section=%d / paragraph=%d", F.floor(n / 16), n))
    )
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / RUN).cast("int")), lambda i: F.substring("text", i * RUN + 1, F.lit(RUN)))
    return blocks.select(F.col("doc_id").cast("string").alias("file"), path.alias("path"), cuts.alias("runs"))


def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.element_counts(_elements(sources.documents(spark, sf_dir))))


def structure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all files against counts without the blocks from the fifth on of every third document."""
    blocks = sources.documents(spark, sf_dir)
    fewer = blocks.where("doc_id % 3 <> 0 OR block_seq < 5")
    return _long(audit.structure_check(audit.element_counts(_elements(blocks)), audit.element_counts(_elements(fewer))))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(evaluate.stage_counts(_judged(spark, sf_dir)))


def kept_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(evaluate.kept_by(_judged(spark, sf_dir)))


def span_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which detectors' candidates lie inside each span that stays."""
    spans = _judged(spark, sf_dir).select("doc_id", "block_seq", "candidates", F.explode("validated").alias("v")).where("v.decision = 'KEEP'")
    names = evaluate.containing_sources(F.col("candidates"), F.col("v.start"), F.col("v.end"))
    return _long(spans.select("doc_id", "block_seq", "v.start", "v.end", names.alias("detectors")))


def span_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three spans of each type."""
    spans = _judged(spark, sf_dir).select("doc_id", "block_seq", F.explode("validated").alias("v")).where("v.decision = 'KEEP'")
    return _long(evaluate.examples(spans.select("doc_id", "block_seq", "v.entity_type", "v.start", "v.end", "v.text")))


def metrics_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, truth_spans, predicted = _scored(spark, sf_dir)
    return _long(evaluate.by_category(evaluate.strict(truth_spans, predicted)))


def metrics_unread_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True spans of blocks that have no text to look at are missed."""
    _, truth_spans, predicted = _scored(spark, sf_dir)
    unread = truth_spans.select(F.concat_ws("/", F.lit("unread"), "block").alias("block"), F.lit("PERSON").alias("entity_type"), "start", "end")
    return _long(evaluate.strict(truth_spans.unionByName(unread), predicted))


def run_mapping_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_mapping with the checks of place and text."""
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / RUN).cast("int")), lambda i: F.substring("text", i * RUN + 1, F.lit(RUN)))
    emails = sources.documents(spark, sf_dir).withColumn("runs", sources.run_offsets(cuts)).withColumn("s", F.explode(spans_of(F.col("text"), detect.EMAIL, "@")))
    rows = emails.select("doc_id", "block_seq", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode(rewrite.checked_run_spans(F.col("runs"), F.col("s.start"), F.col("s.end"), F.col("s.text"))).alias("r"))
    return _long(rows.select("doc_id", "block_seq", "start", "end", "r.*"))


def _pairs_of_capitals():
    """Stands in for a statistical model: two capitalised words are a person."""
    import re

    pattern = re.compile("[A-Z][a-z]{2,} [A-Z][a-z]{2,}")
    return lambda text: [("PERSON", *m.span(), 1.0) for m in pattern.finditer(text)] + [("UNKNOWN", 0, 1, 1.0)]


def detect_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = models.model_detector(_pairs_of_capitals, models.NAMES, "ner")
    return _long(_exploded(sources.documents(spark, sf_dir), found(F.col("text"))).select("doc_id", "block_seq", "entity_type", "start", "end", "text", "confidence"))


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line behind them that holds what they lack: companies, addresses, national ids and more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL")
    line = F.element_at(F.array(*map(F.lit, fixtures.SEEDS)), (F.pmod(F.col("doc_id"), F.lit(len(fixtures.SEEDS))) + 1).cast("int"))
    return sources.blocks_of(docs.withColumn("text", F.concat_ws("\n", "text", line)), "doc_id", "text")


def seeded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(evaluate.profile(detect.detect(_seeded(spark, sf_dir), detect.REGEX)).groupBy("entity_type").agg(F.sum("raw").alias("n")))


def seeded_keyword_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(audit.keyword_hints(_seeded(spark, sf_dir)))


QUERIES: dict[str, Query] = {
    "detect_fixture": detect_fixture,
    "fuse_fixture": fuse_fixture,
    "validate_fixture": validate_fixture,
    "alias_fixture": alias_fixture,
    "email_link_fixture": email_link_fixture,
    "blocks_scan": blocks_scan,
    "detect_email": _by("email"),
    "detect_ipv4": _by("ipv4"),
    "detect_card_luhn": _by("card"),
    "detect_phone": _by("phone"),
    "number_context": number_context,
    "candidates_union_counts": _counts(sources.documents),
    "candidates_pages": _counts(sources.pages),
    "candidates_conversations": _counts(sources.conversations),
    "fuse_resolved": fuse_resolved,
    "validate_counts": validate_counts,
    "entity_ids": entity_ids,
    "synthetic_values": synthetic_values,
    "propagate_spans": propagate_spans,
    "redact_documents": redact_documents,
    "manifest": manifest,
    "run_mapping": run_mapping,
    "fragmented_runs": fragmented_runs,
    "structure_counts": structure_counts,
    "keyword_hints": keyword_hints,
    "metrics_strict": metrics_strict,
    "metrics_overlap": metrics_overlap,
    "metrics_normalised": metrics_normalised,
    "metrics_tokens": metrics_tokens,
    "metrics_averages": metrics_averages,
    "audit_disagreement": audit_disagreement,
    "audit_rejections": audit_rejections,
    "audit_missed": audit_missed,
    "assurance_gate": assurance_gate,
    "assurance_leaks": assurance_leaks,
    "redact_repeated": redact_repeated,
    "redact_without_ids": redact_without_ids,
    "redact_one_id": redact_one_id,
    "truth_located": truth_located,
    "element_counts": element_counts,
    "structure_check": structure_check,
    "stage_counts": stage_counts,
    "kept_by_type": kept_by_type,
    "span_sources": span_sources,
    "span_examples": span_examples,
    "metrics_categories": metrics_categories,
    "metrics_unread_blocks": metrics_unread_blocks,
    "run_mapping_checked": run_mapping_checked,
    "detect_model": detect_model,
    "seeded_candidates": seeded_candidates,
    "seeded_keyword_hints": seeded_keyword_hints,
}
