"""Small results as markdown. Tables are aggregates or bounded lists; only they come to the driver.

Empty tables give sections without rows; nulls are empty cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import audit, evaluate

#: Rows that a section of a report shows at most; the tables themselves are queries without a limit.
ROWS = 200


def markdown(title: str, tables: dict[str, DataFrame]) -> str:
    out = [f"# {title}", ""]
    for name, table in tables.items():
        rows = table.limit(ROWS).collect()
        out += [f"## {name}", "", "| " + " | ".join(table.columns) + " |", "|" + " --- |" * len(table.columns)]
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in row) + " |" for row in rows]
        out.append("")
    return "\n".join(out)


def detection(judged: DataFrame) -> str:
    """What was found in a document. judged: blocks with path, candidates, resolved and validated."""
    spans = judged.select("doc_id", "block_seq", "text", F.explode("validated").alias("v")).where("v.decision = 'KEEP'")
    spans = spans.select("doc_id", "block_seq", "v.entity_type", "v.start", "v.end", F.col("v.text").alias("value"), evaluate.snippet(F.col("text"), F.col("v.start"), F.col("v.end")).alias("context"))
    return markdown(
        "Detection",
        {
            "Stages": evaluate.stage_counts(judged),
            "Candidates by detector": evaluate.profile(judged).orderBy("source", "entity_type"),
            "Kept by container and type": evaluate.kept_by(judged).orderBy("container", "entity_type"),
            "Decisions": audit.decisions(judged).orderBy("entity_type", "reason"),
            "Examples": evaluate.examples(spans).orderBy("entity_type", "nth"),
        },
    )


def full_audit(judged: DataFrame) -> str:
    """Where detectors disagree, what was rejected and what may have been missed."""
    return markdown(
        "Audit",
        {
            "Detectors": audit.disagreement(judged).orderBy("sources"),
            "Rejected": audit.rejections(judged).orderBy("reason", F.desc("n"), "text"),
            "Possibly missed": audit.missed(judged),
            "Containers": audit.structure(judged).orderBy("container"),
        },
    )


def benchmark(blocks: DataFrame, truth: DataFrame, predicted: DataFrame) -> str:
    """Scores of predictions. blocks: block, text."""
    modes = {"Strict": evaluate.strict(truth, predicted), "Overlap": evaluate.overlapping(truth, predicted), "Normalised": evaluate.overlapping(truth, predicted, normalised=True)}
    tables = {name: evaluate.ratios(evaluate.by_category(counts)).orderBy("entity_type") for name, counts in modes.items()}
    tables |= {f"{name}, averages": evaluate.averages(counts) for name, counts in modes.items()}
    return markdown("Benchmark", tables | {"Tokens": evaluate.token_counts(blocks, truth, predicted)})


def assurance(redacted: DataFrame, manifest: DataFrame, counts: DataFrame | None = None) -> str:
    """Whether a redaction holds. counts: audit.structure_check, where there are files."""
    tables = {
        "Gate": audit.gate(redacted, manifest),
        "Replaced": manifest.groupBy("entity_type").count().orderBy("entity_type"),
        "Leaks": audit.leaks(redacted, manifest),
        "Not in place": audit.unplaced(redacted, manifest),
    }
    return markdown("Redaction", tables | ({} if counts is None else {"Structure": counts.orderBy("file", "count")}))


def inspection(elements: DataFrame) -> str:
    """What a document is made of. elements: file, block_seq, path, runs."""
    blocks = elements.select(F.col("file").alias("doc_id"), "block_seq", F.array_join("runs", "").alias("text"))
    runs = elements.select(F.col("file").alias("doc_id"), "block_seq", F.posexplode("runs").alias("run_idx", "text"))
    return markdown("Inspection", {"Counts": audit.element_counts(elements), "Words in two runs": audit.fragmented(runs), "Keywords": audit.keyword_hints(blocks)})
