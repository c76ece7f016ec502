"""python -m maskwright.cli --input in.docx --output out.docx [--report report.md]
python -m maskwright.cli inspect --input in.docx [--report report.md]
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, rewrite
from .plans import redaction, reports
from .sources import blocks as sources
from .sources import docx


def check_arguments(source: str | None, target: str | None, written: bool = True) -> None:
    """Raises ValueError or FileNotFoundError with a message for the user."""
    for name, value in (("input", source), ("output", target))[: 1 + written]:
        if not value or not value.strip():
            raise ValueError(f"--{name} is missing")
        if not value.lower().endswith(".docx"):
            raise ValueError(f"--{name} must be a .docx file: {value}")
    if not os.path.exists(source):
        raise FileNotFoundError(f"there is no {source}")
    if not os.path.isfile(source):
        raise ValueError(f"{source} is not a file")


def redact_file(spark: SparkSession, source: str, target: str) -> redaction.Redaction:
    with open(source, "rb") as f:
        data = f.read()
    found = docx.paragraphs(data)
    rows = [(0, p["block_seq"], p["path"], p["element_id"], p["runs"]) for p in found]
    table = spark.createDataFrame(rows, "doc_id long, block_seq int, path string, element_id string, runs array<string>")
    table = sources.once(table, "element_id").withColumn("text", sources.runs_text(F.col("runs"))).where(F.col("text").rlike(sources.BLANK))
    done = redaction.redact(table)
    edits = done.manifest.groupBy("block_seq").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("replacement_text").alias("replacement")))).alias("edits"))
    changed = table.join(edits, "block_seq").select("element_id", rewrite.rewrite_runs(sources.run_offsets(F.col("runs")), F.col("edits")).alias("runs"))
    docx.write(docx.rewritten(data, {r.element_id: r.runs for r in changed.collect()}), target)
    return done


def elements(spark: SparkSession, path: str) -> DataFrame:
    """file, block_seq, path, runs of a file that the driver sees."""
    with open(path, "rb") as f:
        rows = [(os.path.basename(path), p["block_seq"], p["path"], p["runs"]) for p in docx.paragraphs(f.read())]
    return spark.createDataFrame(rows, "file string, block_seq int, path string, runs array<string>")


def main(arguments: list[str] | None = None) -> int:
    given_all = sys.argv[1:] if arguments is None else arguments
    inspect = given_all[:1] == ["inspect"]
    parser = argparse.ArgumentParser(description="Redacts personal data in a Word document, or tells what it is made of (inspect).")
    parser.add_argument("--input")
    parser.add_argument("--output")
    parser.add_argument("--report")
    given = parser.parse_args(given_all[inspect:])
    try:
        check_arguments(given.input, given.output, not inspect)
        spark = SparkSession.builder.getOrCreate()
        if inspect:
            report = reports.inspection(elements(spark, given.input))
        else:
            done = redact_file(spark, given.input, given.output)
            name = F.lit(os.path.basename(given.input))  # both under one name, to be compared
            counts = audit.structure_check(*(audit.element_counts(elements(spark, p).withColumn("file", name)) for p in (given.input, given.output)))
            if counts.where("NOT same").count():
                raise RuntimeError(f"the structure of {given.output} is not that of {given.input}")
            report = reports.assurance(done.blocks, done.manifest, counts) if given.report else ""
        if given.report:
            with open(given.report, "w", encoding="utf-8") as f:
                f.write(report)
        elif inspect:
            print(report)
    except (ValueError, FileNotFoundError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
