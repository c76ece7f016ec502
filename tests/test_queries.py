"""Registered queries against their SQL, and the registry without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from maskwright.plans import oracles, queries

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def _rows(frame):
    names = sorted(frame.columns)
    plain = frame[names].astype(object)
    return names, sorted(map(repr, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


def test_every_query_has_sql():
    assert queries.QUERIES.keys() == oracles.ORACLES.keys()


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        db.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}')")
    assert _rows(queries.QUERIES[name](spark, str(DATA)).toPandas()) == _rows(db.sql(oracles.ORACLES[name]).df())


def test_registry_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    say = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n[:2] == 'op' or n == 'pipeline'] and e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", say], cwd=tmp_path / "copy", env=os.environ | {"PYTHONPATH": "."}, check=True)


def test_detection_on_a_stream(spark, tmp_path):
    from maskwright.streaming import detection

    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "mail a.b@x.org\nnothing"), (2, "host 10.0.0.1")], schema).write.parquet(str(tmp_path / "in"))
    found = detection.validated_stream(detection.documents_stream(spark, str(tmp_path / "in"), schema))
    query = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.doc_id, r.entity_type, r.text) for r in spark.table("found").collect()) == [(1, "EMAIL", "a.b@x.org"), (2, "IP_ADDRESS", "10.0.0.1")]
    out = []
    batches = detection.documents_stream(spark, str(tmp_path / "in"), schema).writeStream.foreachBatch(detection.redact_batches(lambda b, m: out.append(m.count()))).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    batches.awaitTermination(120)
    assert out == [2]
