"""Places of matches against Python's own."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions.spans import spans_of
from maskwright.operators import detect
from maskwright.sources import blocks


def _found(spark, texts, pattern):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", spans_of(F.col("t"), pattern).alias("s")).collect()
    return {r.i: [(s.start, s.end, s.text) for s in r.s] for r in rows}


def test_places_equal_finditer(spark):
    texts = ["", None, "a.b@c.de x", "é@x.org, y.z@q.org.", "𝄞 12.3.4.5 and 255.1.1.1", "1.1.1.1", "x" * 50 + "m@n.op"]
    for java, python in ((detect.EMAIL, detect.EMAIL[4:]), (detect.IPV4, detect.IPV4[4:])):
        got = _found(spark, texts, java)
        for i, t in enumerate(texts):
            assert got[i] == [(m.start(), m.end(), m[0]) for m in re.finditer(python, t or "")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1-. 𝄞é\n", max_size=20), min_size=20, max_size=40))
def test_places_of_random_texts(spark, texts):
    got = _found(spark, texts, r"(?U)\d+[-.]?\d*")
    for i, t in enumerate(texts):
        assert got[i] == [(m.start(), m.end(), m[0]) for m in re.finditer(r"\d+[-.]?\d*", t)]


def test_blocks(spark):
    rows = spark.createDataFrame([(1, "one\t two\n \nthree–four"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.block_seq, r.text) for r in blocks.blocks_of(rows, "doc_id", "text").orderBy("doc_id", "block_seq").collect()] == [(1, 0, "one  two"), (1, 2, "three four")]


def test_merged_cells_once(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a")], "doc_id long, block_seq int, element string")
    assert sorted(r.block_seq for r in blocks.once(rows, "element").collect()) == [0, 1]


def test_runs(spark):
    row = spark.createDataFrame([(["ab", "", "c d"],)], "r array<string>").select(blocks.runs_text(F.col("r")).alias("t"), blocks.run_offsets(F.col("r")).alias("o")).first()
    assert row.t == "abc d"
    assert [(o.idx, o.start, o.end) for o in row.o] == [(0, 0, 2), (1, 2, 2), (2, 2, 5)]
