"""Joins that hold no key in one task, and free column names."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import tables


@pytest.mark.parametrize("few", [0, 1000])
def test_joins_without_a_task_for_a_hot_key(spark, monkeypatch, few):
    monkeypatch.setattr(tables, "HOT_KEYS", 3)
    monkeypatch.setattr(tables, "SPLIT_FROM", few)
    many = spark.createDataFrame([(1 if i < 50 else i, i) for i in range(90)], "k long, slice long")
    one = spark.createDataFrame([(i, f"v{i}") for i in range(0, 100, 1)], "k long, v string")
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted((1 if i < 50 else i, i, f"v{1 if i < 50 else i}") for i in range(90))
    assert sorted(map(tuple, tables.join_split(many, one.join(counts, "k"), "k", "n", 90).select("k", "slice", "v").collect())) == want
    assert sorted(map(tuple, tables.sliced_join(many, one, "k", counts, 90, "slice").select("k", "slice", "v").collect())) == want
    odd = sorted(map(tuple, tables.sliced_join(many, one, "k", counts, 90, "slice", F.col("slice") % 2 == 1).select("k", "slice", "v").collect()))
    assert odd == [w for w in want if w[1] % 2]
    assert tables.free(many, "K", "slice", "x") == ["K_", "slice_", "x"]
