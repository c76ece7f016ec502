"""Scores of predicted against true spans, and reports about what was found.

truth and predicted: block (any key column), entity_type, start, end. Matching is one to
one; where it depends on order (greedy overlap), the order is that of start, end and type.

Defined cases: empty tables give no rows (averages: zeros); spans that repeat are matched
each; a block that is null matches nothing; a block that only one side has counts as missed
or extra, so true spans of blocks without runs are all missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import spans_of

SPANS = "array<struct<entity_type:string,start:int,end:int>>"
#: Categories that are always reported.
ALWAYS = ("PERSON", "COMPANY", "LOCATION", "EMAIL", "PHONE")


def _numbered(spans: DataFrame) -> DataFrame:
    """Equal spans of a block are told apart by a number."""
    same = Window.partitionBy("block", "entity_type", "start", "end").orderBy("block")
    return spans.select("block", "entity_type", "start", "end", F.row_number().over(same).alias("nth"))


def strict(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """entity_type, tp, fp, fn: equal place and type."""
    keys = ["block", "entity_type", "start", "end", "nth"]
    both = _numbered(truth).withColumn("t", F.lit(1)).join(_numbered(predicted).withColumn("p", F.lit(1)), keys, "full_outer")
    return both.groupBy("entity_type").agg(
        F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("p").isNull()).alias("fn"),
    )


def by_block(spans: DataFrame, name: str) -> DataFrame:
    one = F.struct("start", "end", "entity_type")
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")))
    return spans.groupBy("block").agg(ordered.cast(SPANS).alias(name))


def _meets(a: Column, b: Column) -> Column:
    return (a["entity_type"] == b["entity_type"]) & (a["start"] < b["end"]) & (b["start"] < a["end"])


def without_overlaps(spans: Column) -> Column:
    """Of overlapping spans of one type the longest stays; equal lengths keep their order."""
    ranked = F.array_sort(F.transform(spans, lambda s, i: F.struct((s["start"] - s["end"]).alias("less"), i.alias("nth"), s.alias("s"))))
    return F.aggregate(ranked, F.array().cast(SPANS), lambda acc, r: F.when(F.exists(acc, lambda k: _meets(k, r["s"])), acc).otherwise(F.concat(acc, F.array(r["s"]))))


def greedy(truth: Column, predicted: Column) -> Column:
    """struct<hit, extra, missed>: each prediction takes an equal true span, else the first free one that it overlaps."""
    state = F.struct(truth.cast(SPANS).alias("free"), F.array().cast(SPANS).alias("hit"), F.array().cast(SPANS).alias("extra"))

    def take(fits):
        def step(acc: Column, p: Column) -> Column:
            at = F.filter(F.transform(acc["free"], lambda t, i: F.when(fits(t, p), i)), lambda i: i.isNotNull())
            found = F.size(at) > 0
            k = F.when(found, F.element_at(at, 1)).otherwise(-1)
            free = F.filter(acc["free"], lambda _, i: i != k)
            return F.struct(free.alias("free"), F.when(found, F.concat(acc["hit"], F.array(p))).otherwise(acc["hit"]).alias("hit"), F.when(found, acc["extra"]).otherwise(F.concat(acc["extra"], F.array(p))).alias("extra"))

        return step

    exact = F.aggregate(predicted, state, take(lambda t, p: (t["entity_type"] == p["entity_type"]) & (t["start"] == p["start"]) & (t["end"] == p["end"])))
    again = F.struct(exact["free"].alias("free"), exact["hit"].alias("hit"), F.array().cast(SPANS).alias("extra"))
    done = F.aggregate(exact["extra"], again, take(_meets))
    return F.struct(done["hit"].alias("hit"), done["extra"].alias("extra"), done["free"].alias("missed"))


def overlapping(truth: DataFrame, predicted: DataFrame, normalised: bool = False) -> DataFrame:
    """entity_type, tp, fp, fn: places that overlap; normalised: truth without overlaps of one type."""
    none = F.array().cast(SPANS)
    both = by_block(truth, "truth").join(by_block(predicted, "predicted"), "block", "full_outer").select(F.coalesce("truth", none).alias("truth"), F.coalesce("predicted", none).alias("predicted"))
    t = without_overlaps(F.col("truth")) if normalised else F.col("truth")
    m = both.select(greedy(t, F.col("predicted")).alias("m"))
    told = F.concat(*(_told(F.col(f"m.{n}"), w) for n, w in (("hit", "tp"), ("extra", "fp"), ("missed", "fn"))))
    rows = m.select(F.explode(told).alias("x")).select("x.entity_type", "x.w")
    return rows.groupBy("entity_type").agg(*(F.count_if(F.col("w") == w).alias(w) for w in ("tp", "fp", "fn")))


def _told(spans: Column, what: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["entity_type"].alias("entity_type"), F.lit(what).alias("w")))


def ratios(counts: DataFrame) -> DataFrame:
    """counts with precision, recall and f1; 0 where there is nothing to divide by."""
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    with_two = counts.withColumn("precision", p).withColumn("recall", r)
    return with_two.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def by_category(counts: DataFrame) -> DataFrame:
    """counts with a row for each category of ALWAYS, of zeros where nothing was counted."""
    spark = counts.sparkSession
    always = spark.createDataFrame([(c,) for c in ALWAYS], "entity_type string")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")]
    return counts.join(F.broadcast(always), "entity_type", "full_outer").select("entity_type", *zero)


def averages(counts: DataFrame) -> DataFrame:
    """kind (micro, macro), precision, recall, f1: from sums, and as means over categories that occur."""
    micro = ratios(counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")))).select(F.lit("micro").alias("kind"), "precision", "recall", "f1")
    active = ratios(counts.where("tp + fp + fn > 0"))
    macro = active.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1"))).select(F.lit("macro").alias("kind"), "precision", "recall", "f1")
    return micro.unionByName(macro)


def tokens(text: Column) -> Column:
    """array<struct<start, end, text>>: runs of non-space."""
    return spans_of(text, r"(?U)\S+")


def token_counts(blocks: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, tn, fp, fn over all tokens of blocks (block, text): a token is personal if a span overlaps it."""
    none = F.array().cast(SPANS)
    both = blocks.join(by_block(truth, "truth"), "block", "left").join(by_block(predicted, "predicted"), "block", "left")
    one = both.select(F.explode(tokens(F.col("text"))).alias("t"), F.coalesce("truth", none).alias("truth"), F.coalesce("predicted", none).alias("predicted"))
    touches = lambda spans: F.exists(spans, lambda s: (s["start"] < F.col("t.end")) & (F.col("t.start") < s["end"]))
    marked = one.select(touches(F.col("truth")).alias("a"), touches(F.col("predicted")).alias("b"))
    return marked.agg(F.count_if(F.col("a") & F.col("b")).alias("tp"), F.count_if(~F.col("a") & ~F.col("b")).alias("tn"), F.count_if(~F.col("a") & F.col("b")).alias("fp"), F.count_if(F.col("a") & ~F.col("b")).alias("fn"))


def snippet(text: Column, start: Column, end: Column, width: int = 30) -> Column:
    """The span with width characters around it on one line, dots where it was cut."""
    low, high = F.greatest(start - width, F.lit(0)), F.least(end + width, F.length(text))
    middle = F.regexp_replace(F.substring(text, low + 1, high - low), "\n", " ")
    return F.concat(F.when(low > 0, "...").otherwise(""), middle, F.when(high < F.length(text), "...").otherwise(""))


def examples(spans: DataFrame, n: int = 3) -> DataFrame:
    """The first n spans of each type, in document order."""
    order = Window.partitionBy("entity_type").orderBy("doc_id", "block_seq", "start", "end")
    return spans.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)


def containing_sources(candidates: Column, start: Column, end: Column) -> Column:
    """The sources, sorted, of raw candidates that lie inside a final span, joined by ' + '; 'unknown' if there are none."""
    inside = F.filter(candidates, lambda c: (c["start"] >= start) & (c["end"] <= end))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform(inside, lambda c: c["source"]))), " + ")
    return F.when(names == "", "unknown").otherwise(names)


def stage_counts(judged: DataFrame) -> DataFrame:
    """One row: raw, resolved, merged (raw less resolved), kept, rejected. judged: blocks with candidates, resolved and validated."""
    kept = lambda decision: F.size(F.filter("validated", lambda v: v["decision"] == decision))
    sums = judged.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("raw", F.size("candidates")), ("resolved", F.size("resolved")), ("kept", kept("KEEP")), ("rejected", kept("REJECT")))))
    return sums.select("raw", "resolved", (F.col("raw") - F.col("resolved")).alias("merged"), "kept", "rejected")


def kept_by(judged: DataFrame) -> DataFrame:
    """container, entity_type, n: validated spans that stay. judged: blocks with path and validated."""
    spans = judged.select(F.regexp_extract("path", r"^(\w+)", 1).alias("container"), F.explode("validated").alias("v")).where("v.decision = 'KEEP'")
    return spans.groupBy("container", "v.entity_type").agg(F.count(F.lit(1)).alias("n"))


def profile(detected: DataFrame) -> DataFrame:
    """source, raw: candidates by detector; detected: blocks with candidates."""
    return detected.select(F.explode("candidates").alias("c")).groupBy(F.col("c.source").alias("source"), F.col("c.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("raw"))
