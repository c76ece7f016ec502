"""Mixing sources to target weights, by blocks of words. DataFrame functions only.

The documents of a source stand one after the other, in pseudorandom order, and are cut
into blocks of BLOCK_WORDS words. A source's target is filled slot by slot. First the
number of its slots in each output shard is drawn: a multinomial draw, one uniform and
independent choice of a shard for each slot, of which only the counts are kept. Then the
shards take their counts of slots one after the other, and slot k takes block p(k) of an
epoch, where p is a pseudorandom bijection of the source's full blocks (multiply and shift
on the next power of two, walked until it falls inside); the short last block closes each
epoch; the last slot takes what is missing to the target. So the counts of a source per
shard are random and its sum is exact. Slots meet blocks by index in a join.

Targets: weights WEIGHTS repeat over the sources in code-point order, null last. They
share SHARE times all words; a target stops at MOST times its source, the excess goes to
the others by weight (solved exactly by ordering sources by size over weight).

Positions come from sums over (source, bucket) and then inside a bucket, so no task
orders a whole source; buckets grow with the table. Only block numbers, never texts, are
shuffled. Slots are made in many tasks, of SLOTS_OF_TASK each or more.

Defined cases: a null text has no words and is never taken; a null source is a source;
rows that share a doc_id are documents of their own (equal in order and size, they are
interchangeable); null doc_ids come first; texts of any length are measured whole; an
empty table has no documents and no slots; with no words at all, targets are 0; other
columns, whatever they are called, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

# The mix that is asked for.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2

BLOCK_WORDS = 512
SHARD_WORDS = 1 << 22
#: Buckets at least, and documents of a bucket on average at most.
BUCKETS, BUCKET_ROWS = 4096, 1 << 16
#: Slots that one row stands for before they are made, and that a task makes at least.
CHUNK, SLOTS_OF_TASK = 1 << 12, 1 << 14
#: Sources up to this number are broadcast; beyond, they are joined like any table.
FEW_SOURCES = 20_000

# Odd factors below 2**22, so that a product with a 40-bit index fits a long.
_FACTORS = (2654435, 3266489, 1103515)
_WALK = 64


def permuted(index: str, n: str, rank: str, epoch: str, duck: bool = False) -> str:
    """SQL for a bijection of 0..n-1, one for each (rank, epoch); as Spark or DuckDB reads it."""

    def round_of(x: str) -> str:
        for r, m in enumerate(_FACTORS):
            x = f"((({x}) * {m} + ({rank} * 7919 + {epoch} * 104729 + {(r + 1) * 15485863}) % 1048576) & {mask})"
            shifted = f"({x} >> {half})" if duck else f"shiftright({x}, {half})"
            x = f"xor({x}, {shifted})" if duck else f"({x} ^ {shifted})"
        return x

    bits = f"length(bin({n} - 1))"
    if duck:
        mask, half = f"((1::BIGINT << {bits}) - 1)", f"(({bits} + 1) // 2)"
        step = f"CASE WHEN y < {n} THEN y ELSE {round_of('y')} END"
        return f"list_reduce(range(0, {_WALK}), lambda y, i: {step}, {round_of(index)})"
    mask, half = f"(shiftleft(1L, {bits}) - 1)", f"CAST(({bits} + 1) div 2 AS INT)"
    walk = f"aggregate(sequence(1, {_WALK}), {round_of(index)}, (y, i) -> CASE WHEN y < {n} THEN y ELSE {round_of('y')} END)"
    return f"CASE WHEN {round_of(index)} < {n} THEN {round_of(index)} ELSE {walk} END"  # most need no walk


def sizes(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, size, digest (32 bits of a hash of doc_id); written once."""
    words = F.regexp_count(F.coalesce(docs[text].cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    digest = F.conv(F.substring(F.md5(F.coalesce(docs[key].cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return stored(docs.select(docs[key].cast("long").alias("doc_id"), docs[source].cast("string").alias("source"), words.alias("size"), digest.alias("digest")), "sizes")


def targets(sized: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """For each source: rank, source_size, weight, target, its number of full blocks and what the last one holds."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("source").isNull(), F.col("source"))
    ranked = by_source.withColumn("rank", F.row_number().over(order).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
    rising = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "rank")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    full = (F.col("wanted") - before) * F.col("weight") >= F.col("cap") * onward
    marked = ranked.withColumn("full", full)
    rest = (F.col("wanted") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest)
    return marked.select("source", "rank", "source_size", "weight", target.alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW_SOURCES else df


@dataclass
class Mix:
    """counts: rank, shard, n (slots). slots: rank, shard, slot, epoch, block, words. documents: one row for each, with taken."""

    counts: DataFrame
    slots: DataFrame
    documents: DataFrame


def _spread(df: DataFrame, n_slots: int) -> DataFrame:
    """Rows that stand for n_slots slots together, dealt out so that many tasks make them. Not by a key, and with a number, so Spark neither gathers nor merges them."""
    most = max(200, 16 * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(1, min(most, -(-n_slots // SLOTS_OF_TASK))))


def draw_counts(plan: DataFrame, n_slots: int, n_shards: int) -> DataFrame:
    """rank, shard, n: how many of its slots a source has in each shard; written once. plan: rank, n_slots."""
    chunks = plan.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {CHUNK})")))
    draws = _spread(chunks, n_slots).select("rank", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least((chunk + 1) * {CHUNK}, n_slots) - 1)")).alias("draw"))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "rank", "draw"), F.lit(n_shards))
    return stored(draws.groupBy("rank", shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")), "shards", merged=True)


def mix(sized: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> Mix:
    sources = stored(sources, "sources")
    n_sources = sources.count()
    buckets = max(BUCKETS, 1 << (sized.count() // BUCKET_ROWS).bit_length())

    # how many slots: whole epochs, then blocks up to what is missing
    plan = sources.withColumn("words", F.floor("target").cast("long")).withColumn("n_full", F.expr(f"source_size div {block_words}")).withColumn("short", F.expr(f"source_size % {block_words}"))
    plan = plan.where("words > 0").withColumn("n_blocks", F.expr("n_full + CAST(short > 0 AS INT)")).withColumn("epochs", F.expr("words div source_size")).withColumn("left_over", F.expr("words % source_size"))
    plan = plan.withColumn("n_slots", F.expr(f"epochs * n_blocks + (left_over + {block_words} - 1) div {block_words}"))
    plan = plan.select("rank", "n_full", "short", "n_blocks", "epochs", "left_over", "words", "n_slots")
    total = plan.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n_slots")).first()
    n_slots = int(total.n_slots)
    counts = draw_counts(plan.select("rank", "n_slots"), n_slots, max(1, -(-int(total.words) // shard_words)))

    # shards take their counts one after the other; a row of many slots is cut first
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    laid_out = counts.withColumn("begin", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    pieces = laid_out.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (n - 1) div {CHUNK})")))
    slots = _spread(pieces, n_slots).select("rank", "shard", F.explode(F.expr(f"sequence(begin + chunk * {CHUNK}, begin + least((chunk + 1) * {CHUNK}, n) - 1)")).alias("slot"))
    slots = slots.join(_small(plan.drop("words", "n_slots"), n_sources), "rank")
    slots = slots.withColumn("epoch", F.expr("slot div n_blocks")).withColumn("place", F.expr("slot % n_blocks"))
    slots = slots.withColumn("block", F.expr(f"CASE WHEN place < n_full THEN {permuted('place', 'n_full', 'rank', 'epoch')} ELSE n_full END"))
    most = F.expr(f"CASE WHEN place < n_full THEN {block_words}L ELSE short END")
    slots = slots.withColumn("words", F.when(F.col("epoch") < F.col("epochs"), most).otherwise(F.least(most, F.col("left_over") - F.col("place") * block_words)))
    slots = slots.select("rank", "shard", "slot", "epoch", "block", "words")

    # where each document begins in its source
    named = sized.withColumnRenamed("source", "s")
    known = named.join(_small(sources, n_sources), F.col("s").eqNullSafe(F.col("source"))).select("doc_id", "source", "rank", "source_size", "target", "size", (F.col("digest") % buckets).alias("bucket"))
    in_bucket = Window.partitionBy("rank", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size")
    per_bucket = known.groupBy("rank", "bucket").agg(F.sum("size").alias("words"))
    up_to = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_bucket.select("rank", "bucket", F.coalesce(F.sum("words").over(up_to), F.lit(0)).alias("begin"))
    laid = known.withColumn("nth", F.row_number().over(in_bucket)).withColumn("inside", F.coalesce(F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    laid = laid.join(begins, ["rank", "bucket"]).withColumn("at", F.col("begin") + F.col("inside"))

    # blocks of each document, met by the slots of the same block
    span = F.expr(f"CASE WHEN size > 0 THEN sequence(at div {block_words}, (at + size - 1) div {block_words}) END")
    pieces = laid.withColumn("block", F.explode_outer(span))
    pieces = pieces.withColumn("from", F.expr(f"greatest(at - block * {block_words}, 0L)")).withColumn("to", F.expr(f"least(at + size - block * {block_words}, {block_words}L)"))
    # generated rows are many more than their source table lets Spark expect: never broadcast them
    met = pieces.join(slots.groupBy("rank", "block").agg(F.collect_list("words").alias("takes")).hint("merge"), ["rank", "block"], "left")
    taken = F.expr("aggregate(coalesce(takes, array()), 0L, (t, w) -> t + greatest(least(`to`, w) - `from`, 0L))")
    documents = met.groupBy("rank", "bucket", "nth", "doc_id", "source", "size", "source_size", "target").agg(F.sum(taken).alias("taken"))
    return Mix(counts, slots, documents)


def mix_documents(docs: DataFrame, **names: str) -> Mix:
    """Sizes, targets and the mix of a table with doc_id, text and source."""
    sized = sizes(docs, **names)
    return mix(sized, targets(sized))


def oracle() -> str:
    """The same numbers from DuckDB: doc_id, size, source_size, target, taken."""
    b = BLOCK_WORDS
    pick = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {BUCKETS} AS bucket
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM totals),
weighed AS (SELECT *, CASE (rank - 1) % {len(WEIGHTS)} {pick} END AS weight, {MOST} * source_size AS cap,
                   sum(source_size) OVER () * {SHARE}::DOUBLE AS wanted FROM ranked),
marked AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
                     >= cap * sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS full_up FROM weighed),
aimed AS (SELECT source, rank::BIGINT AS rank, source_size,
                 CASE WHEN full_up THEN cap::DOUBLE
                      ELSE weight * ((wanted - coalesce(sum(CASE WHEN full_up THEN cap END) OVER (), 0)::DOUBLE) / sum(CASE WHEN NOT full_up THEN weight END) OVER ()) END AS target
          FROM marked),
planned AS (SELECT *, floor(target)::BIGINT AS goal, source_size // {b} AS n_full, source_size % {b} AS short,
                   source_size // {b} + (source_size % {b} > 0)::INT AS n_blocks FROM aimed WHERE floor(target) > 0),
counted AS (SELECT *, goal // source_size AS epochs, goal % source_size AS left_over,
                   (goal // source_size) * n_blocks + (goal % source_size + {b} - 1) // {b} AS n_slots FROM planned),
slots AS (SELECT *, slot // n_blocks AS epoch, slot % n_blocks AS place FROM (SELECT *, unnest(range(0, n_slots)) AS slot FROM counted)),
placed AS (SELECT rank, CASE WHEN place < n_full THEN {permuted('place', 'n_full', 'rank', 'epoch', duck=True)} ELSE n_full END AS block,
                  CASE WHEN epoch < epochs THEN CASE WHEN place < n_full THEN {b} ELSE short END
                       ELSE least(CASE WHEN place < n_full THEN {b} ELSE short END, left_over - place * {b}) END AS words FROM slots),
laid AS (SELECT s.doc_id, s.size, s.bucket, a.rank, a.source_size, a.target,
                coalesce(sum(s.size) OVER (PARTITION BY a.rank ORDER BY s.bucket, s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
                row_number() OVER (PARTITION BY a.rank ORDER BY s.bucket, s.doc_id NULLS FIRST, s.size) AS nth
         FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
pieces AS (SELECT *, greatest(pos - block * {b}, 0) AS lo, least(pos + size - block * {b}, {b}) AS hi
           FROM (SELECT *, unnest(range(pos // {b}, (pos + size - 1) // {b} + 1)) AS block FROM laid WHERE size > 0)),
took AS (SELECT p.rank, p.nth, sum(greatest(least(p.hi, w.words) - p.lo, 0))::BIGINT AS taken FROM pieces p JOIN placed w USING (rank, block) GROUP BY 1, 2)
SELECT l.doc_id, l.size, l.source_size, l.target, coalesce(t.taken, 0)::BIGINT AS taken FROM laid l LEFT JOIN took t USING (rank, nth)
"""
