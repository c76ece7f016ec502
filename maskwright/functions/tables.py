"""Tables written between the steps of a plan, column names that are free, and joins that hold no key in one task."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that join_split and sliced_join treat on their own: at most so many rows are broadcast.
HOT_KEYS = 10_000
#: Up to so many rows they join plainly: no task can get more.
SPLIT_FROM = 1_000_000


_TRIM = """try {
  java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(new javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", null, null);
} catch (Exception e) { /* a JVM without this command */ }"""
_scripts: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see; one of our own where it is unset and all run here."""
    context = spark.sparkContext
    said = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="maskwright-"))
    return context.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One whose files Spark reads in fewer tasks than there are cores (small, or of one row group) is dealt out first."""
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stored(df: DataFrame, what: str = "step", merged: bool = False) -> DataFrame:
    """df written as Parquet and read again: used several times, computed once, and cheap to read again after a lost executor.

    merged: at most four files for each core; for narrow tables that come out of a shuffle,
    whose partitions are small. The files go when the driver's Python ends, or with discard().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwright-{what}-{uuid.uuid4().hex}"
    (df.coalesce(4 * spark.sparkContext.defaultParallelism) if merged else df).write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote; for tables from which everything has been derived and written."""
    _remove(df.sparkSession, df._stored_at)


def release(spark: SparkSession) -> None:
    """Lets go of broadcasts and shuffle files that nothing refers to any more, and of free memory.

    Spark's cleaner learns of them when the driver's JVM collects garbage, which on a driver
    with little to do may be half an hour apart; between the steps of a long plan it is worth
    asking for. JVMs that can are also asked to give their free C heap back.
    """
    gc.collect()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    if "trim" not in _scripts or _scripts["trim"][0] is not jvm:
        # the bean's class is not open to calls from here, compiled code may use its interface
        script = jvm.org.codehaus.janino.ScriptEvaluator()
        script.cook(_TRIM)
        _scripts["trim"] = (jvm, script)
    _scripts["trim"][1].evaluate(None)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from all columns of df (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_split(left: DataFrame, right: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """Inner join with a table of one row for each key, of columns of fixed size, whose column n counts the key's rows in left.

    Of keys with more than total / HOT_KEYS rows there are fewer than HOT_KEYS: they are
    broadcast. The others meet in a shuffle, where none of them has more rows than that.
    """
    if total <= SPLIT_FROM:
        return left.join(right, on)
    limit = max(1, total // HOT_KEYS)
    hot, cold = right.where(F.col(n) > limit), right.where(F.col(n) <= limit)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def sliced_join(many: DataFrame, one: DataFrame, on: str, counts: DataFrame, total: int, by: str, condition=None) -> DataFrame:
    """Inner join of many rows with one row for each key, of columns of any size. counts: the key and n, its rows in many.

    Keys with more than total / HOT_KEYS rows (fewer than HOT_KEYS of them) are cut into
    slices by a hash of column `by`, and their row of `one` goes to each slice. condition:
    tested inside the join, so rows that fail it are never made.
    """
    if total <= SPLIT_FROM:
        if condition is None:
            return many.join(one, on)
        there = one.select(F.col(on).alias("on_there"), *(c for c in one.columns if c != on))
        return many.join(there.hint("merge"), (F.col(on) == F.col("on_there")) & condition).drop("on_there")
    limit = max(1, total // HOT_KEYS)
    part, slices = free(many, "slice", "slices")
    hot = F.broadcast(counts.where(F.col("n") > limit).select(F.col(on), F.ceil(F.col("n") / limit).cast("int").alias(slices)))
    cut = many.join(hot, on, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(by), F.col(slices)), F.lit(0)).cast("int")).drop(slices)
    dealt = one.join(hot, on, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(slices), F.lit(1)) - 1))).drop(slices)
    on_all = [on, part]
    if condition is None:
        return cut.join(dealt.hint("merge"), on_all).drop(part)
    there = dealt.select(F.col(on).alias("on_there"), F.col(part).alias("part_there"), *(c for c in dealt.columns if c not in on_all))
    return cut.join(there.hint("merge"), (F.col(on) == F.col("on_there")) & (F.col(part) == F.col("part_there")) & condition).drop(part, "on_there", "part_there")
