"""Tables between the rounds of an iteration, in a folder that all executors share.

They take disk only as long as they are needed: the shuffles that a table was made by go when it is written, and its
folder goes when no plan reads it any more. Large work is done part by part, so that just one part's shuffles are there.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A table of so many rows at most is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 50_000
#: Bytes of files that one part of large work reads, and that are staged before folders without readers are looked for.
PART_BYTES, RELEASE_BYTES = 512 << 20, 64 << 20
#: Spark's setting for shuffles that go with the query that made them.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Staged folders and what tells whether a plan still reads them, and the bytes staged since that was last asked.
_staged: list[tuple] = []
_bytes = 0


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is missing, under a temporary folder in local sessions and the warehouse in others."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        root = tempfile.gettempdir() if master == "local" or master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/attestry/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffles of the queries that run inside are deleted as each of them ends."""
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A staged folder, which goes when the last plan that reads it is gone, or else when the driver ends."""
    global _bytes
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    df = spark.read.schema(schema).parquet(path)
    location = df._jdf.queryExecution().analyzed().relation().location()  # every plan over the folder holds this object
    _staged.append((spark.sparkContext, path, spark._jvm.java.lang.ref.WeakReference(location)))
    _bytes += location.sizeInBytes()
    return df


def release(spark: SparkSession) -> None:
    """Deletes staged folders that no plan reads any more."""
    global _bytes
    _bytes = 0
    gc.collect()
    spark._jvm.System.gc()
    mine = [s for s in _staged if s[0] is spark.sparkContext]
    _staged[:] = [s for s in mine if s[2].get() is not None]
    for _, path, read in mine:
        if read.get() is None:
            where, files = _files(spark, path)
            files.delete(where, True)
            files.cancelDeleteOnExit(where)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to a folder that all executors share and read it back: a short lineage that outlives lost executors."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    if _bytes > RELEASE_BYTES:
        release(spark)
    with shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    return _read(spark, path, df.schema)


def small(df: DataFrame, name: str) -> DataFrame:
    """df, staged, and marked for broadcast if its size allows it."""
    kept = stage(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def n_parts(*tables: DataFrame) -> int:
    """In how many parts work on these tables is done, by the size of the files they are read from."""
    read = 0
    for df in tables:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        each = [leaves.apply(k) for k in range(leaves.size())]
        read += sum(int(str(x.stats().sizeInBytes())) for x in each if x.nodeName().startswith("LogicalRelation"))  # others don't know their size
    return max(1, -(-read // PART_BYTES))


def part_of(df: DataFrame, by: str, k: int, n: int) -> DataFrame:
    """The rows of part k of n, by a hash of a column; equal values are in one part."""
    return df if n == 1 else df.filter(F.pmod(F.xxhash64(by), F.lit(n)) == k)


def stage_parts(make: Callable[[int, int], DataFrame], n: int, name: str) -> DataFrame:
    """All of make(k, n), staged one after the other."""
    out = stage(make(0, n), name)
    for k in range(1, n):
        out = out.unionByName(stage(make(k, n), name))
    return out


def dealt(df: DataFrame, by: str, n: int, name: str) -> list[DataFrame]:
    """df in n tables by a hash of a column, staged in one go; each goes when it isn't read any more."""
    if n == 1:
        return [stage(df, name)]
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    release(spark)
    with shuffles_go(spark):
        df.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(n))).write.option("compression", "zstd").partitionBy("_deal").parquet(path)
    where, files = _files(spark, path)
    files.deleteOnExit(where)
    there = [files.exists(_files(spark, f"{path}/_deal={k}")[0]) for k in range(n)]
    return [_read(spark, f"{path}/_deal={k}", df.schema) for k in range(n) if there[k]] or [df.limit(0)]


def same_rows(a: DataFrame, b: DataFrame, key: str) -> bool:
    """Whether nothing has changed between two rounds: the same keys, each of which is there once."""
    return a.count() == b.count() and a.join(b.select(key), key, "left_anti").isEmpty()


def in_order(df: DataFrame, by: list, name: str, number: str = "seq") -> DataFrame:
    """df with each row's number, from 0, in the total order of `by`: one distributed sort, whatever the values are."""
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    kept = stage(dealt, name).withColumn("_part", F.shiftright("_at", 33))
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))  # one row per task
    bases = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n") - F.col("_least")).alias("_base"))
    return kept.join(F.broadcast(bases), "_part").withColumn(number, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
