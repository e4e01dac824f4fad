"""Tables that all executors can read, and reading the given ones."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Broadcast keys only up to so many (8 bytes each).
BROADCAST_KEYS = 300_000
#: A value with more than one row in so many is hot; fewer values than this can be.
HOT_SHARE = 50_000
#: Bits of a row's number that count within its file.
ROW_BITS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text): whole rows as one column, so that no name of theirs can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a temporary folder and any other session the warehouse folder,
    which all executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        named = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/attestry-stages"


def spool_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors.

    The folder goes when the driver ends.
    """
    spark, path = df.sparkSession, spool_path(df.sparkSession, name)
    df.write.parquet(path)
    discard_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a spooled folder that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for one block; keys are written with __ for a dot."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of bounded size out of driver values, written as a file: no Python rows go to tasks, and plans stay small."""
    made = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
    return spool(made, "literal")


def is_file_scan(df: DataFrame) -> bool:
    """Whether df is columns and filters of Parquet files, each read once, and nothing else: then file and place tell its rows apart.

    Other formats have no places, and rows of a file that is listed twice would share theirs.
    """
    plan = df._jdf.queryExecution().analyzed()
    lines = plan.toString().splitlines()
    steps = [re.search(r"[A-Z]\w*", line) for line in lines]
    if not all(s and s[0] in ("Project", "Filter", "Relation", "SubqueryAlias") for s in steps) or not lines[-1].endswith("] parquet"):
        return False
    listed = plan.collectLeaves().head().relation().location().inputFiles()
    return len(listed) == len(df._jdf.inputFiles())


def located(docs: DataFrame, id_col: str, text_col: str, row: bool = False) -> DataFrame:
    """(doc_id, text, file, place) of each row: file and place say where the content stands. row adds the whole row.

    Rows that do not come straight from files are written to some first.
    """
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * row
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept]
    if not is_file_scan(docs):
        docs, columns = spool(docs.select(*columns), "content"), ["doc_id", "text", *["row"] * row]
    at = docs.metadataColumn("_metadata")
    return docs.select(*columns, at.getField("file_path").alias("file"), at.getField("row_index").alias("place"))


def numbered(docs: DataFrame, id_col: str, text_col: str, row: bool = False) -> DataFrame:
    """(key, doc_id, text) of each row. key is its file's number and its place therein: unique, and the same in every reading."""
    rows = located(docs, id_col, text_col, row)
    files = rows.select("file").distinct().select("file", F.row_number().over(W.orderBy("file")).cast("long").alias("number"))  # as many rows as files
    names = spool(files, "files")
    few = names.count() <= BROADCAST_KEYS
    key = F.shiftleft("number", ROW_BITS) + F.col("place")
    return rows.join(F.broadcast(names) if few else names, "file").select(key.alias("key"), "doc_id", "text", *["row"] * row)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose key is not among dropped; rows are not shuffled where few are dropped."""
    gone = spool(dropped.select("key"), "dropped")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, "key", "left_anti")


def join_split(rows: DataFrame, table: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with a table that has one row per key; size is its column with how many of the total rows have the key.

    Hot keys, of which there are fewer than HOT_SHARE, meet their rows by broadcast; the others are shuffled.
    """
    most = max(1, total // HOT_SHARE)
    hot = spool(table.filter(F.col(size) > most), "hot")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.filter(F.col(size) <= most), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows (read from written files) with their rank from 0 within the group, by order.

    One total order, dealt by range: a hot group is spread over tasks. Rows that tie in all of order are told apart by
    their place in the files.
    """
    at = rows.metadataColumn("_metadata")
    by = [group, *order, "_file", "_place"]
    placed = rows.select("*", at.getField("file_path").alias("_file"), at.getField("row_index").alias("_place"))
    dealt = spool(placed.repartitionByRange(*by).sortWithinPartitions(*by).drop("_file", "_place").withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33).alias("_part")
    cells = dealt.groupBy(group, part).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # as many rows as groups and tasks
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n") - F.col("_first")
    bases = spool(cells.select(group, "_part", before.alias("_base")), "bases")
    out = dealt.withColumn("_part", part).join(F.broadcast(bases), [group, "_part"])
    return out.withColumn("rank", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
