"""Exact deduplication with a keyed streaming state (DataFrame operations only).

Fingerprints of the rows are fed to a stream whose stateful aggregation lives on disk (RocksDB) and never expires. Per
digest it retains the row to keep: its length (its rank), its stable identifier, and the locator of its content (file
and place therein); and how many rows were seen. A caller who names a state folder goes on from there with the next
call, also after a restart; a feed is named too, and one that was fed already is not counted again.

Digests that were hit more than once are checked on full bytes. Contents are read by their locators: those of this
call's rows (by their digest where more than BROADCAST_ROWS rows were hit, which spares a shuffle of all texts), and
those of rows to keep from earlier calls. Equal contents fold before they are shuffled, so each task sends a digest's
bytes once. Should two different texts ever share a digest, this call's groups with that digest are formed again on the
texts themselves.

Without a state folder, what a call writes goes when the driver ends, and its state at once. In a state folder the log
of changed keys is merged at the start of a call when it has more than MOST_BATCHES parts.

Defined results: a null text counts as empty, so null, empty and all-space texts form one group. Rows with a null id
sort after all others when lengths tie. Repeated rows (same id and text) count each for themselves in group_size, and
each repetition of the kept id is marked kept. With a state folder, answers are the state after this call: the row to
keep may be an earlier one. An empty table gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, discard_at_end, is_file_scan, join_split, located, settings, spool, spool_path

#: Deleted before texts are compared: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: Broadcast the digests that were hit only up to so many rows (about 100 bytes each).
BROADCAST_ROWS = 100_000
#: Parts of a state folder's log of changed keys above which it is merged.
MOST_BATCHES = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FED = "doc_id long, n_points long, digest string, file string, place long"
KEEPER = "struct<n_points: bigint, named: boolean, neg_id: bigint, file: string, neg_place: bigint>"


def normalised(text: Column) -> Column:
    """The text without white space; one replace per character is much cheaper than a regular expression."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def fingerprints(rows: DataFrame) -> DataFrame:
    """(doc_id, n_points, digest, file, place) of located rows."""
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", F.char_length(text).cast("long").alias("n_points"), digest_of(F.col("text")).alias("digest"), "file", "place")


def _keeper() -> Column:
    """Most code points first, then the smallest id, then the first place."""
    return F.max(F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("named"), (-F.col("doc_id")).alias("neg_id"), F.col("file"), (-F.col("place")).alias("neg_place")))


def keyed_state(spark: SparkSession, fed: str, state_dir: str, files_per_batch: int) -> DataFrame:
    """Run the stream of fed fingerprints to its end; the present state: (digest, keeper, group_size).

    Each micro-batch writes the keys whose state it changed, in a folder of its own, so a repeated batch overwrites
    itself. group_size only grows, so the row with the largest one is a key's present state.
    """
    changed = f"{state_dir}/changed"
    merge_changes(spark, changed)
    stream = spark.readStream.schema(FED).option("maxFilesPerTrigger", files_per_batch).parquet(fed)
    state = stream.groupBy("digest").agg(_keeper().alias("keeper"), F.count("*").alias("group_size"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changed}/batch={batch_id}")

    run = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    return present_state(spark, [f"{changed}/batch=*"])


def present_state(spark: SparkSession, parts: list[str]) -> DataFrame:
    rows = spark.read.schema(f"digest string, keeper {KEEPER}, group_size bigint").parquet(*parts)
    return rows.groupBy("digest").agg(F.max(F.struct("group_size", "keeper")).alias("last")).select("digest", "last.keeper", "last.group_size")


def merge_changes(spark: SparkSession, changed: str) -> None:
    """Write a long log's present state as one part and delete the parts it was made of.

    A crash between the two, or a batch that is repeated later, only leaves states twice or older ones, of which the
    largest group_size counts.
    """
    if not _exists(spark, changed):
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(changed)
    parts = [s.getPath().toString() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    if len(parts) > MOST_BATCHES:
        present_state(spark, parts).write.parquet(f"{changed}/batch=merged-{uuid.uuid4().hex}")
        for part in parts:
            discard(spark, part)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _marked(rows: DataFrame, text_col: str, state_dir: str | None, run: str | None, files_per_batch: int) -> DataFrame:
    """Located rows (doc_id, text, file, place) with keep_id, group_size, digest, and mine: whether this very row is the one to keep."""
    spark = rows.sparkSession
    lasting, state_dir = state_dir is not None, state_dir or spool_path(spark, "dedup")
    fed = f"{state_dir}/fed/run={run or uuid.uuid4().hex}"
    if not _exists(spark, f"{fed}/_SUCCESS"):
        fingerprints(rows).write.mode("overwrite").parquet(fed)
    slim = spark.read.schema(FED).parquet(fed)
    total = slim.count()
    if not total:
        return slim.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest", F.lit(True).alias("mine"), "file", "place")
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true", spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB="256", spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false"):
        state = keyed_state(spark, f"{state_dir}/fed", state_dir, files_per_batch)
        hits = spool(state.filter("group_size > 1"), "hits")
        n_hits = hits.count()
    if not lasting:
        discard_at_end(spark, state_dir)
        for part in ("changed", "checkpoint"):
            discard(spark, f"{state_dir}/{part}")
    few = n_hits <= BROADCAST_ROWS
    flat = hits.select("digest", "group_size", (-F.col("keeper.neg_id")).alias("keep_id"), F.col("keeper.file").alias("keep_file"), (-F.col("keeper.neg_place")).alias("keep_place"))
    if few:
        joined = slim.join(F.broadcast(flat), "digest", "left")
    else:
        here = flat.join(slim.groupBy("digest").agg(F.count("*").alias("here")), "digest")
        joined = join_split(slim, here, "digest", "here", total, "left")
    alone = F.col("group_size").isNull()
    mine = alone | ((F.col("file") == F.col("keep_file")) & (F.col("place") == F.col("keep_place")))
    joined = joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest", mine.alias("mine"), "file", "place")
    differ = spool(_different(rows, slim, flat, few, text_col), "differ") if n_hits else None
    if differ is None or differ.isEmpty():
        return joined
    return joined.join(differ, "digest", "left_anti").unionByName(by_text(rows, differ))


def _different(rows: DataFrame, slim: DataFrame, hits: DataFrame, few: bool, text_col: str) -> DataFrame:
    """Digests among the hits whose contents are not all the same bytes. Rows to keep from earlier calls are read too."""
    spark = rows.sparkSession
    digests = hits.select("digest")
    places = spool(slim.join(F.broadcast(digests) if few else digests, "digest", "left_semi").select("file", "place", "digest"), "places")
    if places.count() <= BROADCAST_ROWS:
        contents = rows.join(F.broadcast(places), ["file", "place"]).select("digest", normalised(F.col("text")).alias("bytes"))
    else:
        contents = rows.select(digest_of(F.col("text")).alias("digest"), normalised(F.col("text")).alias("bytes"))
        contents = contents.join(F.broadcast(digests) if few else digests, "digest", "left_semi")
    here = rows.select("file").distinct()
    earlier = spool(hits.join(here, hits["keep_file"] == here["file"], "left_anti").select("digest", F.col("keep_file").alias("file"), F.col("keep_place").alias("place")), "earlier")
    files = [r.file for r in earlier.select("file").distinct().collect()]  # as many as earlier files
    if files:
        old = spark.read.parquet(*files)
        at = old.metadataColumn("_metadata")
        name = text_col if text_col in old.columns else "text"
        old = old.select(normalised(F.col(name)).alias("bytes"), at.getField("file_path").alias("file"), at.getField("row_index").alias("place"))
        contents = contents.unionByName(old.join(earlier, ["file", "place"]).select("digest", "bytes"))
    return contents.distinct().groupBy("digest").count().filter("count > 1").select("digest")


def by_text(rows: DataFrame, digests: DataFrame) -> DataFrame:
    """Groups on the texts themselves, for digests that different texts share."""
    each = fingerprints(rows).join(digests, "digest", "left_semi").select("doc_id", "n_points", "digest", "file", "place")
    each = each.join(rows.select("file", "place", normalised(F.col("text")).alias("bytes")), ["file", "place"])
    groups = each.groupBy("bytes").agg(_keeper().alias("keeper"), F.count("*").alias("group_size"))
    mine = (F.col("file") == F.col("keeper.file")) & (F.col("place") == -F.col("keeper.neg_place"))
    return each.join(groups, "bytes").select("doc_id", (-F.col("keeper.neg_id")).alias("keep_id"), "group_size", "digest", mine.alias("mine"), "file", "place")


def _lasting(docs: DataFrame, id_col: str, text_col: str, state_dir: str | None, row: bool = False) -> DataFrame:
    """Located rows; with a state folder, contents that do not come from files are written there and stay."""
    if state_dir is None or is_file_scan(docs):
        return located(docs, id_col, text_col, row)
    path = f"{state_dir}/content/{uuid.uuid4().hex}"
    docs.write.parquet(path)
    return located(docs.sparkSession.read.schema(docs.schema).parquet(path), id_col, text_col, row)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, run: str | None = None, files_per_batch: int = 256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    state_dir: a folder whose state goes on from call to call; run: this feed's name, under which a call can be repeated.
    The files that docs are read from must then stay, since the state points into them.
    """
    marked = _marked(_lasting(docs, id_col, text_col, state_dir), text_col, state_dir, run, files_per_batch)
    return marked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state_dir: str | None = None, run: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each group. They are known by their locators, so only these move."""
    rows = _lasting(docs, id_col, text_col, state_dir, row=True)
    gone = spool(_marked(rows, text_col, state_dir, run, 256).filter(~F.col("mine")).select("file", "place"), "copies")
    few = gone.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(gone) if few else gone, ["file", "place"], "left_anti").select("row.*")
