"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (DataFrame operations only).

Each shard owns many points of a ring of 2**32 places; a row belongs to the first point at or after its key's hash.
A shard takes rows up to its capacity; rows beyond that go on clockwise to the next shard with room. Capacities differ
by at most one row and add up to the number of rows, so shard sizes do too. Only counts of rows per arc of the ring
reach the driver: their number is fixed by the ring's parameters and not by the data. Within an arc rows are ranked by
place, id, CRC and size in one distributed sort, so an arc that holds many rows (one id, say) is spread over tasks.

Defined results: a null text has size 16 and CRC 0; a null id is placed by its text's CRC. Rows that tie in all four
are interchangeable: each gets a slot of its own, and the same rows come out in every run. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import literal_table, ranked, spool

#: Bytes that each row takes besides its text.
ROW_BYTES = 16
#: The ring is also cut at this many even places, so that a row finds its arc by an equality join.
GRID = 4096


def ring_hash(*cols: Column) -> Column:
    return F.xxhash64(*cols).bitwiseAND(0xFFFFFFFF)


def ring_arcs(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int, int]]:
    """(first place, last place, shard) of each arc, in ring order; arcs end at points and at grid lines."""
    points = spark.range(shards * vnodes).select((F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).cast("int").alias("v"))
    points = sorted((r.place, r.shard) for r in points.select("shard", ring_hash(F.lit("point"), "shard", "v").alias("place")).collect())
    places = [p for p, _ in points]
    step = (1 << 32) // GRID
    ends = sorted({*places, *range(step - 1, 1 << 32, step)})
    arcs, first = [], 0
    for last in ends:
        k = bisect_left(places, first)
        arcs.append((first, last, points[k % len(points)][1]))
        first = last + 1
    return arcs


def fill_clockwise(cells: list[tuple[int, int]], arcs: list[tuple[int, int, int]], shards: int) -> list[dict]:
    """Runs of ranks per cell (arc, rows): which shard takes them and the slot of the run's first row.

    First every arc's rows go to its own shard while that has room, in ring order; what is left goes on clockwise.
    """
    total = sum(n for _, n in cells)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, runs, left = [0] * shards, [], []

    def take(arc: int, rank: int, n: int, shard: int) -> int:
        k = min(n, room[shard])
        if k:
            runs.append({"arc": arc, "lo": rank, "hi": rank + k, "shard": shard, "base": used[shard]})
            room[shard] -= k
            used[shard] += k
        return k

    for arc, n in sorted(cells):
        k = take(arc, 0, n, arcs[arc][2])
        if k < n:
            left.append((arc, k, n - k))
    for arc, rank, n in left:
        at = arc
        while n:
            at = (at + 1) % len(arcs)
            k = take(arc, rank, n, arcs[at][2])
            rank, n = rank + k, n - k
    return runs


def assign_shards(docs: DataFrame, shards: int = 40, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, home_shard."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("place", ring_hash(F.coalesce("doc_id", "text_crc32")))
    arcs = ring_arcs(spark, shards, vnodes)
    by_arc = F.broadcast(literal_table(spark, [{"grid": lo // ((1 << 32) // GRID), "lo": lo, "hi": hi, "arc": k, "home_shard": s} for k, (lo, hi, s) in enumerate(arcs)], "grid bigint, lo bigint, hi bigint, arc int, home_shard int"))
    placed = rows.withColumn("grid", F.shiftright("place", 32 - GRID.bit_length() + 1)).join(by_arc, "grid").filter("place between lo and hi")
    placed = spool(placed.select("doc_id", "size", "text_crc32", "place", "arc", "home_shard"), "shards")
    cells = [(r.arc, r["count"]) for r in placed.groupBy("arc").count().collect()]  # as many as the ring has arcs
    runs = F.broadcast(literal_table(spark, fill_clockwise(cells, arcs, shards), "arc int, lo bigint, hi bigint, shard int, base bigint"))
    taken = ranked(placed, "arc", ["place", "doc_id", "text_crc32", "size"], "ring").join(runs, "arc").filter("rank >= lo and rank < hi")
    return taken.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "home_shard")
