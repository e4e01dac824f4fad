"""Conversation prefix trie: what conversations have in common from their first turn on, node by node.

A prefix of a conversation is known by two sums over its turns, of digests salted with the turn's place, so that any
range of a conversation can be summed for itself. Which prefixes may be shared is screened by a count-min sketch of
all prefix digests: 4 rows of counters that stop at 2, of a size with a fixed bound. An estimate of one proves that no
other conversation has the prefix; such nodes are rows of their conversation's tail and are emitted where they stand,
without a shuffle. Only prefixes that may be shared are grouped, exactly. A wrong estimate costs a group of one.

What nodes sum over their subtrees comes without going level by level: each node gives its value to its smallest member,
so a conversation has a value for each of its prefixes, the sum from a prefix to the conversation's end is a running sum
of its rows, and a node's total is the sum of these over its members.

Rows of one conversation are ordered by range, so a very long one is spread over tasks: each task sums its part, and the
parts before it come as a table with at most one row for each task. Nodes with very many members meet their rows by
broadcast (`join_split`), and the ids that end in a node are joined to long strings before they meet.

Defined results: rows without conv_id take no part. Turns with equal numbers are ordered by role, then text; repeated
rows are turns of their own. Null role or text is empty. An empty table has no nodes, not even a root. Other columns
are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import join_split, spool

#: Conversations of one group begin with turns of the group's first one: at most MOST_TAKEN of them.
GROUP, MOST_TAKEN = 20, 3
#: The sketch: rows, and bits of a row's size at least and at most.
ROWS, LEAST_BITS, MOST_BITS = 4, 16, 22
#: Counters that are summed together.
CELLS = 1 << 16
#: The root's digest.
ROOT = "0.0"
#: Digests are sums modulo this.
MODULUS = 1 << 62


def in_ranges(rows: DataFrame, by: list[str], columns: list[str], name: str) -> DataFrame:
    """columns of the rows with _at, which rises in the order of by; rows that tie are dealt too."""
    keys = [*by, "_tie"]
    placed = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return spool(placed.select(*columns, F.monotonically_increasing_id().alias("_at")), name)


def running(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """rows out of in_ranges with run_<column>: the sum over the group's rows up to this one."""
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    so_far = W.partitionBy(group, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    cells = rows.groupBy(group, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    bases = cells.select(group, "_part", *[F.sum(c).over(before).alias(f"_base_{c}") for c in columns]).filter(F.col(f"_base_{columns[0]}").isNotNull())
    bases = spool(bases, "bases")  # of each task the group that it goes on with: at most one row for each
    out = rows.select("*", *[F.sum(c).over(so_far).alias(f"run_{c}") for c in columns]).join(F.broadcast(bases), [group, "_part"], "left")
    kept = [c for c in rows.columns if c not in ("_part", "_at")]
    return out.select(*kept, *[(F.col(f"run_{c}") + F.coalesce(f"_base_{c}", F.lit(0))).alias(f"run_{c}") for c in columns])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, one, two, words): the turns in order from 1, by digest."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    half = [F.conv(F.substr(digest, F.lit(a), F.lit(15)), 16, 10).cast("long").alias(name) for a, name in ((1, "one"), (16, "two"))]
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    slim = in_ranges(rows, ["conv_id", "turn", "role", "text"], ["conv_id", *half, words, F.lit(1).cast("long").alias("place")], "turns")
    return running(slim, "conv_id", ["place"]).select("conv_id", F.col("run_place").alias("place"), "one", "two", "words")


def taken(conv_id: Column) -> Column:
    """How many turns a conversation begins with that are of its group's first one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_TAKEN + 1)).alias("taken")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, one, two, words, length) of the rebuilt turns, and (conv_id, length) of all conversations."""
    own = spool(own, "own")
    first = (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first_id")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", first, taken(F.col("conv_id")))
    heads = own.filter((F.col("place") <= MOST_TAKEN) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "first_id")
    borrowed = spool(sizes.filter("taken > 0").join(heads, "first_id").filter("place <= taken").select("conv_id", "n", "taken", "place", "one", "two", "words"), "borrowed")
    had = borrowed.groupBy("conv_id").agg(F.count("*").alias("had"))
    lengths = sizes.join(had, "conv_id", "left").select("conv_id", "n", "taken", F.coalesce("had", F.lit(0)).alias("had"))
    lengths = spool(lengths.withColumn("length", F.col("had") + F.greatest(F.col("n") - F.col("taken"), F.lit(0))), "lengths")
    total = lengths.agg(F.sum("n")).first()[0] or 0
    kept = own.withColumn("_taken", taken(F.col("conv_id"))).filter("place > _taken").drop("_taken")
    kept = join_split(kept, lengths.select("conv_id", "n", "taken", "had", "length"), "conv_id", "n", total)
    mine = kept.select("conv_id", (F.col("place") - F.col("taken") + F.col("had")).alias("depth"), "one", "two", "words", "length")
    theirs = borrowed.join(lengths.select("conv_id", "length"), "conv_id").select("conv_id", F.col("place").alias("depth"), "one", "two", "words", "length")
    return mine.unionByName(theirs), lengths.select("conv_id", "length")


def prefixes(rows: DataFrame) -> DataFrame:
    """rows with the digests of each prefix (p1, p2) and of that before it (q1, q2)."""
    salted = [F.xxhash64("one", "two", "depth", F.lit(k)).cast("decimal(20,0)").alias(f"d{k}") for k in (1, 2)]
    dealt = in_ranges(rows, ["conv_id", "depth"], ["conv_id", "depth", "words", "length", *salted], "ordered")
    summed = running(dealt, "conv_id", ["d1", "d2"])
    at = [F.pmod(F.col(f"run_d{k}"), F.lit(MODULUS)).cast("long").alias(f"p{k}") for k in (1, 2)]
    before = [F.pmod(F.col(f"run_d{k}") - F.col(f"d{k}"), F.lit(MODULUS)).cast("long").alias(f"q{k}") for k in (1, 2)]
    return spool(summed.select("conv_id", "depth", "words", "length", *at, *before), "prefixes")


def slots(one: np.ndarray, two: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.int64((1 << bits) - 1)
    return [(x >> np.int64(s)) & mask for x in (one, two) for s in (0, 30)]


def sketch(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Count-min sketch of the prefix digests: bits of a row's size, and for each counter whether it is above one."""
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * n).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros((ROWS, 1 << bits), np.uint8)
        for batch in batches:
            one, two = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p1", "p2"))
            for row, at in zip(counters, slots(one, two, bits)):
                at, times = np.unique(at, return_counts=True)
                row[at] = np.minimum(2, row[at] + np.minimum(times, 2))
        cells = counters.reshape(-1, CELLS)
        used = np.flatnonzero(cells.any(1))
        if len(used):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int32()), "counters": pa.array([cells[k].tobytes() for k in used], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, counters in zip(batch.column("cell").to_pylist(), batch.column("counters").to_pylist()):
                have, more = sums.get(cell), np.frombuffer(counters, np.uint8)
                sums[cell] = more if have is None else np.minimum(2, have + more)
        if sums:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(list(sums), pa.int32()), "above": pa.array([np.packbits(x > 1).tobytes() for x in sums.values()], pa.binary())})

    partial = rows.select("p1", "p2").mapInArrow(count, "cell int, counters binary")
    above = np.zeros((ROWS << bits) // 8, np.uint8).reshape(-1, CELLS // 8)
    for r in partial.repartition("cell").mapInArrow(add, "cell int, above binary").collect():  # 256 rows of 8 kB at most
        above[r.cell] = np.frombuffer(r.above, np.uint8)
    return bits, above.reshape(ROWS, -1)


def screened(rows: DataFrame) -> DataFrame:
    """The prefixes with whether they, and those before them, may be shared."""
    bits, above = sketch(rows)
    schema = f"{', '.join(f'{c} long' for c in rows.columns)}, shared boolean, parent_shared boolean"

    def estimated(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(row[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0 for row, at in zip(above, slots(one, two, bits))])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p1, p2, q1, q2, depth = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("p1", "p2", "q1", "q2", "depth"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(estimated(p1, p2)), pa.array(estimated(q1, q2) | (depth == 1))], names=[*batch.schema.names, "shared", "parent_shared"])

    named = spool(rows.mapInArrow(screen, schema), "screened")
    return named.withColumn("p", F.concat_ws(".", "p1", "p2")).withColumn("q", F.concat_ws(".", "q1", "q2")).drop("p1", "p2", "q1", "q2")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(p, ends_sha256): the digest of the comma-joined ids of each p, ascending. Ids come to it in long strings, and pass through it one by one."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"p": [], "first": [], "ids": []}
            for p, rows in groupby(zip(batch.column("p").to_pylist(), batch.column("conv_id").to_pylist()), lambda r: r[0]):
                ids = [c for _, c in rows]
                for c, x in zip(out, (p, ids[0], ",".join(map(str, ids)))):
                    out[c].append(x)
            yield pa.RecordBatch.from_pydict({"p": pa.array(out["p"], pa.string()), "first": pa.array(out["first"], pa.int64()), "ids": pa.array(out["ids"], pa.string())})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for p, ids in zip(batch.column("p").to_pylist(), batch.column("ids").to_pylist()):
                if p != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = p, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"p": pa.array([d[0] for d in done], pa.string()), "ends_sha256": pa.array([d[1] for d in done], pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([now], pa.string()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    dealt = ends.repartitionByRange("p", "conv_id").sortWithinPartitions("p", "conv_id")
    strings = dealt.mapInArrow(join, "p string, first long, ids string")
    return strings.repartition("p").sortWithinPartitions("p", "first").mapInArrow(digest, "p string, ends_sha256 string")


def trie_nodes(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie: rows (conv_id, depth, one, two, words, length) are turns, conversations (conv_id, length) also has those without any."""
    marked = screened(prefixes(rows))
    tails = marked.filter("not shared")
    top = conversations.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "length", F.lit(ROOT).alias("p"), F.lit(None).cast("string").alias("q"))
    members = marked.filter("shared").select(*top.columns).unionByName(top)
    nodes = spool(members.groupBy("p").agg(F.min("depth").alias("depth"), F.min("q").alias("q"), F.min("words").alias("words"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")), "nodes")
    heads = tails.filter("parent_shared")
    children = nodes.select("q").filter("q is not null").unionByName(heads.select("q")).groupBy(F.col("q").alias("p")).agg(F.count("*").alias("n_children"))
    nodes = spool(nodes.join(children, "p", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "nodes")
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0

    known = nodes.select("p", F.col("conv_id").alias("_least"), "n_convs", "n_children", F.col("words").alias("_words"))
    mine = F.col("conv_id") == F.col("_least")
    values = join_split(members.select("conv_id", "depth", "p"), known, "p", "n_convs", total).select(
        "conv_id", (-F.col("depth")).alias("up"), F.lit(0).alias("after"), "p",
        F.when(mine, (F.col("n_convs") - 1) * F.col("_words")).otherwise(0).alias("saved"), F.when(mine & (F.col("n_children") == 0), 1).otherwise(0).cast("long").alias("leaves"))
    last = tails.filter("depth = length").select("conv_id", (-F.col("depth")).alias("up"), F.lit(-1).alias("after"), F.lit(None).cast("string").alias("p"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaves"))
    dealt = in_ranges(values.unionByName(last), ["conv_id", "up", "after"], ["conv_id", "p", "saved", "leaves"], "values")
    sums = running(dealt, "conv_id", ["saved", "leaves"]).filter("p is not null").groupBy("p").agg(F.sum("run_saved").alias("saved_tokens"), F.sum("run_leaves").alias("n_leaves"))

    nothing = F.sha2(F.lit(""), 256)
    ends = ends_digests(members.filter("depth = length").select("p", "conv_id"))
    inner = nodes.join(sums, "p").join(ends, "p", "left").select("conv_id", "depth", "q", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    ended = F.col("depth") == F.col("length")
    alone = [F.lit(1).cast("long").alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(ended, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256")]
    below = inner.unionByName(heads.select("conv_id", "depth", "q", *alone))
    parents = nodes.select(F.col("p").alias("q"), F.col("conv_id").alias("_parent"), F.col("n_children").alias("_children"))
    named = join_split(below, parents, "q", "_children", total + 1, "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("_parent", "conv_id")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rest = tails.filter("not parent_shared").select("conv_id", "depth", *alone).withColumn("parent_conv_id", F.col("conv_id"))
    return named.select(*columns).unionByName(rest.select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text), each rebuilt with the beginning of its group's first one."""
    return trie_nodes(*rebuilt(turns(conversations)))


def plain_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    own = spool(turns(conversations), "own")
    sizes = spool(own.groupBy("conv_id").agg(F.count("*").alias("length")), "lengths")
    total = sizes.agg(F.sum("length")).first()[0] or 0
    rows = join_split(own, sizes.withColumn("n", F.col("length")), "conv_id", "n", total).select("conv_id", F.col("place").alias("depth"), "one", "two", "words", "length")
    return trie_nodes(rows, sizes)
