"""Hierarchical packing of tokenised documents into sequences of several lengths.

A document's ids are cut into pieces of at most the longest window. Whole windows stand alone. A shorter piece is
routed to the smallest tier that holds it; tiers are packed from the longest down into sequences of the tier's own
length, the gap that a sequence's pieces leave being filled by the longest pieces of the shorter tiers that still fit. A
sequence of a short tier goes out only if it is full; where the pieces left cannot fill one, the longest of them opens a
sequence of the window's length, with all shorter tiers to fill its gap. So only sequences of the window's length are
padded. Only a histogram of piece lengths (no more rows than the window has tokens) reaches the driver, which turns it
into packing patterns and how often each is used. Pieces are then dealt to the patterns' places by their rank among
pieces of equal length. Sequences are numbered by their length, longest first, and dealt to the step groups in turn, so
that the groups' sequences of each length differ by one at most and so do all their sequences.

Defined results: a null or empty text has the closing id alone. Every row is packed, repeated rows and rows with a
null id included; ties are ordered by a row's place in the written pieces. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import literal_table, ranked, spool

WINDOW = 2048
CLOSING = 1
TIERS = (256, 512, 1024, 2048)
#: Sequences per step group.
GROUP = 64
#: White space of this length is encoded by the JSON tokenizer: the ranks' library overflows its stack on very long runs.
LONG_SPACE = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(1)
def json_encoder(path: str):
    """The JSON tokenizer, kept by the worker."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def rank_encoder(path: str):
    """The same vocabulary and added tokens out of the rank file beside the JSON file; None where there is none."""
    import public_tokenizers
    import tiktoken

    ranks = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks):
        return None
    with open(ranks, "rb") as f:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)


def encode(text: str, path: str) -> list[int]:
    ranks = rank_encoder(path)
    if ranks is None or (len(text) >= LONG_SPACE and re.search(rf"\s{{{LONG_SPACE}}}", text)):
        return json_encoder(path).encode(text, add_special_tokens=False).ids
    return ranks.encode(text, allowed_special="all")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut_pieces(docs: DataFrame, path: str, window: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece; each id of a document, the closing one included, lies in exactly one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = PIECES.replace(" long", "").split(", ")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or "", path), CLOSING], "<u4").tobytes()
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    for name, value in zip(names, (doc_id, start, len(part) // 4, zlib.crc32(part), n)):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(cut, PIECES)


def tier_of(length: int, window: int = WINDOW) -> int:
    """The smallest tier that holds a piece."""
    return next((t for t in TIERS if length <= t < window), window)


def plan_patterns(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """(lengths in one sequence, how many such sequences) using up the histogram of lengths; longest sequences first.

    The longest piece left opens a sequence of its tier, or of the window where the gap cannot be filled; the gap takes
    the longest pieces that fit, which come from ever shorter tiers. A pattern is repeated while its pieces last, so each
    round uses up at least one length.
    """
    left = {k: n for k, n in histogram.items() if n}
    lengths = sorted(left)
    patterns = []

    def filled(gap: int) -> tuple[dict[int, int], int]:
        used = {}
        at = len(lengths) - 1
        while at >= 0 and gap >= lengths[0]:
            size = lengths[at]
            if size <= gap:
                n = min(gap // size, left[size])
                used[size] = n
                gap -= n * size
            at -= 1
        return used, gap

    while lengths:
        used, gap = filled(tier_of(lengths[-1], window))
        if gap:
            used, gap = filled(window)
        times = min(left[size] // n for size, n in used.items())
        patterns.append(([size for size, n in used.items() for _ in range(n)], times))
        for size, n in used.items():
            left[size] -= n * times
        lengths = [x for x in lengths if left[x]]
    return sorted(patterns, key=lambda x: -padded_length(x[0], window))


def padded_length(lengths: list[int], window: int = WINDOW) -> int:
    """The tier of a sequence that is full, else the window."""
    tier = tier_of(max(lengths), window)
    return tier if sum(lengths) == tier else window


def place_runs(patterns: list[tuple[list[int], int]], window: int = WINDOW) -> list[dict]:
    """Per length, runs of ranks: rank r of [lo, hi) goes to sequence first + (r - lo) // each, at offset + (r - lo) % each * length."""
    runs, ranks, sequence = [], {}, 0
    for lengths, times in patterns:
        offset = 0
        for size in sorted(set(lengths), reverse=True):
            each = lengths.count(size)
            lo = ranks.get(size, 0)
            ranks[size] = lo + each * times
            runs.append({"length": size, "lo": lo, "hi": ranks[size], "first": sequence, "each": each, "offset0": offset, "padded": padded_length(lengths, window)})
            offset += each * size
        sequence += times
    return runs


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, tier, step_group."""
    spark = docs.sparkSession
    pieces = spool(cut_pieces(docs, path or tokenizer_path(), window, id_col, text_col), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    patterns = plan_patterns(histogram, window)
    runs = place_runs(patterns, window)
    steps = max(1, -(-sum(times for _, times in patterns) // GROUP))
    plan = F.broadcast(literal_table(spark, runs, "length bigint, lo bigint, hi bigint, first bigint, each bigint, offset0 bigint, padded bigint"))
    placed = ranked(pieces, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"], "ranked").join(plan, "length").filter("rank >= lo and rank < hi").withColumn("k", F.col("rank") - F.col("lo"))
    tier = F.coalesce(*[F.when((F.col("length") <= t) & F.lit(t < window), F.lit(t)) for t in TIERS], F.lit(window))
    sequence = F.col("first") + F.expr("k div each")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), (F.col("offset0") + F.expr("k % each") * F.col("length")).alias("offset"),
        F.col("padded").alias("sequence_length"), tier.alias("tier"), F.pmod(sequence, F.lit(steps)).cast("long").alias("step_group"))
