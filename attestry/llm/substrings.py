"""Substring dedup: words that stand in a long run of words found elsewhere too are removed.

Fixed-block anchors: with windows of `window` words and blocks of (window + 1) // 2 words, every window of a document
holds one of that document's non-overlapping blocks whole. Equal windows therefore meet where one's block equals a
rolling run of as many words in the other. 1. Every text sends the hashes of its rolling runs, dealt by hash into
packed rows; a task indexes those that are blocks and probes them with all runs. 2. The texts with hits are read again:
each hit is extended on both sides to all windows that hold it, and these meet by hash; a window found at two places
is repeated. A maximal repeat is the union of its windows, so all its words get marked. 3. The texts with marks are
read once more and the marked words are left out. Groups are never expanded into pairs, and what repeats within one
slice of texts is settled there and sent once.

A run is known by 40 bits besides its bucket; that only decides what is looked at again. A window is known by two
independent hashes of 64 bits each. Rows are known by their file and place in it, so no two share a key.

Defined results: a null text has no words. White space between kept words becomes one space. Repeated rows are
documents of their own, so each is the other's copy, and so are rows with a null id. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import Words, mix, ngrams, slices, words
from .shared import BROADCAST_KEYS, numbered, settings, spool, without

WINDOW = 35
#: Bytes of text that a row of packed hashes covers at most; a longer text has rows of its own.
SLICE_BYTES = 1 << 21
#: Bytes of text for which there is one bucket.
BUCKET_BYTES = 12_000_000
MOST_BUCKETS = 1 << 16
#: Rows of a batch of texts, so that a worker holds a few MB of them.
BATCH_ROWS = "2000"
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
#: A packed row: the bucket, keys of the texts that have codes here, each text's first word, codes, places among the
#: slice's words (rising). Rows without codes hold what the slice has settled: key and place in the text of each.
PACKED = "bucket int, keys binary, firsts binary, high binary, low binary, place binary"
#: For windows, high is the second hash and low the first.


def block_size(window: int) -> int:
    return (window + 1) // 2


def pack_rising(x: np.ndarray) -> bytes:
    """Rising numbers as their lower 16 bits, after a table of how many precede each multiple of 65536."""
    pages = int(x[-1] >> 16) + 1
    table = np.searchsorted(x, np.arange(pages, dtype=np.int64) << 16).astype("<u4")
    return np.array([pages], "<u4").tobytes() + table.tobytes() + (x & 0xFFFF).astype("<u2").tobytes()


def unpack_rising(b: bytes) -> np.ndarray:
    pages = int(np.frombuffer(b, "<u4", 1)[0])
    table = np.frombuffer(b, "<u4", pages, 4).astype(np.int64)
    low = np.frombuffer(b, "<u2", offset=4 + 4 * pages).astype(np.int64)
    return low + (np.repeat(np.arange(pages), np.diff(np.append(table, len(low)))) << 16)


def settled_and_sent(code: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which codes (with other: pairs of codes) occur more than once here, and the first place of each, rising."""
    order = np.argsort(code, kind="stable") if other is None else np.lexsort((other, code))
    new = np.ones(len(code), bool)
    new[1:] = code[order[1:]] != code[order[:-1]]
    if other is not None:
        new[1:] |= other[order[1:]] != other[order[:-1]]
    again = ~new
    again[:-1] |= ~new[1:]
    return np.sort(order[again]), np.sort(order[new])


def packed_rows(keys: np.ndarray, w: Words, at: np.ndarray, high: np.ndarray, low: np.ndarray, bucket: np.ndarray, settled: np.ndarray, slot: int) -> pa.RecordBatch:
    """Packed rows of the places `at` (words of the slice) by bucket, and one of the settled places."""
    order = np.argsort(bucket.astype(np.uint16), kind="stable")
    bucket, high, low, at = bucket[order].astype(np.int32), high[order], low[order], at[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(at)]))
    columns = [bucket[cut].tolist(), [], [], [high[a:b].tobytes() for a, b in spans], [low[a:b].tobytes() for a, b in spans], [pack_rising(at[a:b]) for a, b in spans]]
    for a, b in spans:  # only the texts that have codes here, so a row is no longer than its codes ask for
        used = np.unique(np.searchsorted(w.first, at[a:b], "right") - 1)
        columns[1].append(keys[used].astype("<i8").tobytes())
        columns[2].append(w.first[used].astype("<u4").tobytes())
    if len(settled):
        own = np.searchsorted(w.first, settled, "right") - 1
        key, place = distinct_pairs(keys[own], settled - w.first[own])
        for column, value in zip(columns, (slot, key.tobytes(), b"", None, None, place.tobytes())):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "keys", "firsts", "high", "low", "place"])


def run_rows(docs: DataFrame, block: int, buckets: int) -> DataFrame:
    """Step 1, map side: all rolling runs. Runs that repeat within a slice count as hits at once."""

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE_BYTES):
                w = words(data, offsets)
                at, code = ngrams(w, block)
                if not len(at):
                    continue
                settled, sent = settled_and_sent(code)
                # of equal runs one is sent; a block, where there is one, so that it gets into the index
                aligned = (at - w.first[np.searchsorted(w.first, at, "right") - 1]) % block == 0
                if len(settled):
                    order = np.lexsort((~aligned, code))
                    sent = np.sort(order[np.flatnonzero(np.diff(code[order], prepend=~code[order[:1]]))])
                runs = code[sent]
                high = (runs >> np.uint64(32)).astype(np.uint8)
                yield packed_rows(keys[lo:hi], w, at[sent], high, runs.astype("<u4"), (runs >> np.uint64(40)) % np.uint64(buckets), at[settled], int(code[0]) % buckets)

    return docs.mapInArrow(probes, PACKED)


def window_rows(docs: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """Step 2, map side: the windows that hold a hit. Windows that repeat within a slice are settled."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = batch.column("key").to_numpy(zero_copy_only=False), batch.column("places")
            for lo, hi, data, offsets in slices(batch.column("text"), SLICE_BYTES):
                w = words(data, offsets)
                flags = np.zeros(len(w.hash) + window + 2, np.int32)
                for k in range(lo, hi):
                    p = np.frombuffer(places[k].as_py(), "<u4").astype(np.int64)
                    first, n = w.first[k - lo], w.first[k - lo + 1] - w.first[k - lo]
                    a, b = np.maximum(p - (window - block), 0), np.minimum(p, n - window)
                    ok = a <= b
                    np.add.at(flags, first + a[ok], 1)
                    np.add.at(flags, first + b[ok] + 1, -1)
                at = np.flatnonzero(np.cumsum(flags) > 0)
                if not len(at):
                    continue
                start, code = ngrams(w, window)
                code = code[np.searchsorted(start, at)]
                other = ngrams(Words(w.data, w.start, w.end, w.first, mix(w.hash * SECOND + np.uint64(1))), window)[1][np.searchsorted(start, at)]
                settled, sent = settled_and_sent(code, other)
                yield packed_rows(keys[lo:hi], w, at[sent], other[sent].astype("<u8"), code[sent].astype("<u8"), other[sent] % np.uint64(buckets), at[settled], int(code[0]) % buckets)

    return docs.mapInArrow(extend, PACKED)


def meet(packed: DataFrame, buckets: int, block: int | None, wide: bool) -> DataFrame:
    """Reduce side of both steps: (key, places) of codes that occur twice, with block only those that equal a block.

    The places go back packed too, dealt by key, so that each text gets one row however many buckets it met in.
    """

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["low"] is None:
                    yield dealt_by_key(np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["place"], "<u4"), buckets)
                else:
                    by_bucket.setdefault(row["bucket"], []).append(row)
        while by_bucket:
            _, rows = by_bucket.popitem()
            high = np.concatenate([np.frombuffer(r["high"], "<u8" if wide else np.uint8) for r in rows])
            code = np.concatenate([np.frombuffer(r["low"], "<u8" if wide else "<u4") for r in rows])
            if not wide:
                code = code | (high.astype(np.uint64) << np.uint64(32))
            place, key = [], []
            for r in rows:
                at, first = unpack_rising(r["place"]), np.frombuffer(r["firsts"], "<u4").astype(np.int64)
                own = np.searchsorted(first, at, "right") - 1
                place.append((at - first[own]).astype("<u4"))
                key.append(np.frombuffer(r["keys"], "<i8")[own])
            del rows
            place, key = np.concatenate(place), np.concatenate(key)
            at = np.arange(len(code))
            if block:
                index = np.unique(code[place % block == 0])
                if not len(index):
                    continue
                at = np.flatnonzero(index[np.minimum(np.searchsorted(index, code), len(index) - 1)] == code)
            order = np.lexsort((high, code)) if wide else at[np.argsort(code[at], kind="stable")]
            same = code[order[1:]] == code[order[:-1]]
            if wide:
                same &= high[order[1:]] == high[order[:-1]]
            twice = np.zeros(len(order), bool)
            twice[1:] |= same
            twice[:-1] |= same
            if twice.any():
                yield dealt_by_key(key[order[twice]], place[order[twice]], buckets)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = [np.empty(0, "<i8")], [np.empty(0, "<u4")]
        for batch in batches:
            keys += [np.frombuffer(x, "<i8") for x in batch.column("keys").to_pylist()]
            places += [np.frombuffer(x, "<u4") for x in batch.column("places").to_pylist()]
        key, place = distinct_pairs(np.concatenate(keys), np.concatenate(places))
        if len(key):
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key[cut], pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in zip(cut, [*cut[1:], len(key)])], pa.binary())})

    found = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(hits, "target int, keys binary, places binary")
    return found.repartitionById(buckets, F.col("target")).mapInArrow(together, "key long, places binary")


def distinct_pairs(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, place), in order of both."""
    order = np.lexsort((place, key))
    key, place = key[order].astype("<i8"), place[order].astype("<u4")
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    return key[new], place[new]


def dealt_by_key(key: np.ndarray, place: np.ndarray, targets: int) -> pa.RecordBatch:
    target = (key.astype(np.uint64) % np.uint64(targets)).astype(np.int32)
    order = np.argsort(target, kind="stable")
    target, key, place = target[order], key[order].astype("<i8"), place[order].astype("<u4")
    cut = np.flatnonzero(np.diff(target, prepend=-1))
    spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(key)]))
    return pa.RecordBatch.from_pydict({"target": pa.array(target[cut], pa.int32()), "keys": pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), "places": pa.array([place[a:b].tobytes() for a, b in spans], pa.binary())})


def with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The texts that have places, with these; only such texts are shuffled where their keys are few."""
    found = spool(places, "places")
    if found.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(found.select("key")), "key", "left_semi")
    return texts.join(found, "key")


def _kept(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        marked = batch.column("places").to_pylist() if "places" in batch.schema.names else [b""] * batch.num_rows
        for text, places in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), marked):
            ws = (text or b"").split()  # splits at the same six characters
            gone = np.zeros(len(ws) + window + 1, np.int32)
            at = np.frombuffer(places, "<u4").astype(np.int64)
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
            keep = np.cumsum(gone)[: len(ws)] == 0 if places else None
            left = ws if keep is None else [x for x, k in zip(ws, keep.tolist()) if k]
            out["n_words"].append(len(ws))
            out["n_removed"].append(len(ws) - len(left))
            out["kept"].append(b" ".join(left))
        arrays = {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out["kept"]])}
        if "places" in batch.schema.names:
            arrays["kept_text"] = pa.array(out["kept"], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_pydict(arrays)


def repeat_marks(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, text) of all rows, and (doc_id, text, key, places) of those with repeated windows: where these start."""
    block = block_size(window)
    rows = numbered(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1))
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        return _marks(rows, block, window, buckets)


def _marks(rows: DataFrame, block: int, window: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    hits = meet(run_rows(rows.select("key", "text"), block, buckets), buckets, block, wide=False)
    windows = window_rows(with_places(rows.select("key", "text"), hits), block, window, buckets)
    return rows, with_places(rows, meet(windows, buckets, None, wide=True))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256."""
    rows, marked = repeat_marks(docs, window, id_col, text_col)
    schema = "doc_id long, key long, n_words long, n_removed long, kept_sha256 string"
    changed = spool(marked.mapInArrow(lambda b: _kept(b, window), schema + ", kept_text string").drop("kept_text"), "changed")
    whole = without(rows, changed).mapInArrow(lambda b: _kept(b, window), schema)
    return whole.unionByName(changed).drop("key")


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of all rows, the texts without their repeated words where there are any."""
    rows, marked = repeat_marks(docs, window, id_col, text_col)
    schema = "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    changed = spool(marked.mapInArrow(lambda b: _kept(b, window), schema).select("key", "doc_id", F.col("kept_text").alias("text")), "changed")
    return without(rows, changed).unionByName(changed).drop("key")
