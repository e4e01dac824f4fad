"""Suffix dedup: bytes that stand in a string of `window` bytes which begins elsewhere too are removed.

A depth-limited radix sort of all suffixes, most significant digit first: suffixes are told apart only through their
first `window` bytes, so groups that stay equal to that depth are exactly the repeated windows. Digits are names (64-bit
hashes) of byte strings instead of single bytes, since only the groups matter and not their order. Three passes:

1. Suffixes are taken in runs: neighbours whose windows have the same least name among their strings of `depth` bytes.
   Equal windows lie in runs of equal names, wherever they stand, and a run of a hundred suffixes is one row. The row
   has the name (first digit) and a digest of 128 bits of all bytes of the run's windows (all further digits at once).
   Runs that are alone with their name are done. Runs with equal digests are repeated as a whole. What else has company
   stays open: runs at the edges of repeats. Of a digest with company one run stays open too, for the others.
2. The same for the open suffixes, with names of 8 bytes less than the window, so that runs are a few suffixes long.
3. The same with names of whole windows: each suffix is a row of its own.

Every pass combines what one task has read (some hundred thousand rows) before anything is sent: of equal runs one is
sent, and a name with several digests goes by digest with one row for the name, so no name gathers in a task. A run may
be cut anywhere without changing the result (cut runs get open), so very long texts are read in pieces.

Defined results: a null text is empty. Texts shorter than the window keep all. Matches never cross documents. Repeated
rows and rows with a null id are documents of their own, so copies of at least `window` bytes lose all of them. What is
left may end inside a character, so it is bytes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_text import BYTE_BACK, BYTE_BASE, BYTE_VALUE, WORD_BACK, WORD_BASE, mix, powers
from .shared import BROADCAST_KEYS, numbered, settings, spool, without

WINDOW = 200
#: Bytes that are looked at together.
PIECE = 1 << 20
#: Runs that a task combines before it sends them.
CHUNK = 400_000
#: Bytes of text for which there is one bucket, and most partitions that buckets are dealt to; beyond, a partition has several buckets, one after the other.
BUCKET_BYTES, MOST_PARTS = 12_000_000, 1 << 14
#: Texts, and packed rows, of a batch.
BATCH_ROWS = "1000"
#: Found spans are broadcast up to so many bytes.
BROADCAST_BYTES = 32_000_000
OTHER_VALUE = mix(BYTE_VALUE)
#: Of a row: its chunk has more like it; it is dealt by digest as its name has several in the chunk; it only says that its name occurs.
MANY, BY_DIGEST, NAME_ONLY = 1, 2, 4
COLUMNS = {"code": "<u8", "one": "<u8", "two": "<u8", "key": "<i8", "place": "<u4", "size": "<u4", "flag": "u1"}
PACKED = "bucket int, " + ", ".join(f"{c} binary" for c in COLUMNS)
FOUND = "target int, is_open boolean, keys binary, places binary, sizes binary"


def depths(window: int) -> list[int]:
    """How many bytes the names of each pass have."""
    half = max(1, window // 2)
    return sorted({half, max(half, window - 8), window})


def least_of(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each span neighbours."""
    have, out = 1, x
    while 2 * have <= span:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (span - have)], out[span - have :]) if span > have else out


def find_runs(data: np.ndarray, first: np.ndarray, window: int, depth: int) -> dict[str, np.ndarray]:
    """Runs of suffixes of the parts data[first[k]:first[k + 1]], each at least window long: part, place in data, size, name and digests."""
    n = len(data)
    one, two = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(BYTE_BASE, n), out=one[1:])
    np.cumsum(OTHER_VALUE[data] * powers(WORD_BASE, n), out=two[1:])
    name = (one[depth:] - one[: n + 1 - depth]) * powers(BYTE_BACK, n + 1)[: n + 1 - depth]
    name = mix(name)
    least = least_of(name, window - depth + 1)
    edge = np.zeros(n + 1, np.int8)
    edge[first[:-1]] = 1
    edge[first[1:] - window + 1] -= 1
    whole = np.cumsum(edge[: len(least)], dtype=np.int8) > 0
    last = name[: len(least)] == least
    last[:-1] |= (least[1:] != least[:-1]) | ~whole[1:]
    last[-1:] = True
    hi = np.flatnonzero(last & whole)
    begin = whole.copy()
    begin[1:] &= last[:-1] | ~whole[:-1]
    lo = np.flatnonzero(begin)
    size = (hi - lo + 1).astype(np.uint64)
    end = hi + window
    return {
        "part": np.searchsorted(first, lo, "right") - 1, "at": lo, "size": size, "code": least[lo],
        "one": mix((one[end] - one[lo]) * powers(BYTE_BACK, n + 1)[lo] + size), "two": mix((two[end] - two[lo]) * powers(WORD_BACK, n + 1)[lo] + size),
    }


def text_parts(texts: pa.Array, spans: list[bytes] | None, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, row, start in its text, start in the bytes, length) of what is looked at: whole texts, or the windows that begin in the spans."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, places, values = texts.buffers()
    at = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    if spans is None:
        row, start, size = np.arange(len(texts)), np.zeros(len(texts), np.int64), np.diff(at)
    else:
        both = [np.frombuffer(s, "<u4").astype(np.int64).reshape(-1, 2) for s in spans]
        row = np.repeat(np.arange(len(both)), [len(b) for b in both])
        edges = np.concatenate(both) if both else np.empty((0, 2), np.int64)
        start, size = edges[:, 0], edges[:, 1] - edges[:, 0] + window - 1
    long = size >= window
    row, start, size = row[long], start[long], size[long]
    times = np.maximum(1, -(-(size - window + 1) // PIECE))  # a longer one in pieces of PIECE suffixes
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    row, start, size = np.repeat(row, times), np.repeat(start, times) + step * PIECE, np.minimum(np.repeat(size, times) - step * PIECE, PIECE + window - 1)
    return data, row, start, at[row] + start, size


def packed(bucket: np.ndarray, rows: dict[str, np.ndarray]) -> list[list]:
    """Columns of PACKED, one row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)]))
    out = [bucket[cut].astype(np.int32).tolist()]
    for name, kind in COLUMNS.items():
        column = rows[name][order].astype(kind)
        out.append([column[a:b].tobytes() for a, b in spans])
    return out


def group_edges(code: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted order of the rows, and where in it equal names and equal rows begin."""
    order = np.lexsort((size, two, one, code))
    name, whole = np.ones(len(order), bool), np.ones(len(order), bool)
    name[1:] = np.diff(code[order]) != 0
    whole[1:] = name[1:] | (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0) | (np.diff(size[order]) != 0)
    return order, name, whole


def send(rows: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Combines what a task has read. Runs that repeat within it are settled: a packed row without names has these."""
    order, name, whole = group_edges(rows["code"], rows["one"], rows["two"], rows["size"])
    group, count = np.cumsum(whole) - 1, np.diff(np.append(np.flatnonzero(whole), len(whole)))
    settled = order[count[group] > 1]
    sent = order[whole]
    named = np.cumsum(name[whole]) - 1
    several = np.bincount(named)[named] > 1
    out = {c: rows[c][sent] for c in rows} | {"flag": (MANY * (count > 1) + BY_DIGEST * several).astype(np.uint8)}
    heads = np.flatnonzero(name[whole])
    heads = heads[several[heads]]
    out = {c: np.concatenate([v, v[heads]]) for c, v in out.items()}
    out["flag"][len(sent) :] = NAME_ONLY
    by = np.where(out["flag"] & BY_DIGEST, out["one"], out["code"])
    columns = packed((by % np.uint64(buckets)).astype(np.int64), out)
    if len(settled):
        for column, value in zip(columns, [int(rows["code"][0] % np.uint64(buckets)), None, None, None, *(rows[c][settled].astype(COLUMNS[c]).tobytes() for c in ("key", "place", "size")), None]):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", *COLUMNS])


def pass_rows(texts: DataFrame, window: int, depth: int, buckets: int) -> DataFrame:
    """Map side of a pass over (key, text) or, for open suffixes only, (key, text, spans)."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            return send({c: np.concatenate([h[c] for h in held]) for c in held[0]}, buckets)

        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else None
            data, row, start, at, size = text_parts(batch.column("text"), spans, window)
            total = np.concatenate([[0], np.cumsum(size)])
            a = 0
            while a < len(row):
                b = max(a + 1, int(np.searchsorted(total, total[a] + PIECE, "right")) - 1)
                together = data[at[a] : at[a] + size[a]] if b == a + 1 else np.concatenate([data[x : x + s] for x, s in zip(at[a:b].tolist(), size[a:b].tolist())])
                first = total[a : b + 1] - total[a]
                r = find_runs(together, first, window, depth)
                part = r["part"]
                held.append({"code": r["code"], "one": r["one"], "two": r["two"], "key": keys[row[a:b]][part], "place": r["at"] - first[part] + start[a:b][part], "size": r["size"]})
                n += len(part)
                a = b
                if n >= CHUNK:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return texts.mapInArrow(runs, PACKED)


def sort_bucket(r: dict[str, np.ndarray], last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a bucket that are repeated, and rows that stay open."""
    order, name, whole = group_edges(r["code"], r["one"], r["two"], r["size"])
    group, by_name = np.cumsum(whole) - 1, np.cumsum(name) - 1
    flag = r["flag"][order]
    real = (flag & NAME_ONLY) == 0
    settled = ((np.bincount(group, real) > 1) | (np.bincount(group, (flag & MANY) > 0) > 0))[group] & real
    marks = order[settled & ((flag & MANY) == 0)]
    if last:
        return marks, order[:0]
    company = ((np.bincount(by_name, whole) > 1) | (np.bincount(by_name, (flag & (BY_DIGEST | NAME_ONLY)) > 0) > 0))[by_name]
    real_at = np.flatnonzero(real)
    head = np.zeros(len(order), bool)
    head[real_at[np.unique(group[real_at], return_index=True)[1]]] = True
    return marks, order[company & real & (~settled | head)]


def dealt(r: dict[str, np.ndarray], which: np.ndarray, is_open: bool, targets: int) -> Iterator[pa.RecordBatch]:
    if not len(which):
        return
    target = (r["key"][which].astype(np.uint64) % np.uint64(targets)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    target, which = target[order], which[order]
    cut = np.flatnonzero(np.diff(target, prepend=-1))
    spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(which)]))
    columns = [pa.array([r[c][which[a:b]].astype(COLUMNS[c]).tobytes() for a, b in spans], pa.binary()) for c in ("key", "place", "size")]
    yield pa.RecordBatch.from_arrays([pa.array(target[cut].astype(np.int32)), pa.array([is_open] * len(cut)), *columns], names=["target", "is_open", "keys", "places", "sizes"])


def sort_pass(rows: DataFrame, parts: int, last: bool) -> DataFrame:
    """Reduce side of a pass: repeated and open runs, packed by the texts they are dealt to."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                r = {c: np.concatenate([np.frombuffer(h[c], kind) for h in held]) for c, kind in COLUMNS.items()}
                held.clear()
                for which, is_open in zip(sort_bucket(r, last), (False, True)):
                    yield from dealt(r, which, is_open, parts)

        for batch in batches:
            for row in batch.to_pylist():
                if row["code"] is None:
                    r = {c: np.frombuffer(row[c], COLUMNS[c]) for c in ("key", "place", "size")}
                    yield from dealt(r, np.arange(len(r["key"])), False, parts)
                    continue
                if row["bucket"] != bucket:
                    yield from done()
                    bucket = row["bucket"]
                held.append(row)
        yield from done()

    by = F.expr(f"bucket % {parts}")
    return rows.repartitionById(parts, by).sortWithinPartitions("bucket").mapInArrow(sort, FOUND)


def merged_spans(found: DataFrame, parts: int) -> DataFrame:
    """(key, spans): of each text the places where runs begin, as rising pairs of first and after the last."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lo, size = [np.empty(0, "<i8")], [np.empty(0, "<u4")], [np.empty(0, "<u4")]
        for batch in batches:
            for column, kept, kind in (("keys", key, "<i8"), ("places", lo, "<u4"), ("sizes", size, "<u4")):
                kept += [np.frombuffer(x, kind) for x in batch.column(column).to_pylist()]
        key, lo, size = np.concatenate(key), np.concatenate(lo).astype(np.int64), np.concatenate(size)
        if not len(key):
            return
        order = np.lexsort((lo, key))
        key, lo, hi = key[order], lo[order], (lo + size)[order]
        text = np.cumsum(np.diff(key, prepend=key[:1]) != 0) << 33  # places are below 2 ** 32
        reach = np.maximum.accumulate(text + hi)
        new = np.ones(len(key), bool)
        new[1:] = (text + lo)[1:] > reach[:-1]
        at = np.flatnonzero(new)
        ends = reach[np.append(at[1:], len(key)) - 1] & ((1 << 33) - 1)
        pairs = np.stack([lo[at], ends], 1).astype("<u4")
        cut = np.flatnonzero(np.append(True, np.diff(key[at]) != 0))
        yield pa.RecordBatch.from_pydict({"key": pa.array(key[at][cut], pa.int64()), "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(at)])], pa.binary())})

    return found.repartitionById(parts, F.col("target")).mapInArrow(merge, "key long, spans binary")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows that have spans, with these: by broadcast up to BROADCAST_BYTES, else by shuffling only such rows where their keys are few."""
    n, size = spans.agg(F.count("*"), F.sum(F.octet_length("spans") + 8)).first()
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(spans), "key")
    if n <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(spans.select("key")), "key", "left_semi")
    return rows.join(spans, "key")


def repeat_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, text) of all rows, and (key, spans) of those with repeated windows: where these begin."""
    spark = docs.sparkSession
    rows = numbered(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    parts = min(buckets, MOST_PARTS)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        marks, looked_at = None, rows.select("key", "text")
        for depth in depths(window):
            found = spool(sort_pass(pass_rows(looked_at, window, depth, buckets), parts, depth == window), "runs")
            repeated, still = found.filter("not is_open"), found.filter("is_open")
            marks = repeated if marks is None else marks.unionByName(repeated)
            if still.isEmpty():
                break
            looked_at = with_spans(rows.select("key", "text"), spool(merged_spans(still, parts), "open"))
        return rows, spool(merged_spans(marks, parts), "spans")


def _left(batches: Iterator[pa.RecordBatch], window: int, whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marked = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for text, spans in zip(batch.column("text").cast(pa.large_binary()).to_pylist(), marked):
            text, left, at, gone = text or b"", [], 0, 0
            for a, b in np.frombuffer(spans or b"", "<u4").astype(np.int64).reshape(-1, 2).tolist():
                if a > at or not gone:  # else it touches what is removed already
                    left.append(text[at:a])
                    gone += 1
                at = b - 1 + window
            left.append(text[at:])
            kept = b"".join(left)
            for c, x in zip(out, (len(text), len(text) - len(kept), gone, kept)):
                out[c].append(x)
        arrays = {"doc_id": batch.column("doc_id"), "key": batch.column("key"), **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out["kept"]], pa.string())}
        if whole:
            arrays["kept"] = pa.array(out["kept"], pa.binary())
        yield pa.RecordBatch.from_pydict(arrays)


def _results(docs: DataFrame, window: int, id_col: str, text_col: str, whole: bool) -> DataFrame:
    rows, spans = repeat_spans(docs, window, id_col, text_col)
    schema = "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * whole
    size = spans.agg(F.sum(F.octet_length("spans") + 8)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(spans), "key", "left").mapInArrow(lambda b: _left(b, window, whole), schema).drop("key")
    changed = with_spans(rows, spans).mapInArrow(lambda b: _left(b, window, whole), schema)
    return without(rows, spans).mapInArrow(lambda b: _left(b, window, whole), schema).unionByName(changed).drop("key")


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256."""
    return _results(docs, window, id_col, text_col, False)


def without_repeated_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same with the bytes that are left, as kept."""
    return _results(docs, window, id_col, text_col, True)
