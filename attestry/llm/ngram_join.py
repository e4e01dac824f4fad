"""N-gram Jaccard join: documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more, exactly.

1. Every text gives its set of n-gram hashes (64 bits) and a 128-bit digest of the set; equal sets are one class.
2. Filter: a set that links shares all but n - ceil(t n) of its n-grams with one other set, so of its q smallest
   hashes at least q - (n - ceil(t n)) occur in another class. Packed hashes meet by value; most classes end here.
3. The n-grams of the classes left are counted, and ordered globally by count and hash. N-grams of one class only
   cannot match; of the others each class keeps its ordered list.
4. Prefix-tree join: lists are stored in tries, the most frequent n-grams first, so that sets with a common start
   share their overlap with a probe set; a subtree whose longest list cannot reach the overlap that its smallest set
   needs is cut off. Classes meet first a central class of equal min-hash (one probe each, whole groups of near copies
   become one cluster); then, for all n-grams within two classes' prefixes, classes of different clusters whose
   lengths and positions allow it. Pairs inside a cluster are already connected and need no look.
5. Components of the links, as the smallest document id. similar_sets gives the links themselves.

Groups go through the tries in parts of bounded size. Rows are known by file and place, classes by 128 bits. Defined results: a null or empty text has no n-grams and links
with nothing; with fewer words than n the whole sequence is one n-gram. Repeated rows are one class. Rows with a null
id take part; the component's id is its smallest id that is not null (null if there is none). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import mix, ngrams, slices, words
from .components import components
from .shared import BROADCAST_KEYS, join_split, numbered, settings, spool, without
from .substrings import BATCH_ROWS, BUCKET_BYTES, MOST_BUCKETS, pack_rising, unpack_rising

N = 5
#: The threshold 0.8 as a fraction: the overlap i of sets of a and b n-grams must have (TOP + DOWN) * i >= TOP * (a + b).
TOP, DOWN = 4, 5
SLICE_BYTES = 1 << 21
#: Min-hash rounds in which a class meets a central one.
ROUNDS = 2
#: Sets in one trie at most (about).
TRIE_SETS = 256
DIGEST = 16


def least_shared(n):
    """ceil(t n): n-grams that a set of n shares with any set it links with, at least."""
    return (TOP * n + DOWN - 1) // DOWN


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct n-grams of each text, in order of both."""
    w = words(data, offsets, lower=True)
    at, h = ngrams(w, n)
    text = w.text_of_word()[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for step in range(n - 1):  # the sequence of a short text, word by word
            live = count[short] > step
            whole[live] = mix(whole[live] * np.uint64(31) + w.hash[w.first[short[live]] + step] + np.uint64(step))
        text, h = np.concatenate([text, short]), np.concatenate([h, whole])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return text[new], h[new]


def digest(codes: np.ndarray) -> bytes:
    return hashlib.blake2b(codes.tobytes(), digest_size=DIGEST).digest()


def sets_of(batches: Iterator[pa.RecordBatch], n: int):
    """Per slice of a batch: (batch, lo, hi, bounds, hashes): text k's set is hashes[bounds[k]:bounds[k + 1]]."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text"), SLICE_BYTES):
            text, h = ngram_sets(data, offsets, n)
            yield batch, lo, hi, np.searchsorted(text, np.arange(hi - lo + 1)), h


def class_rows(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, key, n, cls, short) of each row; cls is null for an empty set."""

    def compute(batches):
        for batch, lo, hi, cut, h in sets_of(batches, n):
            names = [digest(h[a:b]) if b > a else None for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(lo, hi - lo), "key": batch.column("key").slice(lo, hi - lo), "n": pa.array(np.diff(cut), pa.int64()), "cls": pa.array(names, pa.binary()), "short": pa.array([short_name(x) if x else None for x in names], pa.int64())})

    return rows.mapInArrow(compute, "doc_id long, key long, n long, cls binary, short long")


def short_name(name: bytes) -> int:
    """64 bits of a class's digest: enough to count, since one class is only taken for another where both share an n-gram."""
    return int.from_bytes(name[:8], "little", signed=True)


def smallest_rows(rows: DataFrame, n: int, buckets: int) -> DataFrame:
    """Packed rows (bucket, classes, owner, code) of each distinct set's smallest hashes. Codes within several sets of a
    slice are settled (rows without codes: class and how many of its codes) and sent once, for no class.
    """

    def compute(batches):
        for _, _, _, cut, h in sets_of(batches, n):
            sets: dict[bytes, np.ndarray] = {}
            for a, b in zip(cut, cut[1:]):
                if b > a:
                    sets[digest(h[a:b])] = h[a : a + int(sample_size(b - a))]
            if not sets:
                continue
            names = np.array([short_name(x) for x in sets], "<i8")
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets.values()])
            code = np.concatenate(list(sets.values()))
            _, first, inverse, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
            settled = np.bincount(owner[count[inverse] > 1], minlength=len(sets))
            owner = np.where(count[inverse] > 1, len(sets), owner)[first]
            code = code[first]
            order = np.lexsort((owner, code % np.uint64(buckets)))
            owner, code = owner[order], code[order]
            bucket = (code % np.uint64(buckets)).astype(np.int32)
            at = np.flatnonzero(np.diff(bucket, prepend=-1))
            spans = list(zip(at.tolist(), [*at[1:].tolist(), len(code)]))
            columns = [bucket[at].tolist(), [], [], [code[a:b].astype("<u8").tobytes() for a, b in spans]]
            for a, b in spans:  # only the classes that have codes here, so a row is no longer than its codes ask for
                used, local = np.unique(owner[a:b], return_inverse=True)
                columns[1].append(names[used[used < len(names)]].tobytes())
                columns[2].append(pack_rising(local))
            some = np.flatnonzero(settled)
            if len(some):
                for column, value in zip(columns, (int(code[0] % np.uint64(buckets)), names[some].tobytes(), settled[some].astype("<u4").tobytes(), None)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "classes", "owner", "code"])

    return rows.mapInArrow(compute, "bucket int, classes binary, owner binary, code binary")


def sample_size(n):
    """Smallest hashes that are looked at: those that a link may miss, and a tenth of the set (one at least) besides."""
    return n - least_shared(n) + np.maximum(1, (n + 9) // 10)


def shared_counts(packed: DataFrame, buckets: int) -> DataFrame:
    """(short, shared): how many of each class's smallest hashes occur in another class."""

    def tally(name: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        """Packed again, dealt by class."""
        target = (name.astype(np.uint64) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        target, name, number = target[order], name[order].astype("<i8"), number[order].astype("<u4")
        at = np.flatnonzero(np.diff(target, prepend=-1))
        spans = list(zip(at.tolist(), [*at[1:].tolist(), len(name)]))
        return pa.RecordBatch.from_pydict({"target": pa.array(target[at], pa.int32()), "names": pa.array([name[a:b].tobytes() for a, b in spans], pa.binary()), "numbers": pa.array([number[a:b].tobytes() for a, b in spans], pa.binary())})

    def compute(batches):
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["code"] is None:
                    yield tally(np.frombuffer(r["classes"], "<i8"), np.frombuffer(r["owner"], "<u4"))
                else:
                    by_bucket.setdefault(r["bucket"], []).append(r)
        while by_bucket:
            _, rows = by_bucket.popitem()
            code = np.concatenate([np.frombuffer(r["code"], "<u8") for r in rows])
            name, nobody = [], []
            for r in rows:
                names, owner = np.frombuffer(r["classes"], "<i8"), unpack_rising(r["owner"])
                nobody.append(owner == len(names))
                name.append(np.append(names, 0)[owner])
            del rows
            name, nobody = np.concatenate(name), np.concatenate(nobody)
            order = np.lexsort((name, code))
            code, name, nobody = code[order], name[order], nobody[order]
            start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(code))))
            last = np.append(start[1:], len(code)) - 1
            many = (name[start] != name[last])[group] | (np.bincount(group, nobody) > 0)[group]
            keep = many & ~nobody
            mine, codes = name[keep], code[keep]
            new = np.ones(len(mine), bool)  # a class that came in several slices counts its code once
            new[1:] = (mine[1:] != mine[:-1]) | (codes[1:] != codes[:-1])
            if len(mine):
                yield tally(*np.unique(mine[new], return_counts=True))

    def add_up(batches):
        names, numbers = [np.empty(0, "<i8")], [np.empty(0, "<u4")]
        for batch in batches:
            names += [np.frombuffer(x, "<i8") for x in batch.column("names").to_pylist()]
            numbers += [np.frombuffer(x, "<u4") for x in batch.column("numbers").to_pylist()]
        every, inverse = np.unique(np.concatenate(names), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(numbers), len(every)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"short": pa.array(every, pa.int64()), "shared": pa.array(total, pa.int64())})

    met = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(compute, "target int, names binary, numbers binary")
    return met.repartitionById(buckets, F.col("target")).mapInArrow(add_up, "short long, shared long")


def chunk_rows(texts: DataFrame, n: int) -> DataFrame:
    """One row per slice: (chunk, classes, sizes, codes): the sets of the classes in it, each class once per slice."""

    def compute(batches):
        for _, _, _, cut, h in sets_of(batches, n):
            sets = {digest(h[a:b]): h[a:b] for a, b in zip(cut, cut[1:]) if b > a}
            if sets:
                chunk = hashlib.blake2b(b"".join(sets), digest_size=DIGEST).digest()
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.binary()), "classes": pa.array([b"".join(sets)], pa.binary()), "sizes": pa.array([np.array([len(x) for x in sets.values()], "<u4").tobytes()], pa.binary()), "codes": pa.array([np.concatenate(list(sets.values())).astype("<u8").tobytes()], pa.binary())})

    return texts.mapInArrow(compute, "chunk binary, classes binary, sizes binary, codes binary")


def chunk_counts(chunks: DataFrame, buckets: int) -> DataFrame:
    """(chunk, codes, counts): the codes of a chunk that several classes hold, with the number of classes."""

    def send(batches):
        for batch in batches:
            for r in batch.to_pylist():
                code, count = np.unique(np.frombuffer(r["codes"], "<u8"), return_counts=True)
                order = np.argsort((code % np.uint64(buckets)).astype(np.uint16), kind="stable")
                code, count = code[order], count[order]
                bucket = (code % np.uint64(buckets)).astype(np.int32)
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                spans = list(zip(at.tolist(), [*at[1:].tolist(), len(code)]))
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[at], pa.int32()), "chunk": pa.array([r["chunk"]] * len(spans), pa.binary()), "codes": pa.array([code[a:b].astype("<u8").tobytes() for a, b in spans], pa.binary()), "counts": pa.array([count[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary())})

    def add_up(batches):
        by_bucket: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                by_bucket.setdefault(r["bucket"], []).append(r)
        while by_bucket:
            _, rows = by_bucket.popitem()
            codes = [np.frombuffer(r["codes"], "<u8") for r in rows]
            every, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.bincount(inverse, np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]))[inverse].astype(np.uint32)
            at = 0
            for r, code in zip(rows, codes):
                mine = total[at : at + len(code)]
                at += len(code)
                keep = mine > 1
                if keep.any():
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([r["chunk"]], pa.binary()), "codes": pa.array([code[keep].tobytes()], pa.binary()), "counts": pa.array([mine[keep].astype("<u4").tobytes()], pa.binary())})

    sent = chunks.select("chunk", "codes").mapInArrow(send, "bucket int, chunk binary, codes binary, counts binary")
    return sent.repartitionById(buckets, F.col("bucket")).mapInArrow(add_up, "chunk binary, codes binary, counts binary")


ORDERED = "cls binary, n long, alone long, codes binary, counts binary, weight double"


def ordered_sets(chunks: DataFrame, counted: DataFrame) -> DataFrame:
    """(cls, n, alone, codes, counts, weight): a class's codes that other classes hold, rarest first, how many codes it
    has alone, and how central it is (mean count over all its codes).
    """

    def compute(batches):
        for batch in batches:
            for r in batch.to_pylist():
                codes, sizes = np.frombuffer(r["codes"], "<u8"), np.frombuffer(r["sizes"], "<u4").astype(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                known = np.concatenate([np.frombuffer(p["codes"], "<u8") for p in r["parts"]] or [np.empty(0, np.uint64)])
                count = np.concatenate([np.frombuffer(p["counts"], "<u4") for p in r["parts"]] or [np.empty(0, np.uint32)])
                order = np.argsort(known)
                known, count = known[order], count[order]
                if not len(known):
                    continue
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[at] == codes
                owner, codes, count = owner[hit], codes[hit], count[at[hit]]
                order = np.lexsort((codes, count, owner))
                owner, codes, count = owner[order], codes[order], count[order]
                cut = np.searchsorted(owner, np.arange(len(sizes) + 1))
                out = [(r["classes"][DIGEST * k : DIGEST * (k + 1)], int(sizes[k]), int(sizes[k] - (b - a)), codes[a:b].astype(">u8").tobytes(), count[a:b].astype("<u4").tobytes(), float(count[a:b].sum() / sizes[k])) for k, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64()))], names=["cls", "n", "alone", "codes", "counts", "weight"])

    parts = counted.groupBy("chunk").agg(F.collect_list(F.struct("codes", "counts")).alias("parts"))  # one part per bucket
    sets = chunks.join(parts, "chunk").mapInArrow(compute, ORDERED)
    one = F.min_by(F.struct("n", "alone", "codes", "counts", "weight"), "n")
    # a class that came in several chunks has equal rows: those with too many codes of its own cannot link and go
    return sets.filter(F.col("alone") <= F.col("n") - F.ceil(F.col("n") * TOP / DOWN)).groupBy("cls").agg(one.alias("s")).select("cls", "s.*")


def walk_trie(probe: np.ndarray, n: int, sets: list[np.ndarray], sizes: list[int]) -> list[int]:
    """Which sets link with the probe. Sets are lists of big-endian codes in one global order.

    The sorted sets and the lengths of their common starts are the trie: a node is a range of sets and the number of
    codes they share, an edge is the run of codes down to where the range divides.
    """
    order = sorted(range(len(sets)), key=lambda k: sets[k].tobytes())
    row = [sets[k] for k in order]
    size = [sizes[k] for k in order]
    have = np.sort(probe)

    def common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    lcp = [0, *(common(a, b) for a, b in zip(row, row[1:]))]
    links, todo = [], [(0, len(row), 0, 0)]
    while todo:
        lo, hi, depth, overlap = todo.pop()
        most = overlap + min(max(len(x) for x in row[lo:hi]) - depth, len(have) - overlap)
        if (TOP + DOWN) * most < TOP * (n + min(size[lo:hi])):
            continue
        down = min(lcp[lo + 1 : hi], default=len(row[lo]))
        edge = row[lo][depth:down]
        if len(edge) and len(have):
            overlap += int((have[np.minimum(np.searchsorted(have, edge), len(have) - 1)] == edge).sum())
        if hi - lo == 1 or len(row[lo]) == down:
            k = lo
            while k < hi and len(row[k]) == down:  # sets that end here
                if (TOP + DOWN) * overlap >= TOP * (n + size[k]):
                    links.append(order[k])
                k += 1
            lo = k
        begin = lo
        for k in range(lo + 1, hi + 1):
            if k == hi or lcp[k] == down:
                if begin < k:
                    todo.append((begin, k, down, overlap))
                begin = k
    return links


def trie_join(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the given distinct pairs that link. a's set probes tries of its b's, TRIE_SETS or so at a time."""
    counted = spool(pairs.groupBy("a").agg(F.ceil(F.count("*") / TRIE_SETS).cast("int").alias("parts")).filter("parts > 1"), "large")
    large = F.broadcast(counted) if counted.count() <= BROADCAST_KEYS else counted  # a probe of few sets is not among them
    dealt = spool(pairs.join(large, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")), "pairs")
    slim = sets.select("cls", "n", "codes")
    probes = dealt.select("a", "part").distinct().join(slim.withColumnRenamed("cls", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "n", "codes")
    members = dealt.join(slim.withColumnRenamed("cls", "b"), "b").select("a", "part", "b", "n", "codes")
    rows = probes.unionByName(members)
    spread = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def compute(batches):
        now, probe, n, names, found, sizes = None, None, 0, [], [], []

        def flush():
            links = walk_trie(probe, n, found, sizes) if found else []
            return pa.RecordBatch.from_pydict({"a": pa.array([now[0]] * len(links), pa.binary()), "b": pa.array([names[k] for k in links], pa.binary())})

        for batch in batches:
            for a, part, b, size, codes in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "n", "codes"))):
                code = np.frombuffer(codes, ">u8")[::-1]  # the most frequent first
                if b is None:
                    if now is not None and found:
                        yield flush()
                    now, probe, n, names, found, sizes = (a, part), code.astype(np.uint64), size, [], [], []
                else:
                    names.append(b)
                    found.append(np.ascontiguousarray(code))
                    sizes.append(size)
        if now is not None and found:
            yield flush()

    return spread.mapInArrow(compute, "a binary, b binary")


def central_pairs(sets: DataFrame, seed: int) -> DataFrame:
    """(a, b): each class b with the most central class a among those of equal min-hash."""

    def compute(batches):
        for batch in batches:
            low = [int(mix(np.frombuffer(c, ">u8").astype(np.uint64) ^ np.uint64(seed * 0x9E3779B9 + 1)).min() >> np.uint64(1)) for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_pydict({"low": pa.array(low, pa.int64()), "cls": batch.column("cls"), "weight": batch.column("weight")})

    rows = spool(sets.select("cls", "codes", "weight").mapInArrow(compute, "low long, cls binary, weight double"), "minhash")
    top = spool(rows.groupBy("low").agg(F.max_by("cls", F.struct("weight", "cls")).alias("a"), F.count("*").alias("k")).filter("k > 1").select("low", "a"), "central")
    return rows.join(top, "low").select("a", F.col("cls").alias("b")).filter("a != b")


def prefix_rows(sets: DataFrame) -> DataFrame:
    """(code, cls, n, left) of the codes in a class's prefix that other classes hold; left counts the codes from there on."""

    def compute(batches):
        for batch in batches:
            for cls, n, alone, codes in zip(*(batch.column(c).to_pylist() for c in ("cls", "n", "alone", "codes"))):
                code = np.frombuffer(codes, ">u8")[: max(0, n - least_shared(n) + 1 - alone)]
                if len(code):
                    yield pa.RecordBatch.from_pydict({"code": pa.array(code.astype(np.uint64).view(np.int64)), "cls": pa.array([cls] * len(code), pa.binary()), "n": pa.array([n] * len(code), pa.int64()), "left": pa.array(n - alone - np.arange(len(code)), pa.int64())})

    return sets.select("cls", "n", "alone", "codes").mapInArrow(compute, "code long, cls binary, n long, left long")


def crossing_pairs(sets: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct (a, b) of different clusters that share a prefix code, by lengths and positions still able to link.

    Of a code's clusters the one with most classes only meets the others; its own pairs are not formed.
    """
    rows = prefix_rows(sets).join(clusters.withColumnRenamed("v", "cls").withColumnRenamed("label", "cluster"), "cls", "left").withColumn("cluster", F.coalesce("cluster", "cls"))
    rows = spool(rows, "prefixes")
    per = rows.groupBy("code", "cluster").count().groupBy("code").agg(F.max_by("cluster", F.struct("count", "cluster")).alias("main"), F.count("*").alias("k"))
    cross = spool(per.filter("k > 1").select("code", "main"), "crossing")
    rows = spool(rows.join(cross, "code"), "crossing-rows")
    left = rows.filter("cluster != main").select("code", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("cluster").alias("c_a"))
    right = rows.select("code", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), F.col("cluster").alias("c_b"), (F.col("cluster") == F.col("main")).alias("in_main"))
    able: Column = (F.least("left_a", "left_b") * (TOP + DOWN) >= (F.col("n_a") + F.col("n_b")) * TOP) & (F.col("c_a") != F.col("c_b")) & (F.col("in_main") | (F.col("a") < F.col("b")))
    return left.join(right, "code").filter(able).select("a", "b").distinct()


def read_again(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is among keys; the texts are not shuffled where the keys are few."""
    keys = spool(keys, "keys")
    few = keys.count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, "key", "left_semi")


def near_duplicates(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        every, classes, member = _components(numbered(docs, id_col, text_col), n)
        if member is None:
            merged = classes.select("cls", F.col("least").alias("component_id"), "copies")
        else:
            best = spool(member.groupBy("label").agg(F.min("least").alias("component_id")), "best")
            named = member.join(best, "label").select(F.col("v").alias("cls"), "component_id")
            merged = classes.join(named, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id"), "copies")
        merged = spool(merged, "component")
        some = join_split(every.filter("cls is not null"), merged, "cls", "copies", every.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return some.unionByName(every.filter("cls is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def class_sets(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows with their class, classes, ordered sets of the classes that can have links, if any); rows have key, doc_id, text."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1))
    rows = rows.select("key", "doc_id", "text")
    every = spool(class_rows(rows, n), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key"))
    per = every.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), first.alias("first"), F.min("n").alias("n"), F.min("short").alias("short"), F.count("*").alias("copies"))
    classes = spool(per, "class")
    shared = shared_counts(smallest_rows(rows.select("text"), n, buckets), buckets)
    able = spool(classes.join(shared, "short").filter(F.col("shared") >= F.greatest(F.lit(1), F.floor((F.col("n") + 9) / 10))).select("key"), "able")
    if able.isEmpty():
        return every, classes, None
    chunks = spool(chunk_rows(read_again(rows.select("key", "text"), able).select("text"), n), "chunks")
    return every, classes, spool(ordered_sets(chunks, chunk_counts(chunks, buckets)), "sets")


def _components(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows with their class, classes, classes v that have links with their component's label, if any)."""
    every, classes, sets = class_sets(rows, n)
    if sets is None:
        return every, classes, None
    near = [spool(trie_join(central_pairs(sets, k), sets), "near") for k in range(ROUNDS)]
    near = reduce(DataFrame.unionByName, near)
    clusters = components(near)
    links = near.unionByName(spool(trie_join(crossing_pairs(sets, clusters), sets), "links"))
    if links.isEmpty():
        return every, classes, None
    member = components(links).join(classes.withColumnRenamed("cls", "v"), "v").select("v", "label", "least", "first")
    return every, classes, spool(member, "members")


def keep_representatives(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: its smallest id, null only if all are.

    One row stands for each component, also among rows equal in all columns. Rows without words stand for themselves.
    Rows are known by file and place, and those that go are few beside those that stay.
    """
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        rows = numbered(docs, id_col, text_col, row=True)
        every, classes, member = _components(rows, n)
        kept = classes.select("cls", "first.key")
        if member is not None:
            kept = classes.join(member.select(F.col("v").alias("cls")), "cls", "left_anti").select("first.key").unionByName(member.groupBy("label").agg(F.min("first").alias("first")).select("first.key"))
        gone = every.filter("cls is not null").join(spool(kept.select("key"), "kept"), "key", "left_anti")
        return without(rows, gone).select("row.*")


def similar_sets(docs: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): all pairs a < b of classes that link, and doc_id, n_shingles, cls of every row.

    Classes within one cluster are compared too, so a group of many different near copies gives as many pairs as it has
    links. Rows of one class (copies) are linked by their membership and not expanded.
    """
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        every, _, sets = class_sets(numbered(docs, id_col, text_col), n)
        members = every.select("doc_id", F.col("n").alias("n_shingles"), "cls")
        if sets is None:
            return every.select(F.col("cls").alias("a"), F.col("cls").alias("b")).limit(0), members
        return trie_join(prefix_pairs(spool(prefix_rows(sets), "prefixes")), sets), members


def prefix_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of classes that share a prefix code, by lengths and positions able to link."""
    left = rows.select("code", F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    right = rows.select("code", F.col("cls").alias("b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    able = (F.col("a") < F.col("b")) & (F.least("left_a", "left_b") * (TOP + DOWN) >= (F.col("n_a") + F.col("n_b")) * TOP)
    return left.join(right, "code").filter(able).select("a", "b").distinct()
