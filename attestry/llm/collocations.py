"""Phrase collocations: phrases of a language that are frequent, with how far they are more than their parts.

Words are counted by a shuffle, exactly; those that are frequent get numbers, and texts become arrays of numbers, once.
Longer phrases are then counted level by level. A phrase can only be frequent if its parts are, so a candidate of n words
has a frequent beginning of n - 1 words (found by the trie of the level before), a frequent end of n - 1 words (a semi
join), and stands in the texts often enough for its bucket: a hashed count over all texts that is never too low. The
candidates go to a double-array trie, which is broadcast; numpy moves the states of all places of a text on together,
word by word, bincount sums the accepting states, and the sums of all tasks are added up. So counts are exact, and
buckets only decide what is counted.

A trie holds at most MOST_CANDIDATES phrases and a vocabulary at most MOST_WORDS words; more are taken in further passes
over the number arrays, with tries and vocabularies of that size. A word's number is written in digits, a trie's labels.

Words are known by 64-bit hashes salted with the language while texts are turned into numbers, by themselves when they
are counted. Defined results: a null text is empty, a null language `und`. Repeated rows and rows with a null id count
like all others. An empty table, or one without frequent phrases, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_text import Words, mix, slices, words
from .shared import ranked, settings, spool

LEAST, LONGEST, TOP, SCALE = 30, 4, 2000, 2_000_000
#: A phrase goes where so many of a hundred of its places lie inside a longer one's.
COVERED = 80
MOST_WORDS, MOST_CANDIDATES = 1 << 21, 1 << 20
#: Buckets (as bits) at least and at most, and words of text for which there is one.
LEAST_BITS, MOST_BITS, BUCKET_WORDS = 16, 27, 4
#: Values that a task sums up before it sends them, and slots that are summed up together.
CHUNK, CELL_BITS = 1_000_000, 16
SLICE_BYTES, BATCH_ROWS = 1 << 20, "500"
DIGIT_BITS = 8
#: Words end at these; phrases do not go beyond the second ones.
IS_BLANK, IS_BREAK = np.zeros(256, bool), np.zeros(256, bool)
IS_BLANK[[0x20, 0x09]] = True
IS_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
COUNTED = "cell int, slots binary, counts binary"


def language_salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A very long text in parts that end where a phrase must; others as they are."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        to = at + SLICE_BYTES
        while to < len(data) and not (here := np.flatnonzero(IS_BREAK[data[to : to + SLICE_BYTES]])).size:
            to += SLICE_BYTES
        to = len(data) if to >= len(data) else to + int(here[0]) + 1
        yield data[at:to], np.array([0, to - at])
        at = to


def batch_words(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, np.ndarray, list[str]]]:
    """Words of (lang, text) rows, with the number of each word's language, whether a phrase may not go on before it, and the languages."""
    names = batch.column("lang").to_pylist()
    langs = sorted(set(names))
    places = {x: k for k, x in enumerate(langs)}
    number = np.array([places[x] for x in names], np.int64)
    for lo, hi, data, offsets in slices(batch.column("text"), SLICE_BYTES):
        for part, at in cut_pieces(data, offsets):
            w = words(part, at, lower=True, separators=IS_BLANK | IS_BREAK)
            if len(w.hash):
                text = w.text_of_word()
                breaks = np.concatenate([[0], np.cumsum(IS_BREAK[part])])[w.start]
                new = np.ones(len(text), bool)
                new[1:] = (np.diff(text) != 0) | (np.diff(breaks) != 0)
                yield w, number[lo:hi][text], new, langs


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w, lang, _, langs in batch_words(batch):
                salts = np.array([language_salt(x) for x in langs], np.uint64)
                _, at, times = np.unique(mix(w.hash ^ salts[lang]), return_index=True, return_counts=True)
                found = [w.data[a:b].tobytes() for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]
                yield pa.RecordBatch.from_pydict({"lang": pa.array([langs[k] for k in lang[at].tolist()], pa.string()), "word": pa.array(found, pa.binary()).cast(pa.string()), "f": pa.array(times, pa.int64())})

    return docs.mapInArrow(count, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def word_codes(vocabulary: DataFrame) -> DataFrame:
    """(code, id): the hashes by which words are found in texts."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, _, data, offsets = next(slices(batch.column("word"), 1 << 62))
                w = words(data, offsets, separators=IS_BLANK | IS_BREAK)
                salts = {x: language_salt(x) for x in set(batch.column("lang").to_pylist())}
                salt = np.array([salts[x] for x in batch.column("lang").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_pydict({"code": pa.array(mix(w.hash ^ salt).view(np.int64)), "id": batch.column("id")})

    return vocabulary.select("lang", "word", "id").mapInArrow(code, "code long, id int")


def number_arrays(docs: DataFrame, vocabulary: DataFrame, n: int) -> DataFrame:
    """(ids): the texts as numbers of frequent words, -1 where a phrase may not go on. A long vocabulary is looked up part by part."""
    codes = spool(word_codes(vocabulary), "codes")
    parts = -(-n // MOST_WORDS)

    def looked_up(k: int) -> Callable[[np.ndarray], np.ndarray]:
        found = codes.filter((F.col("id") >= k * MOST_WORDS) & (F.col("id") < (k + 1) * MOST_WORDS)).toArrow()  # at most MOST_WORDS rows
        code, ids = found["code"].to_numpy().view(np.uint64), found["id"].to_numpy()
        order = np.argsort(code)
        code, ids = code[order], ids[order].astype(np.int32)

        def look_up(x: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(code, x), len(code) - 1)
            return np.where(code[at] == x, ids[at], np.int32(-1))

        return look_up

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for w, lang, new, langs in batch_words(batch):
                yield mix(w.hash ^ np.array([language_salt(x) for x in langs], np.uint64)[lang]), new

    def row(ids: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
        ids = np.insert(ids, np.flatnonzero(new), np.int32(-1))
        alone = ids < 0  # and words between two breaks, which begin no phrase
        alone[1:-1] |= (ids[:-2] < 0) & (ids[2:] < 0)
        alone[-1:] |= ids[-2:-1] < 0
        keep = ~alone
        keep[1:] |= alone[1:] & ~alone[:-1]
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids[keep].astype("<i4").tobytes()], pa.binary())}) if keep.any() else None

    if parts == 1:
        look_up = looked_up(0)

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for code, new in hashed(batches):
                if (out := row(look_up(code), new)) is not None:
                    yield out

        return spool(docs.mapInArrow(numbers, "ids binary"), "numbers")

    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for code, new in hashed(batches):
            yield pa.RecordBatch.from_pydict({"codes": pa.array([code.tobytes()], pa.binary()), "new": pa.array([new.tobytes()], pa.binary()), "ids": pa.array([np.full(len(code), -1, "<i4").tobytes()], pa.binary())})

    rows = spool(docs.mapInArrow(unknown, "codes binary, new binary, ids binary"), "unknown")
    for k in range(parts):
        look_up = looked_up(k)

        def fill(batches: Iterator[pa.RecordBatch], look_up=look_up) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.to_pylist():
                    ids = np.maximum(np.frombuffer(x["ids"], "<i4"), look_up(np.frombuffer(x["codes"], "<u8")))
                    yield pa.RecordBatch.from_pydict({"codes": pa.array([x["codes"]], pa.binary()), "new": pa.array([x["new"]], pa.binary()), "ids": pa.array([ids.astype("<i4").tobytes()], pa.binary())})

        rows = spool(rows.mapInArrow(fill, "codes binary, new binary, ids binary"), "unknown")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                if (out := row(np.frombuffer(x["ids"], "<i4"), np.frombuffer(x["new"], bool))) is not None:
                    yield out

    return spool(rows.mapInArrow(finished, "ids binary"), "numbers")


class Trie:
    """Double array: from state s, label x leads to t = base[s] + x if check[t] == s. Phrases are rows of grams (word numbers); accept has a phrase's name by its last state."""

    def __init__(self, grams: np.ndarray, names: np.ndarray, digits: int):
        self.digits, self.words, self.bits = digits, grams.shape[1], DIGIT_BITS
        width = 1 << DIGIT_BITS
        label = np.stack([(grams[:, j // digits] >> (DIGIT_BITS * (digits - 1 - j % digits))) & (width - 1) for j in range(digits * self.words)], 1).astype(np.int64)
        order = np.lexsort(label.T[::-1])
        label = label[order]
        n, taken, chance = len(label), 1, np.random.Generator(np.random.PCG64(7))
        self.base, self.check = np.zeros(2 * width, np.int32), np.full(2 * width, -1, np.int32)  # state 0 is the root; slots below width stay free, so bases are not negative
        state, new = np.zeros(n, np.int64), np.zeros(n, bool)
        new[:1] = True
        for j in range(label.shape[1]):
            here = new.copy()
            here[1:] |= label[1:, j] != label[:-1, j]  # rows where a child begins; new: where its parent does
            child = np.flatnonzero(here)
            parent = np.cumsum(new[child]) - 1
            taken += len(child)
            self.grow(int(1.5 * taken) + 4 * width)
            slot = self.place(state[np.flatnonzero(new)], parent, label[child, j], chance)
            state, new = slot[np.cumsum(here) - 1], here
        self.grow(len(self.base) + width)  # a look beyond the last child stays inside
        self.accept = np.full(len(self.base), -1, np.int32)
        self.accept[state] = names[order]
        self.size = int(names.max()) + 1

    def grow(self, size: int) -> None:
        more = size - len(self.base)
        if more > 0:
            self.base = np.concatenate([self.base, np.zeros(more, np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])

    def place(self, states: np.ndarray, parent: np.ndarray, label: np.ndarray, chance: np.random.Generator) -> np.ndarray:
        """Slots of the children. Parents of about as many children try bases all at once, the widest first: those whose
        slots are free and wanted by no other stay, the rest try again, and in the end go behind the table."""
        width, count = 1 << DIGIT_BITS, np.bincount(parent, minlength=len(states))
        base = np.zeros(len(states), np.int64)
        taken = self.check >= 0
        taken[:width] = True
        wide = int(count.max(initial=1))
        while wide > 1:
            low = wide // 2 if wide > 2 else 1
            left = np.flatnonzero((count <= wide) & (count > low))
            for _ in range(40):
                if not len(left):
                    break
                base[left] = chance.integers(0, len(taken) - width, len(left))
                wanted = np.zeros(len(states), bool)
                wanted[left] = True
                mine = np.flatnonzero(wanted[parent])
                slot = base[parent[mine]] + label[mine]
                claim = np.empty(len(taken), np.int32)
                claim[slot] = parent[mine]
                bad = np.bincount(parent[mine], taken[slot] | (claim[slot] != parent[mine]), minlength=len(states)) > 0
                good = mine[~bad[parent[mine]]]
                taken[base[parent[good]] + label[good]] = True
                left = left[bad[left]]
            if len(left):
                top = len(taken)
                base[left] = top + np.arange(len(left)) * width
                self.grow(top + len(left) * width)
                taken = np.concatenate([taken, np.zeros(len(self.check) - len(taken), bool)])
                wanted[:] = False
                wanted[left] = True
                mine = np.flatnonzero(wanted[parent])
                taken[base[parent[mine]] + label[mine]] = True
            wide = low
        single = np.flatnonzero((count == 1)[parent])
        free = np.flatnonzero(~taken)[: len(single)]
        if len(free) < len(single):
            free = np.concatenate([free, np.arange(len(taken), len(taken) + len(single) - len(free))])
            self.grow(int(free[-1]) + 1)
        base[parent[single]] = free - label[single]
        slot = base[parent] + label
        self.base[states] = base
        self.check[slot] = states[parent]
        return slot

    def phrases(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a phrase begins, and its name."""
        at = np.flatnonzero(ids >= 0)
        state = np.zeros(len(at), np.int32)
        mask = np.int32((1 << self.bits) - 1)
        for k in range(self.words):
            word = ids[at + k] if k == 0 else ids[np.minimum(at + k, len(ids) - 1)]
            on = (word >= 0) & (at + k < len(ids))
            at, state, word = at[on], state[on], word[on]
            for j in range(self.digits):
                to = self.base[state] + ((word >> np.int32(self.bits * (self.digits - 1 - j))) & mask)
                on = self.check[to] == state
                at, state, word = at[on], to[on], word[on]
        return at, self.accept[state]


def sent_counts(slots: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rising slots and their counts, in cells."""
    cell = slots >> CELL_BITS
    cut = np.flatnonzero(np.diff(cell, prepend=-1))
    spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(slots)]))
    low, counts = (slots & ((1 << CELL_BITS) - 1)).astype("<u2"), counts.astype("<u4")
    return pa.RecordBatch.from_pydict({"cell": pa.array(cell[cut], pa.int32()), "slots": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())})


def summed_cells(partial: DataFrame, schema: str, out: Callable[[int, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """The cells, each summed over all tasks and then turned into rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in batch.to_pylist():
                total = sums.setdefault(x["cell"], np.zeros(1 << CELL_BITS, np.int64))
                total[np.frombuffer(x["slots"], "<u2")] += np.frombuffer(x["counts"], "<u4")
        for cell, total in sums.items():
            yield out(cell, total)

    return partial.repartition("cell").mapInArrow(add, schema)


def scanned(arrays: DataFrame, schema: str, one: Callable[[np.ndarray], np.ndarray], send: Callable[[np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What `one` finds in each array, sent by some millions."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                held.append(one(np.frombuffer(x, "<i4")))
                n += len(held[-1])
                if n >= CHUNK:
                    yield send(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield send(np.concatenate(held))

    return arrays.mapInArrow(scan, schema)


def pair_keys(trie: Trie | None, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """Name of a frequent phrase of n - 1 words, and the number of the frequent word after it, at all places where there are both."""

    def keys(ids: np.ndarray) -> np.ndarray:
        at, row = trie.phrases(ids) if trie else (np.arange(len(ids)), ids)
        on = at + n - 1 < len(ids)
        at, row = at[on], row[on]
        word = ids[at + n - 1]
        on = (row >= 0) & (word >= 0)
        return (row[on].astype(np.int64) << 32) | word[on]

    return keys


def pairs_in_full_buckets(arrays: DataFrame, trie: Trie | None, n: int, bits: int, least: int) -> DataFrame:
    """(row, word): the pairs of pair_keys whose bucket has at least `least`. Tasks send them packed, by cells of buckets, where each stays once."""
    keys = pair_keys(trie, n)
    bucket = lambda key: (mix(key.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
    packed = lambda cell, total: pa.RecordBatch.from_pydict({"cell": pa.array([cell], pa.int32()), "full": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})
    partial = scanned(arrays, COUNTED, lambda ids: bucket(keys(ids)), lambda found: sent_counts(*np.unique(found, return_counts=True)))
    full = np.zeros((1 << bits) // 8, np.uint8).reshape(-1, (1 << CELL_BITS) // 8)
    for r in summed_cells(partial, "cell int, full binary", packed).collect():  # 1 << MOST_BITS bits at most
        full[r.cell] = np.frombuffer(r.full, np.uint8)
    full = full.ravel()

    def likely(ids: np.ndarray) -> np.ndarray:
        key = keys(ids)
        b = bucket(key)
        return key[((full[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1) > 0]

    def by_cell(key: np.ndarray) -> pa.RecordBatch:
        key = np.unique(key)
        cell = bucket(key) >> CELL_BITS
        order = np.argsort(cell, kind="stable")
        cell, key = cell[order], key[order]
        cut = np.flatnonzero(np.diff(cell, prepend=-1))
        return pa.RecordBatch.from_pydict({"cell": pa.array(cell[cut], pa.int32()), "keys": pa.array([x.astype("<i8").tobytes() for x in np.split(key, cut[1:])] if len(cut) else [], pa.binary())})

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in batch.to_pylist():
                key = np.frombuffer(x["keys"], "<i8")
                held[x["cell"]] = np.union1d(held[x["cell"]], key) if x["cell"] in held else key
        for key in held.values():
            yield pa.RecordBatch.from_pydict({"row": pa.array(key >> 32, pa.int64()), "word": pa.array(key & 0xFFFFFFFF, pa.int32())})

    return scanned(arrays, "cell int, keys binary", likely, by_cell).repartition("cell").mapInArrow(distinct, "row long, word int")


def counted(arrays: DataFrame, trie: Trie, start: int, least: int) -> DataFrame:
    """(number, f) of the trie's phrases that are frequent; numbers begin at start."""
    rows = lambda cell, total: pa.RecordBatch.from_pydict({"number": pa.array(np.flatnonzero(total >= least) + (cell << CELL_BITS) + start, pa.int64()), "f": pa.array(total[total >= least], pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(trie.size, np.int64)
        for batch in batches:
            for x in batch.column("ids").to_pylist():
                total += np.bincount(trie.phrases(np.frombuffer(x, "<i4"))[1], minlength=len(total))
        used = np.flatnonzero(total)
        if len(used):
            yield sent_counts(used, total[used])

    return summed_cells(arrays.mapInArrow(count, COUNTED), "number long, f long", rows)


def in_tries(grams: DataFrame, n: int, total: int, digits: int) -> Iterator[tuple[int, Trie]]:
    """Tries of the phrases (w, number below total), MOST_CANDIDATES numbers at a time; a phrase's name is its number from the first on, which comes too."""
    for start in range(0, total, MOST_CANDIDATES):
        found = grams.filter((F.col("number") >= start) & (F.col("number") < start + MOST_CANDIDATES)).select("number", *[F.col("w")[j].alias(f"w{j}") for j in range(n)]).toArrow()
        if found.num_rows:
            yield start, Trie(np.stack([found[f"w{j}"].to_numpy() for j in range(n)], 1), found["number"].to_numpy() - start, digits)


def frequent_phrases(arrays: DataFrame, vocabulary: DataFrame, n_words: int, total_words: int, least: int, longest: int) -> list[DataFrame]:
    """(w, f) of the frequent phrases of 1, 2, ... words."""
    digits = max(1, -(-n_words.bit_length() // DIGIT_BITS))
    bits = min(MOST_BITS, max(LEAST_BITS, (total_words // BUCKET_WORDS).bit_length()))
    levels = [vocabulary.select(F.array("id").alias("w"), "f", F.col("id").cast("long").alias("number"))]
    total = n_words
    for n in range(2, longest + 1):
        before, found = levels[-1], []
        if n == 2:
            pairs = pairs_in_full_buckets(arrays, None, 2, bits, least)
            found.append(pairs.select(F.array(F.col("row").cast("int"), "word").alias("w")))
        else:
            for start, trie in in_tries(before, n - 1, total, digits):
                pairs = pairs_in_full_buckets(arrays, trie, n, bits, least).select((F.col("row") + start).alias("number"), "word")
                found.append(pairs.join(before.select("number", "w"), "number").select(F.concat("w", F.array("word")).alias("w")))
        likely = reduce(DataFrame.unionByName, found) if found else before.select("w").limit(0)
        ends = before.select(F.col("w").alias("end"))
        likely = spool(likely.withColumn("end", F.slice("w", 2, n - 1)).join(ends, "end", "left_semi").select("w", F.lit(0).alias("all")), "likely")
        candidates = spool(ranked(likely, "all", ["w"], "candidates").select("w", F.col("rank").alias("number")), "candidates")
        total = candidates.count()
        sums = [spool(counted(arrays, trie, start, least), "sums") for start, trie in in_tries(candidates, n, total, digits)]
        if not sums:
            break
        levels.append(spool(candidates.join(reduce(DataFrame.unionByName, sums), "number"), "phrases"))
    return [x.select("w", "f") for x in levels]


def scored(levels: list[DataFrame], scale: int) -> DataFrame:
    """(w, a, l, r, score) of phrases of two words and more that are not covered by longer ones."""
    known, phrases = reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, levels[1:])
    cuts = phrases.select("w", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("w", F.lit(1), F.col("k"))).withColumn("right", F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")))
    cuts = cuts.join(known.select(F.col("w").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("w").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"({scale} * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)").cast("long")
    best = cuts.withColumn("score", score).groupBy("w").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    parts = [F.slice("w", at + 1, m) for n in range(3, len(levels) + 1) for m in range(2, n) for at in range(n - m + 1)]
    sizes = [n for n in range(3, len(levels) + 1) for m in range(2, n) for _ in range(n - m + 1)]
    inside = phrases.filter(F.size("w") > 2).select("f", F.explode(F.array_compact(F.array(*[F.when(F.size("w") == n, p) for n, p in zip(sizes, parts)]))).alias("w")) if parts else None
    out = best.select("w", "a", "best.l", "best.r", "best.score")
    if inside is None:
        return out
    longer = inside.groupBy("w").agg(F.max("f").alias("longer"))
    hundred = F.lit(100).cast("decimal(20, 0)")
    return out.join(longer, "w", "left").filter(F.col("longer").isNull() | (hundred * F.col("longer") < F.lit(COVERED).cast("decimal(20, 0)") * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, scale: int = SCALE, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the first `top` phrases."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=BATCH_ROWS):
        each = spool(count_words(texts), "words")
        totals = spool(each.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        frequent = spool(each.filter(F.col("f") >= least).withColumn("all", F.lit(0)), "frequent")
        vocabulary = spool(ranked(frequent, "all", ["lang", "word"], "vocabulary").select("lang", "word", "f", F.col("rank").cast("int").alias("id")), "vocabulary")
        n_words, total_words = vocabulary.count(), totals.agg(F.sum("n")).first()[0] or 0
        schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
        if not n_words:
            return spark.createDataFrame([], schema)
        arrays = number_arrays(texts, vocabulary, n_words)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="16"):
        levels = frequent_phrases(arrays, vocabulary, n_words, total_words, least, longest)
    if len(levels) == 1:
        return spark.createDataFrame([], schema)
    kept = spool(scored(levels, scale), "scored")
    spelled = kept.select("w", F.posexplode("w").alias("at", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("w").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = kept.join(spelled, "w").withColumn("phrase", F.array_join(F.col("words.word"), " "))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
