"""License scans: an exact set-similarity join of text blocks with license templates.

A template of m words is sought in blocks of m + m // 2 consecutive words, one beginning at every word of the text (line
ends do not matter; a shorter text is one block). A block meets a template when it holds at least THRESHOLD of the
template's distinct tokens and all words that the template must have (a name, a version). Tokens are the words of a
license body, whose many words are a mark of their own, and the pairs of neighbouring words of a statement of up to
STATEMENT_WORDS words: a sentence with a statement's words in another order, or with others between them, says
something else.

The templates' tokens are ordered by how many texts of the whole table hold them, rarest first (counted in a first
pass). A block can only meet template T if it holds one of the first |T| - ceil(THRESHOLD * |T|) + 1 of T's tokens (prefix
filter), so only blocks around such a token are looked at; a text needs ceil(THRESHOLD * |T|) of T's distinct tokens
(length filter), and enough of T's tokens must follow, in the global order, the first one that the blocks around a
place share (positional filter). The blocks that are left are compared in full, by a count that slides over the text.

Defined results: a null text counts as empty; an empty text has no words, no labels and score 0. Repeated rows each
get their row; rows with a null id are scanned like others; an empty table gives no rows. The templates and phrases
are fixed, so what is broadcast does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: A template of up to so many words is compared by pairs of neighbouring words.
STATEMENT_WORDS = 20
#: Phrases that give a label wherever their words stand consecutively.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Fixed values: (label, words that a block must hold, text of the license or of its usual statement).
TEMPLATES = (
    ("apache-2.0", "apache 2", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache 2", "licensed under the apache 2 0 license"),
    ("gpl-3", "gnu 3", "this work is licensed under the gnu general public license version 3"),
    ("mit", "mit", "released under the mit license"),
    ("cc-by-nc", "cc nc", "licensed under cc by nc 4 0"),
    ("mit-grant", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit-text", "hereby granted sublicense", (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software")),
    ("bsd-terms", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-text", "redistributions binary", (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce "
        "the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution")),
    ("bsd-3", "neither endorse", (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission")),
    ("isc", "fee hereby", (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies")),
    ("apache-notice", "apache compliance", (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www "
        "apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
        "warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license")),
    ("gpl-notice", "gnu redistribute", (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even "
        "the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details")),
    ("mpl-2.0", "mozilla mpl 2", (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http "
        "mozilla org mpl 2 0")),
    ("unlicense", "unencumbered", (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source "
        "code form or as a compiled binary for any purpose commercial or non commercial and by any means")),
)
#: Byte table: A-Z to lower case, bytes that no word holds to a space.
TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
VOCABULARY = frozenset(w.encode() for _, _, t in TEMPLATES for w in t.split())


def run_length(text: str) -> int:
    """Words of a template's token."""
    return 2 if len(text.split()) <= STATEMENT_WORDS else 1


def runs(words: list[bytes], n: int) -> list[bytes]:
    """All runs of n (1 or 2) consecutive words, in order."""
    return words if n == 1 else [a + b" " + b for a, b in zip(words, words[1:])]


TOKENS = frozenset(x for _, _, t in TEMPLATES for x in runs(t.encode().split(), run_length(t)))
#: (token, its words) of tokens that are pairs.
PAIRS = tuple((x, frozenset(x.split())) for x in sorted(TOKENS) if b" " in x)


def held_tokens(words: list[bytes]) -> set[bytes]:
    """The templates' words and pairs that a text holds."""
    held = set(VOCABULARY.intersection(words))
    if able := [x for x, both in PAIRS if both <= held]:
        joined = b" " + b" ".join(words) + b" "
        held.update(x for x in able if b" " + x + b" " in joined)
    return held


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many texts hold each token of the templates."""
    n = dict.fromkeys(sorted(TOKENS), 0)
    for batch in batches:
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            for x in TOKENS & held_tokens((text or b"").translate(TO_WORDS).split()):
                n[x] += 1
    yield pa.RecordBatch.from_pydict({"token": pa.array([x.decode() for x in n]), "n": pa.array(n.values(), pa.int64())})


def token_counts(texts: DataFrame) -> dict[str, int]:
    """Texts per template token over the whole table; as many rows as the templates have tokens."""
    return {r.token: r.n for r in texts.mapInArrow(count_tokens, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}


def block_words(text: str) -> int:
    """Words of a block that a template is sought in."""
    m = len(text.split())
    return m + m // 2


class Template:
    """A template's tokens in the global order, with what a block needs of them."""

    def __init__(self, label: str, must: str, text: str, counts: dict[str, int]) -> None:
        self.label, self.must, self.run = label, frozenset(must.encode().split()), run_length(text)
        self.block = block_words(text) - self.run + 1  # tokens of a block
        self.tokens = sorted(set(runs(text.encode().split(), self.run)), key=lambda x: (counts.get(x.decode(), 0), x))
        self.place = {x: k for k, x in enumerate(self.tokens)}
        self.need = math.ceil(THRESHOLD * len(self.tokens) - 1e-9)
        self.prefix = frozenset(self.tokens[: len(self.tokens) - self.need + 1])

    def best(self, words: list[bytes], held: set[bytes]) -> float:
        """The largest share of the template that a block of these words holds, 0 where none meets it. held: held_tokens of the words."""
        if not self.must <= held or self.prefix.isdisjoint(held) or sum(x in held for x in self.tokens) < self.need:
            return 0.0
        best, found = 0, runs(words, self.run)
        for lo, hi in self.around(found):
            least = min(self.place.get(x, len(self.tokens)) for x in found[lo:hi])
            if len(self.tokens) - least >= self.need:
                best = max(best, self.slide(found[lo:hi], words[lo : hi + self.run - 1]))
        return best / len(self.tokens)

    def around(self, found: list[bytes]) -> list[tuple[int, int]]:
        """Stretches of tokens that hold all blocks with a prefix token."""
        out: list[tuple[int, int]] = []
        for k, x in enumerate(found):
            if x in self.prefix:
                lo, hi = max(0, k - self.block + 1), min(len(found), k + self.block)
                if out and lo <= out[-1][1]:
                    out[-1] = (out[-1][0], hi)
                else:
                    out.append((lo, hi))
        return out

    def slide(self, found: list[bytes], words: list[bytes]) -> int:
        """The most distinct template tokens of a block among those that meet the template; 0 if none does."""
        count, best = {}, 0
        for k, x in enumerate(found):
            if x in self.place:
                count[x] = count.get(x, 0) + 1
            gone = found[k - self.block] if k >= self.block else None
            if gone in count:
                count[gone] -= 1
                if not count[gone]:
                    del count[gone]
            if len(count) > best and len(count) >= self.need and self.must.issubset(words[max(0, k - self.block + 1) : k + self.run]):
                best = len(count)
        return best


def phrase_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(index of the first word, label) of each phrase."""
    joined, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES:
        sought, at, since, k = f" {phrase} ".encode(), -1, 0, 0
        while (at := joined.find(sought, at + 1)) >= 0:
            k += joined.count(b" ", since, at)  # words since the last place
            since = at
            out.append((k, label))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    counts = token_counts(rows.select("text"))
    templates = [Template(*t, counts) for t in TEMPLATES]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
        for batch in batches:
            out: dict[str, list] = {k: [] for k in names}
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                words = (text or b"").translate(TO_WORDS).split()
                places = phrase_places(words)
                held, shares = held_tokens(words), {}
                for t in templates:
                    if share := t.best(words, held):
                        shares[t.label] = max(share, shares.get(t.label, 0.0))
                base = {label for _, label in places}
                first, last = (min(places)[0], max(places)[0]) if places else (None, None)
                row = (len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | shares.keys())), 1.0 if base else max(shares.values(), default=0.0))
                for name, value in zip(names, row):
                    out[name].append(value)
            kinds = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{k: pa.array(out[k], t) for k, t in zip(names, kinds)}})

    return rows.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
