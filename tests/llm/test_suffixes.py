"""Suffix dedup against plain code."""

import hashlib
import random
from collections import Counter

import pytest

from attestry.llm import suffixes


def by_hand(texts, window):
    data = [(t or "").encode() for t in texts]
    found = Counter(b[i : i + window] for b in data for i in range(len(b) - window + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if found[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts_with_repeats(seed):
    r = random.Random(seed)
    base = ["".join(r.choice("ab\u00e9 ") for _ in range(r.randint(0, 800))) for _ in range(6)]
    texts = [None, "", "x" * 900, "ab" * 500, "\u00e9" * 300]
    for _ in range(40):
        t, own = r.choice(base), "".join(r.choice("abcdefgh") for _ in range(r.randint(0, 40)))
        a = r.randint(0, len(t))
        texts.append(own + t[a : r.randint(a, len(t))] + own[::-1] + r.choice(base)[: r.randint(0, 400)])
    return texts + texts[5:9]


def found(df, window):
    return sorted(tuple(x)[1:] for x in suffixes.remove_repeated_bytes(df, window).collect())


@pytest.mark.parametrize("window, piece, chunk, bucket", [(4, 300, 50, 1000), (24, 128, 10, 500), (200, 300, 50, 12_000_000), (200, 1 << 20, 400_000, 3000)])
def test_against_plain_code(spark, monkeypatch, window, piece, chunk, bucket):
    """Small pieces, chunks and buckets cut runs, combine within tasks and deal names by digest."""
    for name, value in (("PIECE", piece), ("CHUNK", chunk), ("BUCKET_BYTES", bucket), ("MOST_PARTS", 3)):
        monkeypatch.setattr(suffixes, name, value)
    texts = texts_with_repeats(window + piece)
    docs = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert found(docs, window) == by_hand(texts, window)


def test_a_passage_in_very_many_texts(spark, monkeypatch):
    """The edges of a passage that many texts share have one name and many digests."""
    monkeypatch.setattr(suffixes, "CHUNK", 200)
    r = random.Random(3)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = ["".join(r.choice("klmnop ") for _ in range(r.randint(0, 90))) + passage + "".join(r.choice("rstuv ") for _ in range(r.randint(0, 90))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    assert found(docs, 200) == by_hand(texts, 200)


def test_found_spans_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", 0)
    texts = texts_with_repeats(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert found(docs, 60) == by_hand(texts, 60)
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.without_repeated_bytes(docs, 60).collect()}
    assert len(kept) == len(texts) and sorted(hashlib.sha256(k).hexdigest() for k in kept.values()) == sorted(x[3] for x in by_hand(texts, 60))


def test_long_text_empty_table_and_clashing_columns(spark):
    r = random.Random(1)
    long = "".join(r.choice("abcdefghij ") for _ in range(3_000_000))
    docs = spark.createDataFrame([(1, long, "k", b"", 5), (2, "Q" * 12 + long[1_500_000:1_500_400], "p", b"", 6), (3, None, None, None, None)], "doc_id long, text string, key string, spans binary, place long")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.remove_repeated_bytes(docs).collect()}
    assert rows == {1: (3_000_000, 400, 1), 2: (412, 400, 1), 3: (0, 0, 0)}
    assert suffixes.remove_repeated_bytes(docs.limit(0)).collect() == []
