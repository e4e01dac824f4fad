"""Collocations against plain code."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from attestry.llm import collocations as co

UPPER = {k: k + 32 for k in range(65, 91)}


def by_hand(rows, least, longest, top, scale=2_000_000):
    found, n = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            ws = [w for w in re.split("[ \t]", piece) if w]
            n[lang or "und"] += len(ws)
            for m in range(1, longest + 1):
                found[lang or "und"].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in found.items():
        known, longer = {p: k for p, k in f.items() if k >= least}, {}
        for p, k in known.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer.get(p[i : i + m], 0), k)
        scored = []
        for p, a in known.items():
            if len(p) > 1 and 100 * longer.get(p, 0) < 80 * a:
                score, _, l, r = min((scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -score) for k, (score, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def texts(seed, n):
    r = random.Random(seed)
    words = ["the", "Of", "new", "york", "city", "\u00e9t\u00e9", "a", "x" * 300, "in", "fact"] + [f"w{k}" for k in range(60)]
    rows = []
    for k in range(n):
        t = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))
        rows.append((k if k % 5 else None, r.choice(["en", "de", None]), t + r.choice(["", " new york city in fact", "the new york city. the new"])))
    return rows + [(1, "en", None), (2, "fr", ""), (3, "en", "york")] + rows[:20]


def found(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("least, longest, top, small", [(3, 4, 2000, False), (4, 3, 7, True)])
def test_against_plain_code(spark, monkeypatch, least, longest, top, small):
    """Small: several vocabularies and tries, many chunks and a small radix."""
    if small:
        for name, value in (("MOST_WORDS", 50), ("MOST_CANDIDATES", 60), ("CHUNK", 300), ("DIGIT_BITS", 3)):
            monkeypatch.setattr(co, name, value)
    rows = texts(least, 250)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(5)
    assert found(co.collocations(df, least, longest, top)) == by_hand(rows, least, longest, top)


def test_long_text_clashing_columns_and_nothing_frequent(spark):
    long = ". ".join("alpha beta gamma" for _ in range(400_000))
    rows = [(1, "en", long), (2, "en", "alpha beta")]
    df = spark.createDataFrame([(*r, 1, "x", [2]) for r in rows], "doc_id long, lang string, text string, all int, word string, w array<int>")
    assert found(co.collocations(df)) == by_hand(rows, 30, 4, 2000)
    assert found(co.collocations(df.limit(0))) == [] and found(co.collocations(df.filter("doc_id = 2"))) == []


def test_trie_finds_what_it_holds():
    r = np.random.default_rng(1)
    grams = np.unique(r.integers(0, 3000, (5000, 3)) ** 2 // 3000, axis=0).astype(np.int32)
    trie = co.Trie(grams, np.arange(len(grams)), 2)
    ids = r.integers(-1, 3000, 20_000).astype(np.int32)
    for k in range(0, 300, 3):
        ids[50 * k : 50 * k + 3] = grams[r.integers(len(grams))]
    want = {tuple(g): k for k, g in enumerate(grams.tolist())}
    at, name = trie.phrases(ids)
    assert dict(zip(at.tolist(), name.tolist())) == {i: want[tuple(ids[i : i + 3].tolist())] for i in range(len(ids) - 2) if tuple(ids[i : i + 3].tolist()) in want}
