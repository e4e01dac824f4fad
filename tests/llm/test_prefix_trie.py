"""The conversation trie against plain code."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from attestry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(first, [])[:h] + ts[h:]
    nodes = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].encode().split()) if p else 0)
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((min(cs), len(p), min(nodes[p[:-1]]) if p else -1, len(cs), len(kids[p]), leaves[p], saved[p], sha(sorted(c for c in cs if len(whole[c]) == len(p)))) for p, cs in nodes.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed, n, words=3, turns=6):
    r = random.Random(seed)
    rows = []
    for c in range(-5, n):
        if c % 20 and r.random() < 0.1:
            continue
        for k in range(r.randint(1, turns)):
            rows.append((c, k, r.choice(["user", "assistant", None]) if r.random() < 0.1 else "user", " ".join(r.choice("abc") for _ in range(r.randint(0, words)))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [16, 3])
def test_against_plain_code(spark, monkeypatch, bits):
    """With 8 counters a row, nearly all estimates are wrong: more is grouped, nothing changes."""
    if bits == 3:
        monkeypatch.setattr(prefix_trie, "LEAST_BITS", 3)
        monkeypatch.setattr(prefix_trie, "MOST_BITS", 3)
        monkeypatch.setattr(prefix_trie, "CELLS", 8)
    rows = conversations(1, 90, words=1) + conversations(2, 70, words=6) + [(None, 1, "user", "no one"), (7, None, "user", "first"), (8, None, None, None), (8, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(prefix_trie.conversation_trie(df)) == by_hand(rows)
    assert found(prefix_trie.plain_trie(df)) == by_hand(rows, rebuild=False)


def test_a_conversation_with_a_third_of_the_rows(spark):
    rows = conversations(4, 40) + [(c, k, "user", f"t{k} x") for c in (100, 101) for k in range(300)] + [(102, 3, "user", "same")] * 50
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(prefix_trie.conversation_trie(df)) == by_hand(rows)


def test_turnless_absent_and_empty(spark):
    alone = [(c, 0, "user", "x") for c in range(41, 60)]  # the group's first one is absent
    df = spark.createDataFrame(alone, SCHEMA)
    assert found(prefix_trie.conversation_trie(df)) == by_hand(alone)
    assert found(prefix_trie.conversation_trie(df.limit(0))) == []


def test_clashing_columns(spark):
    rows = [(c, k, "user", "a b", "p", "q", 5, 6) for c in range(3) for k in range(3)]
    df = spark.createDataFrame(rows, SCHEMA + ", p string, q string, depth int, length int")
    assert found(prefix_trie.conversation_trie(df)) == by_hand(rows)
