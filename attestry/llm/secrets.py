"""Secret scans with one deterministic automaton for all rules.

The rules' regular expressions are made into one NFA, determinised by subset construction over byte classes and
minimised; the transition array then scans each text once, byte by byte, for all rules together, and marks where
matches end. An automaton of the reversed expressions, made the same way, runs backwards from each end to the match's
start. Matches of one rule don't overlap and the leftmost is taken first; matches that are too short are dropped.

Defined results: a null text counts as empty; empty texts have no spans. Spans are in code points. Repeated rows each
get their row; an empty table gives no rows; rows with a null id are scanned like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame

#: (kind, expression, characters that the last group or else the match has at least). Fixed values; the first three are the base.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"AKIA[A-Z0-9]+", 18),
    ("hex", r"[0-9a-f]{16,}", 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 24),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
)
BASE = 3


class Nfa:
    """States with byte-set edges and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, items, at: int, backwards: bool) -> int:
        """Append a parsed expression to state at; the state it ends in."""
        for op, arg in reversed(items) if backwards else items:
            name = str(op)
            if name in ("LITERAL", "IN", "ANY", "NOT_LITERAL"):
                to = self.state()
                self.edges[at].append((byte_set(name, arg), to))
                at = to
            elif name == "SUBPATTERN":
                at = self.add(arg[3], at, backwards)
            elif name == "BRANCH":
                to = self.state()
                for part in arg[1]:
                    go = self.state()
                    self.empty[at].append(go)
                    self.empty[self.add(part, go, backwards)].append(to)
                at = to
            elif name == "MAX_REPEAT":
                least, most, body = arg
                for _ in range(least):
                    at = self.add(body, at, backwards)
                if most == _parser.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(body, loop, backwards)].append(loop)
                    at = loop
                else:
                    out = self.state()
                    for _ in range(most - least):
                        self.empty[at].append(out)
                        at = self.add(body, at, backwards)
                    self.empty[at].append(out)
                    at = out
            else:
                raise ValueError(f"rules can't use {name}")
        return at

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


def byte_set(name: str, arg) -> frozenset:
    if name == "LITERAL":
        return frozenset([arg])
    if name == "NOT_LITERAL":
        return frozenset(range(256)) - {arg}
    if name == "ANY":
        return frozenset(range(256)) - {10}
    out: set[int] = set()
    for op, x in arg:
        out |= set(range(x[0], x[1] + 1)) if str(op) == "RANGE" else {x} if str(op) == "LITERAL" else set()
    return frozenset(range(256)) - out if str(arg[0][0]) == "NEGATE" else frozenset(out)


@dataclass
class Automaton:
    """step[state + class]: the next state, states being multiples of the number of classes; from accepting on, states accept."""

    classes: bytes
    step: list[int]
    start: int
    accepting: int
    accepts: dict[int, tuple[int, ...]]
    dead: int = -1


def compile_rules(expressions: list[str], backwards: bool = False) -> Automaton:
    """The minimal automaton of all expressions; forwards a match may start anywhere, backwards it starts at the first byte."""
    nfa = Nfa()
    root = nfa.state()
    final = {}
    for k, text in enumerate(expressions):
        go = nfa.state()
        nfa.empty[root].append(go)
        final[nfa.add(list(_parser.parse(text)), go, backwards)] = k
    if not backwards:
        nfa.edges[root].append((frozenset(range(256)), root))
    sets = list({s for edges in nfa.edges for s, _ in edges})
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = [classes.index(c) for c in range(len(kinds))]

    numbers: dict[frozenset, int] = {nfa.closure([root]): 0}
    order, table = list(numbers), []
    for states in order:  # grows as it goes
        row = []
        for b in sample:
            to = nfa.closure({x for q in states for s, x in nfa.edges[q] if b in s})
            if to not in numbers:
                numbers[to] = len(numbers)
                order.append(to)
            row.append(numbers[to])
        table.append(row)
    accept = [tuple(sorted({final[q] for q in states if q in final})) for states in order]

    block, n = [sorted(set(accept)).index(a) for a in accept], 0
    while len(set(block)) != n:  # refine until no block splits
        n = len(set(block))
        keys: dict[tuple, int] = {}
        block = [keys.setdefault((block[k], *(block[x] for x in row)), len(keys)) for k, row in enumerate(table)]
    chosen = {b: k for k, b in reversed(list(enumerate(block)))}
    rank = {b: r for r, b in enumerate(sorted(chosen, key=lambda b: (bool(accept[chosen[b]]), b)))}
    width, step = len(kinds), [0] * (len(chosen) * len(kinds))
    for b, k in chosen.items():
        step[rank[b] * width : (rank[b] + 1) * width] = [rank[block[x]] * width for x in table[k]]
    accepts = {rank[b] * width: accept[k] for b, k in chosen.items() if accept[k]}
    dead = next((s for s in range(0, len(step), width) if s not in accepts and set(step[s : s + width]) == {s}), -1)
    return Automaton(classes, step, rank[block[0]] * width, min(accepts), accepts, dead)


@cache
def machines() -> tuple[Automaton, list[Automaton], list[re.Pattern]]:
    """Built once per worker."""
    rules = [x for _, x, _ in RULES]
    return compile_rules(rules), [compile_rules([x], backwards=True) for x in rules], [re.compile(x.encode()) for x in rules]


def match_ends(data: bytes, machine: Automaton) -> list[tuple[int, int]]:
    """(end, rule) wherever a match of a rule can't go on, in order of the ends."""
    step, first, accepts = machine.step, machine.accepting, machine.accepts
    state, marks = machine.start, []
    for at, kind in enumerate(data.translate(machine.classes)):
        state = step[state + kind]
        if state >= first:
            marks.append((at, state))
    ends, live, last = [], (), -2
    for at, state in marks:
        now = accepts[state]
        ends += [(last + 1, k) for k in live if at != last + 1 or k not in now]
        live, last = now, at
    return ends + [(last + 1, k) for k in live]


def match_start(data: bytes, end: int, least: int, machine: Automaton) -> int | None:
    """The leftmost start, not before least, of a match that ends here."""
    state, found = machine.start, None
    for at in range(end - 1, least - 1, -1):
        state = machine.step[state + machine.classes[data[at]]]
        if state in machine.accepts:
            found = at
        elif state == machine.dead:
            break
    return found


def find_secrets(data: bytes) -> list[tuple[int, int, int]]:
    """(start, end, rule) in bytes, ordered by start and rule."""
    forward, backward, exact = machines()
    ends = match_ends(data, forward)
    done, found = [0] * len(RULES), []
    for end, k in ends:
        start = match_start(data, end, done[k], backward[k])
        if start is None:
            continue
        done[k] = end
        m = exact[k].fullmatch(data, start, end)
        if m and len(m[m.lastindex or 0]) >= RULES[k][2]:
            found.append((start, end, k))
    return sorted(found, key=lambda x: (x[0], x[2]))


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in batch.column("text").cast(pa.large_binary()).to_pylist():
            data = text or b""
            spans, counts, at, points = [], [0] * len(RULES), 0, 0
            for start, end, k in find_secrets(data):
                points += len(data[at:start].decode("utf-8", "replace")) if start >= at else -len(data[start:at].decode("utf-8", "replace"))
                at = start
                counts[k] += 1
                spans.append((k, f"{RULES[k][0]}:{points}:{points + len(data[start:end].decode('utf-8', 'replace'))}"))
            for name, n in zip(("n_assign", "n_access", "n_hex"), counts):
                out[name].append(n)
            out["base_sha256"].append(hashlib.sha256(",".join(s for k, s in spans if k < BASE).encode()).hexdigest())
            out["spans"].append(",".join(s for _, s in spans))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{k: pa.array(v, pa.int64() if k[:2] == "n_" else pa.string()) for k, v in out.items()}})


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(scan_batches, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
