"""Mixing towards target weights with soft membership.

A softmax regression on hashed word counts learns the domains from a labelled table (at most MOST_LABELS rows of it,
chosen by a hash of their id) and gives every document its domain posteriors. The rates r >= 0 minimise, by projected
gradient descent from r = 1, the squared distance between the expected domain token totals and the asked shares of the
natural total. The projection is lazy: a point y, of any sign, takes the steps, and the rates are max(0, y). As y moves
along the posteriors only, y = 1 + p * m with one number m per domain, so a step needs one sum over all documents (a
few numbers per domain reach the driver), and a document's rate follows from its posteriors and m. A step is scaled by
the inverse of the Gram matrix of the documents whose rate is above 0 (a projected Newton step on the numbers m) and
halved until it makes progress; of all rates that meet the shares those nearest to 1 come out.

Where no rates meet the shares, the nearest come out: those with the least squared distance of the shares plus NEAR
times the mean squared distance of the rates from 1; a warning gives the totals reached, and must_reach makes it an
error. With epochs, a domain's target is at most so many times its natural total; what it then lacks is asked of the
other domains by their weights, up to epochs times what their weights ask, so that the targets sum to the natural total
unless the corpus is mostly of domains that shall be rare; and no rate is above twice epochs.
mix_with_totals returns natural totals, targets and totals reached in any case.

Defined results: a null text counts as empty, has no tokens and evenly unknown membership (the model's intercept).
Repeated rows each get their row. Rows with a null id are rated like others but are never trained on. With no usable
labels all documents are equally likely in each domain and all rates are 1, since no rates change the shares. Labels of
one kind make the other domains improbable; a single row can only be rated as a whole. An empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices, words
from .shared import BROADCAST_KEYS, numbered, spool

MOST_LABELS = 6_000
BUCKETS = 1 << 12
#: Texts that the fit of the domains takes at a time.
FIT_ROWS = 500
#: Domains of the labels table, in order, and the share of the tokens each shall have.
DOMAINS = ("clean", "junk", "toxic")
WEIGHTS = (0.97, 0.02, 0.01)
#: Steps after which shares count as out of reach, halvings of a step, and how near to a target a total must come, as a part of it.
STEPS, HALVINGS, CLOSE = 40, 12, 1e-4
#: With epochs, and where the shares are out of reach: how much a rate's distance from 1 counts beside the distance from the targets.
PULL, NEAR = 1e-3, 1e-4


class Fit(NamedTuple):
    """The numbers m, and tokens per domain: natural, asked for, and reached."""

    m: np.ndarray
    natural: np.ndarray
    targets: np.ndarray
    reached: np.ndarray


def label_domain() -> Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket) of every word and the words per text; words are taken in lower case."""
    w = words(data, offsets, lower=True)
    return w.text_of_word(), (w.hash & np.uint64(BUCKETS - 1)).astype(np.int64), np.diff(w.first)


def training_rows(docs: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of each labelled document's words and its domain; one row per label id, so bounded by MOST_LABELS.

    Of several rows with one id, that with the smallest buckets counts; only the chosen one leaves its task.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                text, bucket, _ = bucket_counts(data, offsets)
                found = [np.unique(bucket[text == k]).astype("<u2").tobytes() for k in range(hi - lo)]
                yield pa.RecordBatch.from_pydict({"_id": batch.column("_id").slice(lo, hi - lo), "domain": batch.column("domain").slice(lo, hi - lo), "buckets": pa.array(found, pa.binary())})

    found = docs.select("_id", "domain", "text").mapInArrow(compute, "_id long, domain int, buckets binary")
    rows = found.groupBy("_id").agg(F.max("domain").alias("domain"), F.min("buckets").alias("buckets")).orderBy("_id").collect()
    return [np.frombuffer(r.buckets, "<u2") for r in rows], np.array([r.domain for r in rows], np.int64)


def fit_softmax(rows: list[np.ndarray], domain: np.ndarray, domains: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(weights by bucket and domain, intercepts) of a softmax regression on word presence, each text scaled to unit length.

    Texts are taken FIT_ROWS at a time, so the driver holds their buckets (2 bytes each) and no array of all of them.
    """
    weights, bias = np.zeros((BUCKETS, domains)), np.zeros(domains)
    if not len(rows):
        return weights, bias
    blocks = []
    for lo in range(0, len(rows), FIT_ROWS):
        own = rows[lo : lo + FIT_ROWS]
        blocks.append((lo, np.concatenate([*own, np.empty(0, "<u2")]).astype("<u2"), np.array([len(r) for r in own])))
    idf = np.log((1 + len(rows)) / (1 + sum(np.bincount(flat, minlength=BUCKETS) for _, flat, _ in blocks)))

    def each() -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per block: first text, how many, and of each word the text within the block, the bucket and the scale."""
        for lo, flat, sizes in blocks:
            row, flat = np.repeat(np.arange(len(sizes)), sizes), flat.astype(np.int64)
            yield lo, len(sizes), row, flat, (1 / np.sqrt(np.maximum(sizes, 1)))[row] * idf[flat]

    truth = np.eye(domains)[domain]
    bias = np.log((truth.sum(0) + 0.5) / len(rows))
    squares, b_squares = np.full_like(weights, 1e-8), np.full(domains, 1e-8)
    for _ in range(rounds):  # AdaGrad over all rows
        z = np.concatenate([np.stack([np.bincount(row, weights[flat, k] * scale, n) for k in range(domains)], 1) for _, n, row, flat, scale in each()]) + bias
        p = np.exp(z - z.max(1, keepdims=True))
        miss = p / p.sum(1, keepdims=True) - truth
        total = np.zeros((domains, BUCKETS))
        for lo, n, row, flat, scale in each():
            for k in range(domains):
                np.add.at(total[k], flat, miss[lo : lo + n, k][row] * scale)
        grad = total.T + 0.1 * weights
        squares += grad**2
        weights -= 0.3 * grad / np.sqrt(squares)
        b_squares += miss.sum(0) ** 2
        bias = bias - 0.1 * miss.sum(0) / np.sqrt(b_squares)
    return weights * idf[:, None], bias


def posteriors(rows: DataFrame, weights: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, p) of rows (doc_id, text): words per document and its domain posteriors; a column key is kept."""
    extra = ["key"] if "key" in rows.columns else []

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in slices(batch.column("text")):
                text, bucket, count = bucket_counts(data, offsets)
                key = np.unique(text * BUCKETS + bucket)
                own, at = key // BUCKETS, key % BUCKETS
                size = np.sqrt(np.maximum(np.bincount(own, minlength=hi - lo), 1))
                z = np.stack([np.bincount(own, weights[at, k], hi - lo) / size for k in range(len(bias))], 1) + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                flat = pa.ListArray.from_arrays(np.arange(0, p.size + 1, len(bias), dtype=np.int32), p.ravel())
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(lo, hi - lo), **{k: batch.column(k).slice(lo, hi - lo) for k in extra}, "n_tokens": pa.array(count, pa.int64()), "p": flat})

    return rows.select("doc_id", "text", *extra).mapInArrow(compute, "doc_id long, " + "".join(f"{k} long, " for k in extra) + "n_tokens long, p array<double>")


def point_of(m: np.ndarray) -> Column:
    return sum((F.col("p")[k] * F.lit(float(x)) for k, x in enumerate(m)), F.lit(1.0))


def rate_of(y: Column, most: float | None) -> Column:
    rate = F.greatest(F.lit(0.0), y)
    return rate if most is None else F.least(F.lit(float(most)), rate)


def reachable(asked: np.ndarray, most: np.ndarray) -> np.ndarray:
    """asked with no domain above its most; what is cut goes to the other domains in proportion, as far as they can take it."""
    out, free = np.minimum(asked, most), asked < most
    while free.any() and (lacking := asked.sum() - out.sum()) > 1e-12 * asked.sum():
        part = np.where(free, asked, 0.0)
        if not part.sum():
            part = free.astype(float)
        out = np.minimum(out + lacking * part / part.sum(), most)
        free &= out < most
    return out


def fit_rates(rows: DataFrame, weights: tuple[float, ...], epochs: float | None = None, must_reach: bool = False) -> Fit:
    """The m under which every domain's expected tokens come within CLOSE of its target, or as near as any rates bring them."""
    kinds = len(weights)
    total = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    part = F.col("n_tokens") / F.lit(total or 1.0)
    most = None if epochs is None else 2 * epochs

    def look(points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Per point: the function that falls with every step, the domains' shares, and the Gram matrix of the free documents."""
        sums = []
        for j in range(len(points)):
            y, p = F.col(f"y{j}"), F.col("p")
            r = rate_of(y, most)
            free = F.when(r == y, part).otherwise(F.lit(0.0))
            sums += [F.sum(part * (r * y - r * r / 2)), *(F.sum(part * r * p[k]) for k in range(kinds)), *(F.sum(free * p[k] * p[i]) for k in range(kinds) for i in range(kinds))]
        rated = rows.select("n_tokens", "p", *[point_of(m).alias(f"y{j}") for j, m in enumerate(points)])
        found = np.array([x or 0.0 for x in rated.agg(*[x.alias(f"s{j}") for j, x in enumerate(sums)]).first()]).reshape(len(points), -1)
        return [(x[0], x[1 : 1 + kinds], x[1 + kinds :].reshape(kinds, kinds)) for x in found]

    m = np.zeros(kinds)
    value, share, gram = look([m])[0]
    natural, asked = share, np.array(weights, float) / sum(weights) * share.sum()
    if epochs is not None:
        asked = reachable(asked, epochs * np.minimum(natural, asked))

    def descend(state: tuple, pull: np.ndarray) -> tuple:
        """(value, share, gram, m) at the end of the steps from such a state."""
        value, share, gram, m = state
        for _ in range(STEPS):
            slope = share - asked + pull @ m
            if np.abs(slope / np.maximum(asked, 1e-12)).max(initial=0) < CLOSE:
                break
            step = np.linalg.solve(gram + pull + 1e-12 * np.eye(kinds), -slope)
            height = value - m @ asked + m @ pull @ m / 2
            for first in range(0, HALVINGS, 3):
                points = [m + step / 2**k for k in range(first, first + 3)]
                tried = [(v - x @ asked + x @ pull @ x / 2, v, s, g, x) for (v, s, g), x in zip(look(points), points)]
                lowest = min(tried, key=lambda x: x[0])
                if lowest[0] < height:
                    _, value, share, gram, m = lowest
                    break
            else:
                break
        return value, share, gram, m

    start = (value, share, gram, m)
    # a slight pull of the rates towards 1, which stops a chase after shares out of reach or of a domain that is next to nothing
    _, share, _, m = descend(start, 1e-9 * gram if epochs is None else PULL * (gram + PULL * np.eye(kinds)))
    off = np.abs((share - asked) / np.maximum(asked, 1e-12)).max(initial=0)
    if off >= 2 * CLOSE and epochs is None:
        _, share, _, m = descend(start, NEAR * np.eye(kinds))
        if must_reach:
            raise ValueError(f"no rates of these documents reach the shares {asked.tolist()} of their tokens; the nearest are {share.tolist()}")
    return Fit(m, natural * total, asked * total, share * total)


def mix(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", epochs: float | None = None, must_reach: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, p (posteriors), rate, copies.

    copies rounds the rate up or down by a hash of the id and the rate's own fraction, so its mean is the rate.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _mixed(rows, labels, weights, domain, id_col, epochs, must_reach)[0]


def mix_with_totals(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, domain: Column | None = None, id_col: str = "doc_id", text_col: str = "text", epochs: float | None = None, must_reach: bool = False) -> tuple[DataFrame, Fit]:
    """mix, and the domains' tokens: natural, asked for and reached."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _mixed(rows, labels, weights, domain, id_col, epochs, must_reach)


def _mixed(rows: DataFrame, labels: DataFrame, weights: tuple[float, ...], domain: Column | None, id_col: str, epochs: float | None, must_reach: bool = False) -> tuple[DataFrame, Fit]:
    known = labels.select(F.col(id_col).cast("long").alias("_id"), (label_domain() if domain is None else domain).cast("int").alias("domain")).filter("_id is not null and domain is not null")
    known = known.groupBy("_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELS)
    chosen = rows.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id")).select("_id", "domain", "text")
    texts, domains = training_rows(chosen)
    found = spool(posteriors(rows, *fit_softmax(texts, domains, len(weights))), "posteriors")
    if len(texts) or must_reach:
        fit = fit_rates(found, weights, epochs, must_reach)
    else:  # equal posteriors: the shares are the same at all rates
        total = float(found.agg(F.sum("n_tokens")).first()[0] or 0)
        even = np.full(len(weights), total / len(weights))
        fit = Fit(np.zeros(len(weights)), even, np.array(weights, float) / sum(weights) * total, even)
    asked = np.array(weights, float) / sum(weights) * fit.natural.sum()
    if (np.abs(fit.reached - asked) > 2 * CLOSE * asked).any():
        bound = "" if epochs is None else f" with {epochs} epochs at most"
        warnings.warn(f"the nearest tokens per domain{bound} are {fit.reached.tolist()}, not {asked.tolist()}", stacklevel=3)
    chance = F.pmod(F.xxhash64(F.lit("mix"), "doc_id", "n_tokens"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return found.withColumn("rate", rate_of(point_of(fit.m), None if epochs is None else 2 * epochs)).withColumn("copies", F.floor(F.col("rate") + chance).cast("int")), fit


def mixed_docs(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", epochs: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, each as often as its copies say. Only rows with other than one copy are joined."""
    rows = numbered(docs, id_col, text_col, row=True)
    marks = _mixed(rows.select("key", "doc_id", "text"), labels, weights, None, id_col, epochs)[0]
    other = spool(marks.filter("copies != 1").select("key", "copies"), "copies")
    few = other.count() <= BROADCAST_KEYS
    joined = rows.select("key", "row").join(F.broadcast(other) if few else other, "key", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return joined.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("k")).select("row.*")
