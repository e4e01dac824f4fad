"""Quality classifier: a sparse rule ensemble over text statistics.

Trees of a small random forest are taken apart into conjunctive rules (the paths from their roots), a lasso logistic
regression weighs the rules, and those with a weight are compiled into one Spark column expression over the
statistics. Statistics are computed for every whole text; labels, language, source and id are never among them. The
fit uses at most MOST_LABELS labelled rows, chosen by a hash of their id; everything else covers all rows.

Defined results: a null text counts as empty and gets the score of an empty text. Repeated rows each get their row;
a null id is never held out and is never trained on. Labels that are null are left out; of repeated labels of one id
the larger counts, and of repeated rows of one id one is trained on. Without labels of both kinds the score is the
share of label 1 (0.5 with no label at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrow_text import slices, words
from .shared import carried, spool

#: Labelled rows that the fit uses at most.
MOST_LABELS = 20_000
THRESHOLD = 0.3
HELD_OUT = 5
TREES, DEPTH, LASSO = 16, 3, 0.002

_BYTES = np.arange(256)
_KINDS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digit": (_BYTES >= 48) & (_BYTES <= 57),
    "high": _BYTES >= 128,
    "symbol": np.isin(_BYTES, list(b"#$%&*+/<=>@[\\]^_`{|}~")),
    "pipe": _BYTES == ord("|"),
    "bang": _BYTES == ord("!"),
    "stop": np.isin(_BYTES, list(b".,;:?")),
    "line": _BYTES == 10,
}
STATISTICS = ("log_words", "word_length", "distinct_words", "one_byte_words", "long_words", *(f"share_{k}" for k in _KINDS), "upper_of_letters", "words_per_line", "stops_per_word", "symbols_per_word")


def statistics_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of each text; shares are of its bytes."""
    w, n = words(data, offsets), len(offsets) - 1
    size = np.diff(offsets)
    count, text = np.diff(w.first), w.text_of_word()
    some, many = np.maximum(size, 1), np.maximum(count, 1)
    length = w.end - w.start

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.bincount(text, x, n)

    def of_bytes(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    own = np.unique(w.hash ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    kinds = {k: of_bytes(v) for k, v in _KINDS.items()}
    out = {"log_words": np.log1p(count), "word_length": per_text(length) / many, "distinct_words": np.bincount(text[own], minlength=n) / many, "one_byte_words": per_text(length == 1) / many, "long_words": per_text(length > 12) / many}
    out |= {f"share_{k}": v / some for k, v in kinds.items()}
    letters = kinds["upper"] + kinds["lower"]
    return out | {"upper_of_letters": kinds["upper"] / np.maximum(letters, 1), "words_per_line": count / (kinds["line"] + 1), "stops_per_word": kinds["stop"] / many, "symbols_per_word": kinds["symbol"] / many}


def text_statistics(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, and the statistics of the column text."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                found = statistics_of(data, offsets)
                yield pa.RecordBatch.from_pydict({**{k: batch.column(k).slice(lo, hi - lo) for k in keep}, **{k: pa.array(found[k], pa.float64()) for k in STATISTICS}})

    schema = StructType([*(rows.schema[k] for k in keep), *(StructField(k, DoubleType()) for k in STATISTICS)])
    return rows.select("text", *[k for k in keep if k != "text"]).mapInArrow(compute, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


Rule = tuple[tuple[int, str, float], ...]


def tree_paths(node, path: Rule = ()) -> Iterator[Rule]:
    """The conjunction of tests that leads to each node below the root."""
    if path:
        yield path
    if node.subtreeDepth() > 0:
        split = node.split()
        for child, sign in ((node.leftChild(), "<="), (node.rightChild(), ">")):
            yield from tree_paths(child, (*path, (split.featureIndex(), sign, split.threshold())))


def simplified(rule: Rule) -> Rule:
    """One bound per statistic and side."""
    best: dict[tuple[int, str], float] = {}
    for k, sign, at in rule:
        best[k, sign] = at if (k, sign) not in best else (min if sign == "<=" else max)(at, best[k, sign])
    return tuple(sorted((k, sign, at) for (k, sign), at in best.items()))


def rule_column(rule: Rule) -> Column:
    tests = [F.col(STATISTICS[k]) <= at if sign == "<=" else F.col(STATISTICS[k]) > at for k, sign, at in rule]
    return reduce(lambda a, b: a & b, tests)


def fit_rules(train: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with their weights) from the statistics and the label column y."""
    n, ones = train.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < ones < n:
        return float(np.clip(np.log((ones + 1e-9) / (n - ones + 1e-9)), -20, 20)) if n else 0.0, []
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(train).select("x", "y", *STATISTICS)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=7).fit(rows)
    rules = sorted({simplified(p) for t in forest.trees for p in tree_paths(t._call_java("rootNode"))})
    if not rules:
        return float(np.log(ones / (n - ones))), []
    binary = rows.select("y", F.array(*[F.when(rule_column(r), 1.0).otherwise(0.0) for r in rules]).alias("r"))
    from pyspark.ml.functions import array_to_vector

    # each of the lasso's 100 to 200 passes is a job: over one partition (MOST_LABELS rows at most) it is one task for the driver to keep account of
    model = LogisticRegression(featuresCol="v", labelCol="y", elasticNetParam=1.0, regParam=LASSO, maxIter=80).fit(binary.select("y", array_to_vector("r").alias("v")).coalesce(1))
    return float(model.intercept), [(r, float(w)) for r, w in zip(rules, model.coefficients.toArray()) if abs(w) > 1e-6]


def score_column(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    total = reduce(lambda a, b: a + b, [F.when(rule_column(r), w).otherwise(0.0) for r, w in rules], F.lit(intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def known_labels(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """(doc_id, y) of the labels that may be trained on, MOST_LABELS at most."""
    known = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    return known.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)


def fit_score(stats: DataFrame, known: DataFrame) -> Column:
    """The score as an expression over the statistics; stats have doc_id. One row per label id is trained on."""
    each = stats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    return score_column(*fit_rules(spool(each.select("y", "s.*").coalesce(4), "training")))


def classify_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    stats = spool(text_statistics(rows, "doc_id"), "statistics")
    score = fit_score(stats, known_labels(labels, label_col, id_col))
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are not rejected. Each row is decided where it stands: nothing is shuffled."""
    rows, known = carried(docs, id_col, text_col), known_labels(labels, label_col, id_col)
    labelled = rows.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    score = fit_score(text_statistics(labelled, "doc_id"), known)
    return text_statistics(rows, "row").filter(score >= THRESHOLD).select("row.*")
