"""Exact top-k search by inner product with a three-phase uniform threshold.

A vector's components are split into LISTS groups; a list holds, for a query, every candidate's partial product over
one group. Queries and candidates meet in blocks of bounded size, so neither is broadcast or gathered whole.

Phase 1: each block of candidates gathers the k highest entries of each local list and resolves just these candidates;
the k-th highest of all scores a query so gets is a safe cutoff, since k candidates reach it. Phase 2: the cutoff goes
back with the queries. A score of at least the cutoff has a partial product of at least cutoff / LISTS in some list, so
each block collects the entries that do; what a candidate's other lists add is less than that, so candidates whose
known entries and this bound stay below the cutoff go. Phase 3: of the candidates left just the missing partial products
are fetched from the block's lists, those that reach the cutoff leave it, and each query keeps its k best.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a
null id. Repeated rows (equal id and vector) count once. An id with several different vectors asks with each of them
and their results are ranked together; as a candidate it can appear once per vector. Only vectors of equal length are
compared. Ties go to the smaller id. With fewer than k candidates all are returned; an empty table gives no rows.
Scores that exceed 64 bits wrap around.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import spool

LISTS = 4
#: Vectors of a block of queries and of one of candidates, and candidates that are looked at in one step.
QUERY_BLOCK, CANDIDATE_BLOCK, STEP = 2048, 16_384, 1024
#: Components of a block at most (about).
BLOCK_VALUES = 1 << 22
SCALE = 1024
#: A query without k candidates so far: everything counts.
OPEN = -(2**62)
SCORES = "query_id long, vec_id long, score long"
#: Candidates whose missing products are fetched in one step.
FETCH = 1 << 16


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): distinct rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), quantised(v).alias("v")).distinct()


def list_bounds(size: int) -> list[tuple[int, int]]:
    """The components of each list."""
    lists = min(LISTS, size)
    return [(k * size // lists, (k + 1) * size // lists) for k in range(lists)]


def _matrix(column: pd.Series) -> np.ndarray:
    """Whole numbers; as floats where sums of products are exact, since these multiply far quicker."""
    m = np.stack(column.to_numpy()).astype(np.int64)
    return m.astype(np.float64) if float(np.abs(m).max(initial=0)) ** 2 * m.shape[1] < 2**52 else m


def _pair(queries: pd.DataFrame, candidates: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    q, c = _matrix(queries["v"]), _matrix(candidates["v"])
    return (q, c) if q.dtype == c.dtype else (q.astype(np.int64), c.astype(np.int64))


def _gather(k: int):
    """Phase 1: (query, candidate, score) of the k best that the local lists name."""

    def local_lists(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            q, c = _pair(queries, candidates)
            q_ids, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
            n = min(k + 1, len(ids))  # one more than k, as a query's own row may be among them
            best = [np.empty((len(q), 0), np.int64) for _ in list_bounds(q.shape[1])]
            for at in range(0, len(c), STEP):
                for k_list, (a, b) in enumerate(list_bounds(q.shape[1])):
                    p = q[:, a:b] @ c[at : at + STEP, a:b].T
                    top = np.argpartition(-p, min(n, p.shape[1]) - 1, axis=1)[:, : min(n, p.shape[1])]
                    best[k_list] = np.concatenate([best[k_list], top + at], axis=1)
            for row in range(len(q)):
                named = []
                for (a, b), places in zip(list_bounds(q.shape[1]), best):
                    score = c[places[row], a:b] @ q[row, a:b]
                    named.append(places[row][np.lexsort((ids[places[row]], -score))[:n]])
                at = np.unique(np.concatenate(named))
                at = at[ids[at] != q_ids[row]]
                score = (c[at] @ q[row]).astype(np.int64)
                keep = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": q_ids[row], "vec_id": ids[at[keep]], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    return local_lists


def sufficient_entries(q: np.ndarray, c: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phase 2: (query, candidate, known, have) of the pairs that can still reach the query's cutoff.

    known sums the partial products that are entries, have says which lists (first axis) these come from.
    """
    lists = list_bounds(q.shape[1])
    enough = -(-cutoff // len(lists))  # a whole number p has p * lists >= cutoff exactly if p >= this
    known, have = np.zeros((len(q), len(c)), np.int64), np.zeros((len(lists), len(q), len(c)), bool)
    for k, (a, b) in enumerate(lists):
        p = (q[:, a:b] @ c[:, a:b].T).astype(np.int64)
        have[k] = p >= enough[:, None]
        known += np.where(have[k], p, 0)
    n = have.sum(0)
    row, col = np.nonzero((n > 0) & (known + (len(lists) - n) * (enough - 1)[:, None] >= cutoff[:, None]))
    return row, col, known[row, col], have[:, row, col]


def resolved(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray, known: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Phase 3: the pairs' scores; only the partial products of lists that are missing are fetched."""
    score = known.copy()
    for k, (a, b) in enumerate(list_bounds(q.shape[1])):
        lacking = np.flatnonzero(~have[k])
        for at in range(0, len(lacking), FETCH):
            part = lacking[at : at + FETCH]
            score[part] += np.einsum("ij,ij->i", q[row[part], a:b], c[col[part], a:b]).astype(np.int64)
    return score


def _resolve(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
    """Phases 2 and 3 in a block: (query, candidate, score) of all that reach the cutoff."""
    out = []
    if len(queries) and len(candidates):
        q, c = _pair(queries, candidates)
        q_ids, ids, cutoff = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy(), queries["cutoff"].to_numpy()
        for at in range(0, len(c), STEP):
            part = c[at : at + STEP]
            row, col, known, have = sufficient_entries(q, part, cutoff)
            score = resolved(q, part, row, col, known, have)
            keep = (score >= cutoff[row]) & (q_ids[row] != ids[at + col])
            out.append(pd.DataFrame({"query_id": q_ids[row[keep]], "vec_id": ids[at + col[keep]], "score": score[keep]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for each row that is_query (an expression over vec_id) chooses."""
    spark = vectors.sparkSession
    rows = spool(clean_vectors(vectors, id_col, vec_col), "vectors").withColumn("dim", F.size("v"))
    n, m, longest = rows.agg(F.count("*"), F.count_if(is_query), F.max("dim")).first()
    tasks, room = int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, BLOCK_VALUES // (longest or 1))
    c_blocks = max(-(-n // min(CANDIDATE_BLOCK, room)), min(tasks, -(-n // STEP)), 1)
    q_blocks = max(-(-m // min(QUERY_BLOCK, room)), 1)

    def dealt(df: DataFrame, own: str, mine: int, other: str, theirs: int) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id", "v"), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))

    candidates = dealt(rows, "cb", c_blocks, "qb", q_blocks).groupBy("dim", "qb", "cb")
    queries = rows.filter(is_query).select(*(F.col(c).alias(c) for c in rows.columns))
    first = dealt(queries, "qb", q_blocks, "cb", c_blocks).groupBy("dim", "qb", "cb").cogroup(candidates).applyInPandas(_gather(k), SCORES)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = first.withColumn("r", rank).filter(F.col("r") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    cutoff = spool(best.select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(OPEN).alias("cutoff")), "cutoff")
    asked = queries.join(cutoff, F.col("vec_id") == F.col("query_id")).drop("query_id")
    reached = dealt(asked, "qb", q_blocks, "cb", c_blocks).groupBy("dim", "qb", "cb").cogroup(candidates).applyInPandas(_resolve, SCORES)
    return reached.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
