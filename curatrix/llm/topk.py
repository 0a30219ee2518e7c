"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors become integers, floor(256 * x). A task has one block of candidates and one block of queries. It sorts the candidates
along every dimension once. For a query it walks all lists at once, from the end that its component favours, and scores every
candidate that it meets; when the sum of the values at the lists' current places (the best score that an unmet
candidate could have) is below the k-th score, it stops. The k best of all blocks are then ranked.

Ties go to the smaller id, so the walk goes on while the bound equals the k-th score. Vectors that are null, hold a null or a component that is not
finite, and rows without an id take no part. Shorter vectors count as padded with zeros. A query's own row is no candidate; other rows with
its id or its vector are. Scores beyond 64 bits are clamped, and equal then. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE, K = 256, 5
#: Candidates and queries of a block; places that a walk first goes down in every list.
CANDIDATES, QUERIES, STEP = 8192, 4096, 8
LOW, HIGH = -(2**63), 2**63 - 1


class Lists:
    """A block of candidates, sorted along every dimension."""

    def __init__(self, ids: np.ndarray, rids: np.ndarray, vectors: np.ndarray):
        self.ids, self.rids, self.vectors = ids, rids, vectors
        self.order = np.argsort(vectors, 0, kind="stable")
        self.values = np.take_along_axis(vectors, self.order, 0)

    def search(self, rid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates for q, and so many steps as the bound asks for."""
        n = len(self.ids)
        seen = self.rids == rid
        dims = np.flatnonzero(q)
        down = q[dims] > 0
        ids, scores = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        depth, step, left = 0, STEP, n - int(seen.sum())
        while depth < n and left:
            stop = min(n, depth + step)
            now = seen.copy()
            now[self.order[depth:stop, dims[~down]]] = True
            now[self.order[n - stop : n - depth, dims[down]]] = True
            if not len(dims):
                now[:], stop = True, n  # all scores are equal
            met = np.flatnonzero(now & ~seen)
            seen = now
            left -= len(met)
            ids, scores = np.r_[ids, self.ids[met]], np.r_[scores, self.vectors[met] @ q]
            if len(ids) > 8 * k and k:  # ties with the k-th stay
                high = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                ids, scores = ids[high], scores[high]
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            depth, step = stop, 2 * step
            if len(ids) == k and depth < n and left:
                edge = self.values[np.where(down, n - depth, depth - 1), dims]
                if (edge * q[dims]).sum() < scores[-1]:
                    break
        return ids, scores


def whole_numbers(vectors: list, dims: int) -> np.ndarray:
    """Vectors as rows of whole numbers, held in floats."""
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return np.floor(out * SCALE)


def block_top(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each of its queries."""
    queries, candidates = pdf[pdf.side == "q"], pdf[pdf.side == "c"]
    out = []
    if len(queries) and len(candidates):
        dims = int(pdf.vec.map(len).max())
        c, q = (whole_numbers(x.vec.tolist(), dims) for x in (candidates, queries))
        most = np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * max(1, dims)
        if most < 2**24:  # exact in short floats, in long ones, or else in Python's integers
            c, q = c.astype(np.float32), q.astype(np.float32)
        elif most >= 2**53:
            c, q = (np.array([[int(v) for v in row] for row in x], object).reshape(x.shape) for x in (c, q))
        lists = Lists(candidates.id.to_numpy(), candidates.rid.to_numpy(), c)
        for rid, i, v in zip(queries.rid, queries.id, q):
            ids, scores = lists.search(rid, v, k)
            out += [(rid, i, j, max(LOW, min(HIGH, int(s)))) for j, s in zip(ids.tolist(), scores.tolist())]
    return pd.DataFrame(out, columns=["rid", "query_id", "vec_id", "score"], dtype="int64")


def top_k(df: DataFrame, id: str = "vec_id", vector: str = "embedding", is_query: Column | None = None, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates among all rows. Queries are the rows for which is_query holds."""
    scratch = Scratch(df.sparkSession, "topk")
    vec = F.col(vector).cast("array<double>")
    fit = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.where(F.col(id).isNotNull() & vec.isNotNull() & fit)
    asked = F.coalesce(F.lit(True) if is_query is None else is_query, F.lit(False))
    rows = scratch.put(rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id).cast("long").alias("id"), vec.alias("vec"), asked.alias("asked")))
    n = rows.agg(F.count("*").alias("c"), F.count_if("asked").alias("q")).first()
    nc, nq = max(1, -(-n.c // CANDIDATES)), max(1, -(-n.q // QUERIES))
    dealt = F.xxhash64("rid")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    own = lambda m: F.pmod(dealt, F.lit(m)).cast("int")
    candidates = rows.select("rid", "id", "vec", F.lit("c").alias("side"), own(nc).alias("cb"), every(nq).alias("qb"))
    queries = rows.where("asked").select("rid", "id", "vec", F.lit("q").alias("side"), own(nq).alias("qb"), every(nc).alias("cb"))
    found = candidates.unionByName(queries).groupBy("cb", "qb").applyInPandas(lambda pdf: block_top(pdf, k), "rid long, query_id long, vec_id long, score long")
    # each task keeps k rows of a query before they are shuffled
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
