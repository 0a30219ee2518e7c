"""Connected components: union-find inside each task, and alternating large-star and small-star steps between tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges that a task holds at once.
EDGES_A_TASK = 1 << 19


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some edges that aren't the smallest of their component, and those smallest ids."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if not (differ := x != y).any():
            break
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root != root[root]).any():
            root = root[root]
        a, b = a[differ], b[differ]
    return ids[root != np.arange(len(ids))], ids[root[root != np.arange(len(ids))]]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v, held = [], [], 0
    out = lambda x, y: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["u", "v"])
    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
        held += b.num_rows
        if held > 2 * EDGES_A_TASK:
            x, y = forest(np.concatenate(u), np.concatenate(v))
            if len(x) > EDGES_A_TASK:  # mostly new ids: they are handed on
                yield out(x, y)
                x, y = x[:0], y[:0]
            u, v, held = [x], [y], len(x)
    if held:
        yield out(*forest(np.concatenate(u), np.concatenate(v)))


def _told(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (u, v), both long; component is the smallest id that is reachable.

    Each round first replaces a task's edges by the stars of their own components, then joins stars of different tasks. It ends when
    one task has had all edges, or when nothing changes any more. A hub's edges are few after the first step, and its join is
    dealt anew when it is skewed. No edges give no rows; loops and repeated edges don't matter."""
    u, v = F.col("u"), F.col("v")
    now = scratch.put(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")))
    told, n = None, now.count()
    while True:
        parts = -(-n // EDGES_A_TASK) or 1
        stars = scratch.put(now.coalesce(parts).mapInArrow(_contract, "u long, v long"))
        scratch.drop(now)
        now = stars
        if parts == 1:
            break
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(v > u).join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(small, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        new = scratch.put(hooked.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(now)
        now, before = new, told
        told = _told(now)
        n = told[0]
        if told == before:
            break
    return now.select(u.alias("id"), v.alias("component")).unionByName(now.select(v.alias("id"), v.alias("component")).distinct())
