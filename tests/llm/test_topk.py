import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import topk


def brute(rows, k=5):
    whole = [(n, i, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in whole:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in whole if m != n)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    made = topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0)
    return sorted(map(tuple, made.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("blocks", [(8192, 512), (37, 2)])
@pytest.mark.parametrize("kind", ["random", "same", "grid", "large"])
def test_equals_brute_force(spark, monkeypatch, blocks, kind):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rng = random.Random(3)
    draw = {"random": lambda: rng.gauss(0, 1), "same": lambda: 0.5, "grid": lambda: rng.choice((-1.0, 0.0, 1.0)), "large": lambda: rng.gauss(0, 1e6)}[kind]
    rows = [(i, [draw() for _ in range(8)]) for i in range(260)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    one = [1.0, -2.0]
    rows = [(0, one), (0, one), (50, [0.0, 0.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (None, one), (5, [1.0]), (100, []), (6, one)]
    got = run(spark, rows)
    padded = [(i, v + [0.0] * (2 - len(v)) if v is not None else None) for i, v in rows]
    assert got == brute(padded)


def test_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]


def test_stops_early():
    rng = np.random.default_rng(0)
    v = np.floor(256 * rng.standard_normal((4000, 3)))
    v[7] = 5000
    lists = topk.Lists(np.arange(4000), np.arange(4000), v)
    ids, _ = lists.search(-1, np.array([1.0, 1.0, 1.0]), 1)
    assert ids.tolist() == [7]
