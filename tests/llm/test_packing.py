import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import packing

from .test_bpe import library


def check(rows, capacity):
    """Sequences are gapless from 0 and within capacity; returns how many there are."""
    by = {}
    for seq, at, size in rows:
        by.setdefault(seq, []).append((at, size))
    for parts in by.values():
        end = 0
        for at, size in sorted(parts):
            assert at == end
            end += size
        assert end <= capacity
    return len(by)


def packed(spark, lengths, capacity):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "k long, length long")
    rows = packing.pack(df, "length", capacity).collect()
    assert sorted((r.k, r.length) for r in rows) == sorted(enumerate(lengths))
    return check([(r.sequence_id, r.offset, r.length) for r in rows], capacity)


@pytest.mark.parametrize("rows_a_task", [100_000, 40])
@pytest.mark.parametrize("kind", ["mixed", "equal", "tiny", "long", "none", "one"])
def test_pack(spark, monkeypatch, rows_a_task, kind):
    monkeypatch.setattr(packing, "ROWS_A_TASK", rows_a_task)
    rng = random.Random(1)
    lengths = {
        "mixed": [min(1000, max(1, int(rng.expovariate(1 / 250)))) for _ in range(400)],
        "equal": [300] * 200,
        "tiny": [rng.randrange(1, 4) for _ in range(500)] + [1000, 999],
        "long": [rng.randrange(501, 1001) for _ in range(60)],
        "none": [],
        "one": [1000],
    }[kind]
    n = packed(spark, lengths, 1000)
    least = -(-sum(lengths) // 1000)
    if kind == "long":
        assert n == 60
    elif kind == "equal":
        assert n == 67
    else:
        assert n <= least * (1.01 if rows_a_task > 1000 else 1.04) + 1


def test_sweep_takes_the_largest_that_fits():
    rows = [("D", 1, 3), ("D", 2, 5), ("G", 10, 6), ("D", 3, 7), ("G", 11, 7), ("G", 12, 9), ("D", 4, 20), ("D", 5, 30)]
    out = packing.sweep(rows, 100, 0)
    assert {(r[1], r[2], r[4]) for r in out if r[0] == "P"} == {(2, 10, 94), (3, 11, 93), (1, 12, 91)}
    assert [(r[1], r[4], r[6]) for r in out if r[0] == "D"] == [(5, 0, 1), (4, 30, 0)]
    assert sorted(r[2:5] for r in out if r[0] == "C") == [(0, 30, 20), (1, 20, 0), (1, 30, 0)]


def test_rounds_at_every_size(spark, monkeypatch):
    """A small table is packed by the same sweeps and openings as a large one."""
    seen = []
    for name in ("_swept", "_opened"):
        monkeypatch.setattr(packing, name, lambda *a, f=getattr(packing, name), name=name: seen.append(name) or f(*a))
    assert packed(spark, [300] * 10 + [20] * 30 + [600], 1000) == 5
    assert seen.count("_swept") >= 2 and "_opened" in seen


@pytest.mark.parametrize("rows_a_task, dealt", [(100_000, False), (40, True)])
def test_state_of_one_task_is_not_dealt(spark, monkeypatch, rows_a_task, dealt):
    """Rows that one task holds are swept without an exchange, however many partitions a session deals to; more of them are range-sorted."""
    frame, seen = type(spark.range(0)), []
    monkeypatch.setattr(packing, "ROWS_A_TASK", rows_a_task)
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *by, f=frame.repartitionByRange: seen.append(n) or f(self, max(7, n), *by))
    rng = random.Random(6)
    lengths = [rng.randrange(1, 700) for _ in range(300)]
    n = packed(spark, lengths, 1000)
    assert bool(seen) == dealt and n <= 1.06 * -(-sum(lengths) // 1000)


def test_intervals_match_brackets():
    rng = random.Random(2)
    for _ in range(200):
        counts = {q: (rng.randrange(4), rng.randrange(4)) for q in range(rng.randrange(1, 6))}
        stack, want = [], set()
        for q, (gaps, docs) in sorted(counts.items()):
            for g in range(gaps):
                if stack:
                    want.add((*stack.pop(), q, g))
            stack += [(q, d) for d in range(docs)]
        got = {(p, d, q, total - d) for p, lo, hi, q, total in packing.intervals(counts) for d in range(lo, hi + 1)}
        assert got == want


def test_documents(spark):
    texts = [None, "", "one", "two three " * 3000, "one", "x" * 50]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(2, "one", 9)], "doc_id long, text string, length int")
    rows = packing.pack_documents(df, capacity=64).collect()
    assert sum(r.doc_id == 2 for r in rows) == 2
    check([(r.sequence_id, r.offset, r.length) for r in rows], 64)
    for r in rows:
        ids = (library(texts[r.doc_id]) + [1])[r.start : r.start + r.length]
        assert len(ids) == r.length and r.start == 64 * r.piece and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(len(library(t)) + 1 for t in [*texts, "one"])
    assert packing.pack_documents(df.where(F.lit(False))).count() == 0
