import random

import numpy as np
import pytest

from curatrix.llm import minhash
from curatrix.llm.common import Scratch
from curatrix.llm.components import connected

from .brute import near, shingles


def run(spark, rows, k=2):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n long, id int")
    got = minhash.near_duplicates(df, "doc_id", "text", k).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr), got


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=4)) for _ in range(n)]


def edited(rng, base, share):
    return [rng.choice("xyz") + w if rng.random() < share else w for w in base]


def corpus(seed, n_groups=6, copies=14):
    rng = random.Random(seed)
    texts = [None, "", "  \t\n", "One", "one", "oNE two", "one\x0btwo", "a b c d", "A B C D ", "é b", "É b"]
    for _ in range(n_groups):
        base = words(rng, rng.randrange(20, 90))
        texts += [" ".join(edited(rng, base, rng.choice((0, 0.02, 0.05, 0.09, 0.3)))) for _ in range(copies)]
        texts += [" ".join(base).upper()] * 2
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed, k, few, block", [(0, 2, 8, 1 << 18), (1, 2, 2, 200), (2, 5, 2, 400), (3, 5, 8, 1 << 18)])
def test_equals_all_pairs(spark, monkeypatch, seed, k, few, block):
    """Also when nearly every key is one of the large ones, and in small blocks."""
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(seed)
    got, full = run(spark, rows, k)
    assert got == sorted(near(rows, k), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in full)


def test_hub_that_links_others(spark, monkeypatch):
    """Copies that are similar to their original only."""
    monkeypatch.setattr(minhash, "FEW", 2)
    rng = random.Random(9)
    base = words(rng, 120)
    rows = [(100, " ".join(base))] + [(i, " ".join(edited(rng, base, 0.052))) for i in range(40)]
    got, _ = run(spark, rows)
    assert got == sorted(near(rows, 2), key=repr)


def test_repeats_and_nulls(spark):
    rows = [(5, "a b c"), (5, "a b c"), (5, "x y z"), (None, "a b c"), (None, "q r s"), (3, "x y z"), (7, None)]
    got, _ = run(spark, rows)
    assert got == sorted(near(rows, 2), key=repr)


def test_empty(spark):
    assert run(spark, [])[0] == []
    assert run(spark, [(1, ""), (2, None)])[0] == [(1, 0, 1), (2, 0, 2)]


def test_keep_one(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other text"), (3, "other text"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(df).collect()) == [(1, "a b c d e f"), (3, "other text"), (4, None)]


def test_keep_unlike_rows(spark):
    """Unlike texts stay under null keys and under one key, also if another key repeats; of alike texts under one key one stays."""
    like = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b c d e f"), (None, "q r s t u v"), (None, None), (3, "other text"), (3, "other text"), (5, "one two three four five six"), (5, "le pont reste ouvert la nuit"), (8, like), (8, like + " more"), (None, like)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _key int, _hash int")
    made = minhash.drop_near_duplicates(df)
    assert made.columns == df.columns
    got = [(r.doc_id, r.text) for r in made.collect()]
    assert len([t for i, t in got if i == 8]) == 1
    assert sorted((g for g in got if g[0] != 8), key=repr) == sorted(rows[:4] + rows[5:7], key=repr)


def test_sets_are_words(spark):
    texts = ["a b a b a", "a b c", "", "x", "Ünï cödé ÜNÏ", "a \x1c b"]
    for k in (1, 2, 3):
        found = list(minhash.shingle_sets([t.encode() for t in texts], k))
        assert [len(f) for f in found] == [len(shingles(t, k)) for t in texts]
        assert all((np.diff(f.astype(float)) > 0).all() for f in found)


def test_pigeonhole():
    """Any two signatures within REACH share a key of one chunk without one lane."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        wrong = rng.choice(minhash.LANES, minhash.REACH, replace=False)
        by_chunk = np.bincount(wrong // minhash.CHUNK, minlength=minhash.LANES // minhash.CHUNK)
        assert by_chunk.min() <= 1


def test_packed_sets():
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64))
    assert (minhash.unpack_set(minhash.pack_set(h)) == h).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(60))] + [(50 + i, 51 + i) for i in range(15)] + [(99, 98 - i) for i in range(10)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.id: r.component for r in connected(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def thue_morse(n):
    """A word and its complement, which collide under any polynomial modulo 2**64 from 1,024 letters on."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [16, 1024, 2048])
def test_long_words_are_apart(n):
    a, b = thue_morse(n)
    one, two, both = minhash.shingle_sets([f"{a.upper()} x".encode(), f"{b} x".encode(), f"{a} x {b} x".encode()], 2)
    assert one[0] != two[0] and len(both) == 3 and {one[0], two[0]} < set(both.tolist())


@pytest.mark.parametrize("most", [3, 1000])
def test_components_over_tasks(spark, monkeypatch, most):
    from curatrix.llm import components

    monkeypatch.setattr(components, "EDGES_A_TASK", most)
    edges = [(i, i + 1) for i in range(30)] + [(100, 200 + i) for i in range(20)] + [(300, 301), (301, 300), (302, 302)]
    got = {r.id: r.component for r in connected(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100} | {200 + i: 100 for i in range(20)} | {300: 300, 301: 300}
