"""Train, validation and test splits: by component, by group, stratified; and the layout of a split table."""

from __future__ import annotations

import random
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SPLIT_COLUMNS, SPLIT_OPTIONAL, SPLITS

RATIOS = (0.70, 0.15, 0.15)


def check_ratios(ratios: tuple[float, float, float]) -> None:
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"split ratios must add up to 1, not {sum(ratios):.6f}")


def seeded(seed: int, *keys: str) -> Column:
    """A fixed pseudo-random order of keys, the same in any engine with SHA-256."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def split_order(column: str = "split") -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), F.col(column))


def split_layout(df: DataFrame) -> DataFrame:
    """The columns of a split table in order, the optional ones if they are there."""
    return df.select(*SPLIT_COLUMNS, *[c for c in SPLIT_OPTIONAL if c in df.columns])


def class_coverage(df: DataFrame, component: str, class_col: str = "class_name") -> DataFrame:
    """Of each class, how many components it has, and whether these are enough for one in each split."""
    counts = df.groupBy(class_col).agg(F.count_distinct(component).alias("n_components"))
    return counts.withColumn("covered", F.col("n_components") >= len(SPLITS))


def component_split(df: DataFrame, component: str, class_col: str = "class_name", seed: int = 42, ratios: tuple[float, float, float] = RATIOS, parity_rng: bool = False, need_all: bool = True) -> DataFrame:
    """df with `split`: whole components, balanced by rows within each class.

    The three largest components of a class go to train, val and test; every next one, by falling size, goes where most rows are missing, train
    before val before test among equals. Equal sizes come in a seeded order: by SHA-256, or with parity_rng by Python's shuffle over the
    sorted ids of class after class (the ids are then collected; there are as many as components). The fold runs over the distinct sizes of a class;
    places among equal sizes are counted in parts, and rows only meet their component's split in a join. A class with fewer than three components is an error, and so is a row without one.
    With need_all=False such a class is split as far as it goes: its largest component to train, the next one to val."""
    check_ratios(ratios)
    if not df.where(F.col(component).isNull()).isEmpty():
        raise ValueError(f"rows without {component}")
    sizes = df.groupBy(F.col(class_col).alias("c"), F.col(component).cast("string").alias("k")).agg(F.count("*").cast("int").alias("n"))
    few = need_all and [r.c for r in class_coverage(sizes, "k", "c").where("not covered").orderBy("c").limit(20).collect()]
    if few:
        raise ValueError(f"classes with fewer than three components: {few}")
    if parity_rng:
        rng, ids = random.Random(seed), {}
        for r in sizes.select("c", "k").orderBy("c", "k").collect():
            ids.setdefault(r.c, []).append(r.k)
        rows = []
        for c in sorted(ids):
            rng.shuffle(ids[c])
            rows += [(c, k, f"{n:012d}") for n, k in enumerate(ids[c])]
        order = df.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["c", "k", "o"]))
        sizes = sizes.join(order, ["c", "k"])
    else:
        sizes = sizes.withColumn("o", seeded(seed, "k"))
    # components of one size differ only in their order, so the fold runs over a class's distinct sizes
    by_size = sizes.groupBy("c", "n").agg(F.count("*").alias("m"))
    kind = sizes.schema["c"].dataType.simpleString()
    folded = by_size.groupBy("c").applyInPandas(lambda pdf: fold_sizes(pdf, ratios), f"c {kind}, n int, first long, one int, two int, three int, x int, y int, skip long, a long, b long")
    part = F.substring("o", 1, 9 if parity_rng else 3)
    placed = sizes.withColumn("p", part)
    counts = placed.groupBy("c", "n", "p").agg(F.count("*").alias("i"))
    before = F.coalesce(F.sum("i").over(Window.partitionBy("c", "n").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("c", "n", "p", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("c", "n", "p").orderBy("o", "k")) - 1
    placed = placed.withColumn("inside", inside).join(counts, ["c", "n", "p"]).join(folded, ["c", "n"])
    j = F.col("before") + F.col("inside")
    r = j - F.col("skip")
    late = F.pmod(r - F.col("a") - F.col("b"), F.lit(3))
    to = F.when(j < F.col("skip"), F.col("first") + j).when(r < F.col("a"), F.col("one"))
    to = to.when(r < F.col("a") + F.col("b"), F.when(F.pmod(r - F.col("a"), F.lit(2)) == 0, F.col("two")).otherwise(F.col("one")))
    to = to.otherwise(F.when(late == 0, F.col("three")).when(late == 1, F.col("x")).otherwise(F.col("y")))
    told = placed.select("c", "k", F.element_at(F.array(*map(F.lit, SPLITS)), to.cast("int") + 1).alias("split"))
    told = told.toDF("_c", "_k", "split")
    return df.drop("split").join(told, (F.col(class_col) == F.col("_c")) & (F.col(component).cast("string") == F.col("_k"))).drop("_c", "_k")


def fold_sizes(pdf: pd.DataFrame, ratios: tuple[float, float, float]) -> pd.DataFrame:
    """For a class's component sizes (c, n, m: how many), by falling size, where the m components go in their order.

    The first three of the class go to one split each (`skip` of this size, from `first` on). Of the rest each goes where most rows are missing. What is missing falls by n with
    each component, so that is a merge of three falling sequences: `a` go to the split that lacks most, `b` in turn to the second and first, all others
    in turn to the third, x and y."""
    pdf = pdf.sort_values("n", ascending=False)
    total, have, at, out = int((pdf.n * pdf.m).sum()), [0, 0, 0], 0, []
    for c, n, m in zip(pdf.c, pdf.n.tolist(), pdf.m.tolist()):
        first, skip = at, min(max(0, 3 - at), m)
        for k in range(skip):
            have[at + k] += n
        at += m
        key = lambda s, t, n=n: (have[s] + t * n - total * ratios[s], s)  # noqa: E731  smaller: more is missing
        one, two, three = sorted(range(3), key=lambda s: key(s, 0))
        ahead = lambda s, other: _until(lambda t: key(s, t) > key(other, 0), (key(other, 0)[0] - key(s, 0)[0]) // n)
        a, b1, b2 = ahead(one, two), ahead(one, three), ahead(two, three)
        b = b1 - a + b2
        x, y = sorted((one, two), key=lambda s: key(s, b1 if s == one else b2))
        out.append((c, n, first, one, two, three, x, y, skip, a, b))
        rest = m - skip
        alone, paired = min(a, rest), min(b, max(0, rest - a))
        turns = max(0, rest - a - b)
        for s, took in ((one, alone + paired // 2), (two, paired - paired // 2), (three, -(-turns // 3)), (x, (turns + 1) // 3), (y, turns // 3)):
            have[s] += n * took
    return pd.DataFrame(out, columns=["c", "n", "first", "one", "two", "three", "x", "y", "skip", "a", "b"])


def _until(passed: Callable[[int], bool], guess: float) -> int:
    """The first t from 0 on that has passed, near a guess."""
    t = max(0, int(guess) - 1)
    while t and passed(t - 1):
        t -= 1
    while not passed(t):
        t += 1
    return t


def ranked(df: DataFrame, keys: list[str], class_col: str, seed: int) -> DataFrame:
    """df with _rank, each row's place in its class in seeded order from 1, and _total, the class's rows.

    A class is dealt into 4,096 parts by the front of the seeded hash; ranks are counted inside a part and added to the
    sizes of the parts before it. A large class is so ranked by many tasks."""
    dealt = df.withColumn("_h", seeded(seed, *keys)).withColumn("_part", F.substring("_h", 1, 3))
    sizes = dealt.groupBy(F.col(class_col).alias("_c"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    by = Window.partitionBy("_c")
    sizes = sizes.withColumn("_before", F.sum("_n").over(by.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).withColumn("_total", F.sum("_n").over(by))
    inside = F.row_number().over(Window.partitionBy(class_col, "_part").orderBy("_h", *keys))
    joined = dealt.withColumn("_inside", inside).join(sizes, F.col(class_col).eqNullSafe(F.col("_c")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("_rank", F.col("_inside") + F.coalesce("_before", F.lit(0))).drop("_h", "_part", "_c", "_p", "_n", "_before", "_inside")


def _cut(rank: str, total: str, ratios: tuple[float, float, float]) -> Column:
    train, both = F.round(F.col(total) * ratios[0]), F.round(F.col(total) * (ratios[0] + ratios[1]))
    return F.when(F.col(rank) <= train, "train").when(F.col(rank) <= both, "val").otherwise("test")


def stratified_split(df: DataFrame, id: str = "image_id", class_col: str = "class_name", seed: int = 42, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """df with `split`: each class's rows cut by the ratios in seeded order."""
    check_ratios(ratios)
    return ranked(df, [id], class_col, seed).withColumn("split", _cut("_rank", "_total", ratios)).drop("_rank", "_total")


def group_split(df: DataFrame, group: str = "group_id", class_col: str = "class_name", seed: int = 42, ratios: tuple[float, float, float] = RATIOS) -> DataFrame:
    """df with `split`: each class's groups, not its rows, cut by the ratios in seeded order. Val and test are cut under the next seed."""
    check_ratios(ratios)
    groups = df.select(F.col(class_col).alias("c"), F.col(group).alias("k0")).distinct()
    first = ranked(groups, ["k0"], "c", seed).withColumn("train", F.col("_rank") <= F.round(F.col("_total") * ratios[0])).drop("_rank", "_total")
    val = ratios[1] / (ratios[1] + ratios[2])
    rest = ranked(first.where("not train"), ["k0"], "c", seed + 1)
    told = first.where("train").select("c", "k0", F.lit("train").alias("split"))
    told = told.unionByName(rest.select("c", "k0", F.when(F.col("_rank") <= F.round(F.col("_total") * val), "val").otherwise("test").alias("split")))
    told = told.toDF("_c", "_k", "split")
    return df.drop("split").join(told, (F.col(class_col) == F.col("_c")) & (F.col(group) == F.col("_k"))).drop("_c", "_k")


def generate(df: DataFrame, mode: str, seed: int = 42, ratios: tuple[float, float, float] = RATIOS, threshold: int = 10, need_all: bool = True) -> DataFrame:
    """A split by mode: phash+group, phash, group, group_shuffle or stratified. need_all: as in component_split, for modes with components."""
    from .components import constraint_components, phash_components

    if mode == "stratified":
        return stratified_split(df, seed=seed, ratios=ratios)
    if mode == "group_shuffle":
        return group_split(df, seed=seed, ratios=ratios)
    if mode == "group":
        return component_split(df, "group_id", seed=seed, ratios=ratios, need_all=need_all)
    if mode not in ("phash", "phash+group"):
        raise ValueError(f"unknown split mode: {mode}")
    df = phash_components(df, threshold)
    if mode == "phash":
        return component_split(df, "phash_component", seed=seed, ratios=ratios, need_all=need_all)
    return component_split(constraint_components(df), "constraint_component", seed=seed, ratios=ratios, need_all=need_all)
