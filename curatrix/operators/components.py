"""Near-duplicate pairs of 64-bit hashes, connected components, and components numbered within their class."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import distance, with_halves
from .validate import has_value

#: Rows of a class that meet in one block of the blocked join, about, and edges that a task holds.
BLOCK_ROWS, EDGES_A_TASK = 4096, 1 << 19
#: Rows of a part where bands are looked up, about, pairs that are compared or returned at once, and tasks at most.
BAND_ROWS, PAIRS_AT_ONCE, BAND_TASKS = 1 << 15, 1 << 18, 2000


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder of checkpoints; in a folder of its own only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared_path.own = base = getattr(shared_path, "own", None) or "file://" + tempfile.mkdtemp(prefix="curatrix-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder of checkpoints and read back: a loop's plan stays short and lost executors cost no more than their tasks."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks_for(rows: DataFrame, *by: str) -> int:
    """Into how many parts the largest group must be dealt, so that a part has about BLOCK_ROWS rows."""
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
    return -(-(most or 1) // BLOCK_ROWS)


def bands(rows: DataFrame, threshold: int, probes: bool, id: str, block: str | None) -> DataFrame:
    """(block, band, value, id) of each hash's four 16-bit bands; with `probes` also of all values that differ in threshold // 4 bits at most."""
    parts = [F.shiftright(F.col(h), s).bitwiseAND(0xFFFF) for h in ("hi", "lo") for s in (16, 0)]
    masks = [sum(1 << b for b in c) for r in range(threshold // 4 + 1 if probes else 1) for c in combinations(range(16), r)]
    values = [F.struct(F.lit(k).alias("band"), F.transform(F.array(*map(F.lit, masks)), lambda m, p=p: p.bitwiseXOR(m)).alias("values")) for k, p in enumerate(parts)]
    named = F.col(block) if block else F.lit(0)
    out = rows.select(F.col(id).alias("id"), named.alias("block"), F.explode(F.array(*values)).alias("b"))
    return out.select("id", "block", F.col("b.band").alias("band"), F.explode("b.values").alias("value"))


def near_by_bands(left: np.ndarray, right: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (x, y) of all 64-bit hashes of left and right that differ in `threshold` bits at most, each pair once; with `same` left is right, and x < y.

    A band's table has left's places by the band's value; right looks up all values within a quarter of the threshold. A pair counts
    in the first band that finds it."""
    radius = threshold // 4
    masks = [sum(1 << b for b in c) for n in range(radius + 1) for c in combinations(range(16), n)]
    part = lambda h, k: ((h >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
    for k in range(4):
        own, values = part(left, k), part(right, k)
        by, count = np.argsort(own, kind="stable"), np.bincount(own, minlength=1 << 16)
        start = np.cumsum(count) - count
        for mask in masks:
            probed = values ^ mask
            y = np.flatnonzero(count[probed])
            n = count[probed[y]]
            ends = np.cumsum(n)
            at = 0
            while at < len(y):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + PAIRS_AT_ONCE, "right")))
                m, low = n[at:to], start[probed[y[at:to]]]
                x = by[np.repeat(low - np.cumsum(m) + m, m) + np.arange(m.sum())]
                z = np.repeat(y[at:to], m)
                at = to
                differ = left[x] ^ right[z]
                found = np.bitwise_count(differ) <= threshold
                if same:
                    found &= x < z
                x, z, differ = x[found], z[found], differ[found]
                for e in range(k):
                    new = np.bitwise_count(part(differ, e)) > radius
                    x, z, differ = x[new], z[new], differ[new]
                if len(x):
                    yield x, z


def band_pairs(rows: DataFrame, threshold: int, blocks: int | None = None) -> DataFrame:
    """Pairs (l, r) of rows (id, pos, block, hi, lo) of one block whose hashes differ in `threshold` bits at most, each once, found by bands.

    Only rows are shuffled, once for each part that they meet; neighbourhoods and candidates stay inside a task, so no plan or join has them."""
    rows = rows.where("block is not null")
    found = rows.groupBy("block").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("n")).first()
    blocks = blocks or max(1, -(-(found.most or 0) // BAND_ROWS))
    part, others = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.sequence(F.lit(0), F.lit(blocks - 1))
    cell = lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j"), (F.col("part") > o).alias("second"))
    dealt = rows.withColumn("part", part).withColumn("c", F.explode(F.transform(others, cell))).select(*rows.columns, "c.*")
    tasks = max(1, min(found.n * blocks * (blocks + 1), BAND_TASKS))
    row = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.schema)
    names = rows.columns

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        hashes = t["hi"].to_numpy().astype(np.uint64) << np.uint64(32) | t["lo"].to_numpy().astype(np.uint64)
        second = t["second"].to_numpy()
        same = t["i"][0].as_py() == t["j"][0].as_py()
        first = np.flatnonzero(~second)
        then = first if same else np.flatnonzero(second)
        own = t.select(names)

        def batch(held: list) -> pa.RecordBatch:
            sides = [own.take(pa.array(places[np.concatenate(side)])).combine_chunks() for places, side in zip((first, then), zip(*held))]
            return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([s.column(c).chunk(0) for c in names], names) for s in sides], ["l", "r"])

        held, n = [], 0
        for x, y in near_by_bands(hashes[first], hashes[then], threshold, same):
            held.append((x, y))
            n += len(x)
            if n >= PAIRS_AT_ONCE // 4:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)

    return dealt.repartition(tasks, "block", "i", "j").groupBy("block", "i", "j").applyInArrow(pairs, f"l struct<{row}>, r struct<{row}>")


def hash_pairs(df: DataFrame, threshold: int, id: str = "image_id", text: str = "phash", block: str | None = "class_name", order: str | None = None, method: str = "auto", blocks: int | None = None) -> DataFrame:
    """(block, a, b, distance) of rows of one block whose hashes differ in `threshold` bits at most; a comes before b in the order.

    method bands: two hashes within the threshold are within a quarter of it in one of four bands, so looking up the
    bands' neighbourhoods finds all of them; fit for small thresholds. method blocks: all pairs of a block. Either way a block is
    dealt into `blocks` parts (if not given: of about BAND_ROWS or BLOCK_ROWS rows) that meet two by two, so a large class is spread over tasks. auto: bands up to 11."""
    order = order or id
    named = F.col(block) if block else F.lit("all")
    rows = with_halves(df, text).select(F.col(id).alias("id"), F.col(order).alias("pos"), named.alias("block"), "hi", "lo")
    before = F.col("l.pos") < F.col("r.pos")
    near = distance("l", "r") <= threshold
    if method == "bands" or method == "auto" and threshold <= 11:
        joined = band_pairs(rows, threshold, blocks).where("l.id <> r.id and l.pos <> r.pos")
    else:
        blocks = blocks or blocks_for(rows, "block")
        part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        grid = F.sequence(F.lit(0), F.lit(blocks - 1))
        # part i of the left side meets part j >= i of the right side; pairs of two parts meet once, in the order of their parts
        l = rows.withColumn("i", part).withColumn("j", F.explode(F.filter(grid, lambda x: x >= F.col("i")))).alias("l")
        r = rows.withColumn("j", part).withColumn("i", F.explode(F.filter(grid, lambda x: x <= F.col("j")))).alias("r")
        same = (F.col("l.block") == F.col("r.block")) & (F.col("l.i") == F.col("r.i")) & (F.col("l.j") == F.col("r.j"))
        once = F.when(F.col("l.i") == F.col("l.j"), before).otherwise(F.col("l.pos") != F.col("r.pos"))
        joined = l.join(r, same & once & near)
    first = F.col("l.pos") < F.col("r.pos")
    pick = lambda c: F.when(first, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}"))
    other = lambda c: F.when(first, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}"))
    return joined.select(F.col("l.block").alias("block"), pick("id").alias("a"), other("id").alias("b"), distance("l", "r").cast("int").alias("distance"))


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges (u, v) as stars of their own components: (id, smallest id)."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    u, v = (c.to_numpy() for c in table.columns)
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        if not (differ := x != y).any():
            break
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root != root[root]).any():
            root = root[root]
    other = root != np.arange(len(ids))
    kind = table.schema.types[0]
    yield pa.RecordBatch.from_arrays([pa.array(ids[other], kind), pa.array(ids[root[other]], kind)], ["u", "v"])


def connected(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, root) of all ids in edges; root is the smallest id that is reachable.

    Each round first replaces the edges of a task by stars, then hangs larger neighbours on the smallest one, and smaller ones. Both
    aggregate before they shuffle. It ends when one task has had all edges, or when nothing changes."""
    u, v = F.col("u"), F.col("v")
    now = cut(edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")))
    n, told = now.count(), None
    while n:
        parts = -(-n // EDGES_A_TASK)
        now = cut(now.coalesce(parts).mapInArrow(_stars, now.schema))
        if parts == 1:
            break
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = both.where(v > u).join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v")).distinct()
        lower = hung.groupBy("u").agg(F.min("v").alias("m"))
        turned = hung.join(lower, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        now = cut(turned.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (state.n, state.x) == told:
            break
        n, told = state.n, (state.n, state.x)
    return now.select(u.alias("id"), v.alias("root")).unionByName(now.select(v.alias("id"), v.alias("root")).distinct())


def number_components(df: DataFrame, root: Column, prefix: Column, out: str, order: str, class_col: str) -> DataFrame:
    """df with `out`: the prefix and four digits, components of a class counted by their first row in the order.

    Components are range-sorted and counted inside partitions, so no class is one task."""
    rooted = df.withColumn("_root", root)
    first = rooted.groupBy(class_col, "_root").agg(F.min(order).alias("_first"))
    placed = cut(first.orderBy(class_col, "_first").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    runs = placed.groupBy(class_col, "_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_low"))  # a row a class and partition
    earlier = Window.partitionBy(class_col).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(class_col, "_p", "_low", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    numbered = placed.join(runs, [class_col, "_p"]).select(class_col, "_root", (F.col("_before") + F.col("_m") - F.col("_low") + 1).cast("int").alias("_n"))
    joined = rooted.join(numbered, [class_col, "_root"])
    return joined.withColumn(out, F.concat(prefix, F.format_string("%04d", "_n"))).drop("_root", "_n")


def phash_components(df: DataFrame, threshold: int = 10, class_col: str = "class_name", id: str = "image_id", order: str | None = None, out: str = "phash_component", blocks: int | None = None) -> DataFrame:
    """df with the near-duplicate component of each row in its class. Rows without a valid hash are alone; a table without any hash is an error."""
    if not has_value(df, "phash"):
        raise ValueError("no phash has a value: near-duplicate components can't be built")
    pairs = hash_pairs(df, threshold, id, "phash", class_col, order, blocks=blocks)
    roots = connected(pairs).toDF(id, "_near")
    joined = df.join(roots, id, "left")
    return number_components(joined, F.coalesce("_near", id), F.concat(F.col(class_col), F.lit("::phash_")), out, order or id, class_col).drop("_near")


def constraint_components(df: DataFrame, group_col: str = "group_id", component_col: str | None = "phash_component", class_col: str = "class_name", id: str = "image_id", order: str | None = None, out: str = "constraint_component") -> DataFrame:
    """df with components of a class over rows that share a group or a near-duplicate component.

    Every row is tied to its keys (a star), never to all rows with the same key."""
    keys = [F.concat_ws("\u0001", F.lit(k), F.col(class_col), F.col(c)) for k, c in (("g", group_col), ("p", component_col)) if c]
    node = F.concat_ws("\u0001", F.lit("r"), F.col(id))
    edges = df.select(node.alias("a"), F.explode(F.array(*keys)).alias("b"))
    roots = connected(edges).where(F.col("id").startswith("r\u0001")).select(F.substring("id", 3, 1 << 20).alias("_row"), F.col("root").alias("_tied"))
    joined = df.join(roots, F.col(id).cast("string") == F.col("_row"), "left").drop("_row")
    return number_components(joined, F.col("_tied"), F.concat(F.col(class_col), F.lit("::constraint_")), out, order or id, class_col).drop("_tied")
