"""Near-duplicate detection: b-bit MinHash signatures and a multi-index Hamming join.

A signature has LANES minimum hashes of LANE_BITS bits each; the distance of two signatures is the number of lanes
that differ. Signatures are split into chunks of CHUNK lanes. Two signatures that differ in at most REACH lanes
differ in at most one lane of some chunk (pigeonhole), so each chunk is indexed once for every lane that
may be wrong, without that lane: pairs within REACH share an index key, without exception. At a similarity of 0.8 a
pair misses all keys with a probability under 1e-7. All pairs that share a key, also those beyond REACH, are compared on their full
shingle sets, unless the sizes of their sets alone rule the similarity out.

Documents with equal sets are one node. In keys with more than FEW nodes not all pairs are made: all nodes are
compared with two of the key's nodes, linked nodes are joined into components, and only
nodes outside the key's main component are then compared with all others of like size, in blocks, with inverted lists. That finds
every component that all pairs would give.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return, after lower-casing A-Z.
Shingles are compared by 64-bit hashes. Words of over LONG bytes enter them by a cryptographic digest, shorter ones by a polynomial.
A document with fewer words than a shingle has its whole sequence as its shingle. Null, empty or blank texts have an empty set
and are linked with nothing. Rows with the same key and text are separate rows with the same component. A null key never is a component's
smallest; a component with null keys only has a null id. Columns beyond key and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected

LANES, LANE_BITS, CHUNK = 40, 20, 4
#: Any pair within this distance shares a key: one wrong lane a chunk at most in some chunk.
REACH = 2 * (LANES // CHUNK) - 1
#: Keys of so many nodes at most give all their pairs; shingles that a block's sets have on either side in larger ones, about.
FEW, BLOCK = 8, 1 << 18
#: Bytes of text hashed at once, and rows that are handed on at once.
CHUNK_BYTES, ROWS = 1 << 19, 512
#: Bytes of a word from which on it is digested: a polynomial's collisions are easily made for long words.
LONG = 32

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=_U)
_BYTE[65:91] = _BYTE[97:123]  # lower-casing
_SEP = np.zeros(256, bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_P = _U(0x9E3779B97F4A7C15)
_PINV = _U(pow(int(_P), -1, 2**64))
_PLACE = _RNG.integers(1, 2**63, 64, dtype=_U) | _U(1)
_MUL = _RNG.integers(1, 2**63, LANES, dtype=_U) | _U(1)
_XOR = _RNG.integers(1, 2**63, LANES, dtype=_U)
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _pow(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
        _powers[:] = [np.cumprod(np.r_[_U(1), np.full(size, x, _U)]) for x in (_P, _PINV)]
    return _powers


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's k-word shingles."""
    data = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
    offs = np.cumsum([0, *(len(t) + 1 for t in texts)])
    power, inverse = _pow(len(data) + 1)
    sums = np.cumsum(_BYTE[data] * power[: len(data)])
    sep = _SEP[data]
    edge = np.flatnonzero(np.diff(np.r_[True, sep, True].view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    words = sums[ends - 1] - np.where(starts > 0, sums[starts - 1], _U(0)) if len(starts) else np.zeros(0, _U)
    words = _mix(words * inverse[starts] + (ends - starts).astype(_U))
    if len(long := np.flatnonzero(ends - starts > LONG)):
        low = data.tobytes().lower()
        words[long] = np.frombuffer(b"".join(hashlib.blake2b(low[i:j], digest_size=8).digest() for i, j in zip(starts[long].tolist(), ends[long].tolist())), _U)
    n = max(0, len(words) - k + 1)
    hashed = np.zeros(n, _U)
    for i in range(k):
        hashed += words[i : i + n] * _PLACE[i]
    hashed = _mix(hashed)
    at = np.searchsorted(starts, offs)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            yield np.unique(hashed[a : b - k + 1])
        elif b > a:
            yield _mix(np.sum(words[a:b] * _PLACE[: b - a], keepdims=True) + _U(b - a))
        else:
            yield np.zeros(0, _U)


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(LANES, np.iinfo(_U).max, _U)
    for i in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[i : i + 2048, None] ^ _XOR) * _MUL).min(0))
    return (_mix(low) >> _U(64 - LANE_BITS)).astype(np.int32)


def pack_set(hashes: np.ndarray) -> bytes:
    return np.sort(hashes).astype("<u8").tobytes()


def unpack_set(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u8")


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > CHUNK_BYTES:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t) + 1
    if part:
        yield part


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for part in _chunks([t or b"" for t in column.cast(pa.binary()).to_pylist()]):
        yield from shingle_sets(part, k)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """docs (key, text, th) as (key, th, d1, d2, n, lanes): the set's digest, its size and its signature (null for an empty set)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            n, lanes, digests = [], [], []
            for h in _sets(b.column(1), k):
                n.append(len(h))
                digests.append(_digest(h))
                lanes.append(signature(h) if len(h) else None)
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(n, pa.int64()), pa.array(lanes, pa.list_(pa.int32()))], ["key", "th", "d1", "d2", "n", "lanes"]
            )

    return docs.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, th long, d1 long, d2 long, n long, lanes array<int>")


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def packed_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs (id, text) as (id, n, packed): the full sets, eight bytes a shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = list(_sets(b.column(1), k))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array([pack_set(h) for h in sets], pa.binary())], ["id", "n", "packed"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, packed binary")


def _similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def _confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, na, nb, sa, sb) that are similar, as (u, v)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            us, vs, last, left = [], [], None, None
            rows = zip(*(b.column(i).to_pylist() for i in range(6)))
            for u, v, na, nb, sa, sb in rows:
                if 100 * min(na, nb) < percent * max(na, nb):
                    continue
                if u != last:
                    last, left = u, unpack_set(sa)
                right = unpack_set(sb)
                at = np.minimum(np.searchsorted(left, right), len(left) - 1)
                if _similar(int((left[at] == right).sum()), na, nb, percent):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return pairs.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "u long, v long")


def block_links(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Rows (id, comp, n, packed, side) of one block: similar pairs of an x row and a y row of other components, one for each x and component."""
    x, y = (pdf[pdf.side == s].reset_index(drop=True) for s in "xy")
    out = []
    if len(x) and len(y):
        sets = [unpack_set(p) for p in y.packed]
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(y)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        ny, cy, iy = y.n.to_numpy(), y.comp.to_numpy(), y.id.to_numpy()
        for i, c, n, packed in zip(x.id, x.comp, x.n, x.packed):
            s = unpack_set(packed)
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            size = hi - lo
            at = np.repeat(lo - np.cumsum(np.r_[0, size[:-1]]), size) + np.arange(size.sum())
            shared = np.bincount(owner[at], minlength=len(y))
            hit = np.flatnonzero((100 * shared >= percent * (n + ny - shared)) & (cy != c))
            _, first = np.unique(cy[hit], return_index=True)
            out += [(i, j) for j in iy[hit[first]]]
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _band(n: str, percent: int):
    """A set's place on a scale of sizes on which similar sets are at most one step apart."""
    return F.floor(F.ln(n) / (max(0.0, math.log(100 / max(1, percent))) + 1e-3)).cast("int")


def _keys() -> list:
    """The index keys of a signature: every chunk without one of its lanes."""
    out = []
    for c in range(0, LANES, CHUNK):
        for wrong in range(CHUNK):
            out.append(F.xxhash64(F.lit(c * CHUNK + wrong), *[F.col("lanes")[c + i] for i in range(CHUNK) if i != wrong]))
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept, text_hash, group): for each row its set's size and the smallest key it is linked to, itself included.

    group: the number of the row's component, also where several share their smallest key; null for an empty set.
    Documents are linked when 100 * intersection >= percent * union of their k-word shingle sets. kept: the row has the smallest key."""
    spark: SparkSession = df.sparkSession
    scratch = Scratch(spark, "near")
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    prints = scratch.put(fingerprints(docs, k))
    mark = F.xxhash64("key", "th")
    grouped = prints.where("n > 0").groupBy("d1", "d2").agg(F.min("key").alias("least"), F.min(mark).alias("mark"), F.first("n").alias("n"), F.first("lanes").alias("lanes"))
    nodes = scratch.put(grouped.withColumn("id", F.monotonically_increasing_id()))  # numbered as they are written, once
    index = nodes.select("id", "n", F.explode(F.array(*_keys())).alias("bucket"))
    shared = index.groupBy("bucket").agg(F.count("*").alias("c"), F.min("id").alias("low"), F.max("id").alias("high")).where("c > 1")
    members = scratch.put(index.join(shared, "bucket"))

    few, many = members.where(F.col("c") <= FEW), members.where(F.col("c") > FEW)
    met = few.groupBy("bucket").agg(F.collect_list(F.struct("id", "n")).alias("m"))
    like = f"x.id < y.id and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    pairs = met.select(F.expr(f"explode(flatten(transform(m, x -> transform(filter(m, y -> {like}), y -> struct(x.id as a, y.id as b)))))").alias("p")).select("p.*")
    stars = many.select(F.explode(F.array("low", "high")).alias("a"), F.col("id").alias("b")).where("a <> b")
    pairs = scratch.put(pairs.unionByName(stars).distinct())

    # the text of one row of each node that is met: rows that repeat it are dropped where they meet
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(nodes.select("id", "mark"), "id")
    sets = scratch.put(packed_sets(docs.withColumn("mark", mark).join(wanted, "mark").dropDuplicates(["id"]), k))
    side = lambda p: sets.select(F.col("id").alias(p), F.col("n").alias(f"n{p}"), F.col("packed").alias(f"s{p}"))
    links = scratch.put(_confirm(pairs.join(side("b"), "b").join(side("a"), "a"), percent))
    first = connected(scratch, links)

    # keys whose nodes aren't all in one component: those outside the main one meet all others of like size
    named = scratch.put(many.select("bucket", "id", "n").join(first, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("comp")))
    counts = named.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("c", "comp")).getField("comp").alias("main"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
    open_ = named.join(main, "bucket").withColumn("band", _band("n", percent))
    xs = open_.where("comp != main").withColumn("band", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])))
    sizes = xs.groupBy("bucket", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("nx")).join(open_.groupBy("bucket", "band").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("ny")), ["bucket", "band"])
    own = lambda m: F.pmod(F.xxhash64("id"), m).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    cols = ["bucket", "band", "id", "comp", "side", "i", "j"]
    ys = open_.join(sizes, ["bucket", "band"]).withColumns({"side": F.lit("y"), "j": own("ny")}).withColumn("i", every("nx")).select(cols)
    xs = xs.join(sizes, ["bucket", "band"]).withColumns({"side": F.lit("x"), "i": own("nx")}).withColumn("j", every("ny")).select(cols)
    rows = xs.unionByName(ys).join(sets, "id")
    more = scratch.put(rows.groupBy("bucket", "band", "i", "j").applyInPandas(lambda pdf: block_links(pdf, percent), "u long, v long"))
    linked = connected(scratch, first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more)) if not more.isEmpty() else first

    linked = linked.join(nodes.select("id", "least"), "id")
    lowest = linked.groupBy("component").agg(F.min("least").alias("lowest"))
    linked = linked.join(lowest, "component").select("id", "lowest", "component")
    of = nodes.select("d1", "d2", "id", "least").join(linked, "id", "left").select("d1", "d2", F.coalesce("lowest", "least").alias("component_id"), F.coalesce("component", "id").alias("group"))
    out = prints.select("key", "th", "d1", "d2", "n").join(of, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    scratch.drop(sets, members, pairs, links, named, more)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), F.col("th").alias("text_hash"), "group")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """df with one row of each group of near duplicates: the one with the smallest key. Of rows with that key and text, one stays; of that key's
    texts in one group, the one with the smallest hash. Unlike texts stay, also under one key.

    Rows with a null key stay unless a row with a key is in their group."""
    found = near_duplicates(df, key, text, k, percent).where("kept")
    free = lambda name: next(n for n in (name + "_" * k for k in range(len(df.columns) + 1)) if n not in df.columns)
    it, its, null = map(free, ("_key", "_hash", "_null"))
    alone = F.when(F.col(key).isNull() | F.col("group").isNull(), F.col("text_hash")).alias("_alone")
    found = found.groupBy(F.col(key).alias(it), "group", alone).agg(F.min("text_hash").alias(its)).select(it, its)
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kept = df.join(found, F.col(key).eqNullSafe(F.col(it)) & (hashed == F.col(its)), "left_semi")
    if not _repeated(df, key):
        return kept
    once = kept.where(F.col(key).isNotNull()).withColumns({its: hashed, null: F.col(text).isNull()}).dropDuplicates([key, its, null]).drop(its, null)
    return once.unionByName(kept.where(F.col(key).isNull()))


def _repeated(df: DataFrame, key: str) -> bool:
    return not df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()
