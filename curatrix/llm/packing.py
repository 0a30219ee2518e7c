"""Bulk-synchronous best-fit packing of token pieces into sequences of a fixed capacity.

A round range-sorts the unplaced pieces and the open gaps by size together. Every partition sweeps its
own part upwards: a gap takes the largest piece met so far that still fits, and goes on filling while
pieces of its partition fit. What a partition could not match meets across partitions by rank: the counts
left in each partition say which gap takes which piece. Then gaps are updated and the next round begins.
When ranks match too little, the longest pieces left open new sequences, again all at once: a prefix sum over
the sorted pieces cuts them into runs, and the pieces that lie across a cut stay for the next rounds. Rounds go on until no
piece is left, at every size of table.

Null and empty texts become a piece of one end token. Ties and repeated rows are separate pieces. A piece of
more than half the capacity has a sequence of its own, whose rest is a gap; longer documents are cut, so no piece is longer than the capacity.
Very long texts are many pieces. Columns of items called sequence_id, offset or _uid are no matter: the first two are replaced, the last is kept.
An empty table gives no rows. State tables live in the shared folder, so lost executors only repeat tasks.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCAB, Encoder, build_lexicon, encoded, encoder
from .common import Scratch, ship

CAPACITY, END = 4096, 1
#: Rows of state a task should have about.
ROWS_A_TASK = 100_000
#: Where ranks match less than this share of the pieces left, sequences are opened: for the longest pieces up to half their length, or
#: for all if they are this part of the capacity at most.
WORTH, SHORT = 0.05, 1 / 32
#: Rows of state. tag: D a piece, G a gap, P a piece that is placed, U a gap that was filled, C counts of a partition.
STATE = "tag string, id long, seq long, size long, at long"
SWEPT = STATE + ", pid int, nth long"


def pieces(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB, capacity: int = CAPACITY, end: int = END, lexicon: bytes | None = None, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32 and, if asked for, ids) of each document's tokens and end token, cut only beyond capacity."""
    ship(df.sparkSession)
    lexicon = build_lexicon(df, text, vocab) if lexicon is None else lexicon
    block = df.sparkSession.sparkContext.broadcast(lexicon)
    closing, wide = end.to_bytes(4, "little"), 4 * capacity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc: Encoder = encoder(vocab, block.value)
        for b in batches:
            keys, out = b.column(0).to_pylist(), ([], [], [], [], [], [])
            for k, found in enumerate(encoded(enc, b.column(1).to_pylist())):
                buf = found.astype("<i4").tobytes() + closing
                for n, at in enumerate(range(0, len(buf), wide)):
                    part = buf[at : at + wide]
                    row = (keys[k], n, at // 4, len(part) // 4, zlib.crc32(part), np.frombuffer(part, "<i4") if ids else None)
                    for col, v in zip(out, row):
                        col.append(v)
            kinds = (b.schema.types[0], pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            cols = [pa.array(c, t) for c, t in zip(out, kinds)][: 5 + ids]
            yield pa.RecordBatch.from_arrays(cols, [key, "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


@functools.cache
def classes_from(capacity: int) -> list[int]:
    """The least sizes of classes of sizes, eight to an octave."""
    return sorted({int(2 ** (k / 8)) for k in range(8 * capacity.bit_length() + 1)})


def sweep(rows: Iterable[tuple[str, int, int]], capacity: int, pid: int) -> list[tuple]:
    """Matches one sorted partition of (tag, id, size), tag D for a piece and G for a gap, upwards by size.

    Returns rows of SWEPT: P placed pieces, U gaps that were filled, D and G what is left, with ranks; a D's `at` is the size of all D of higher rank.
    C rows hold, for each class of sizes (id), the number (seq) and sum (size) of the pieces left, and for id -1 the gaps left (seq) and the largest (size)
    and smallest (at) piece left."""
    steps, out, left = classes_from(capacity), [], []
    held: dict[int, list[int]] = {}
    sizes = 0  # bit k is set while pieces of size k are held
    for tag, i, size in rows:
        if tag == "D":
            held.setdefault(size, []).append(i)
            sizes |= 1 << size
            continue
        gap = size
        while gap > 0 and (fit := sizes & ((2 << gap) - 1)):
            k = fit.bit_length() - 1
            out.append(("P", held[k].pop(), i, k, capacity - gap, pid, 0))
            if not held[k]:
                del held[k]
                sizes ^= 1 << k
            gap -= k
        if gap < size:
            out.append(("U", i, i, gap, 0, pid, 0))
        else:
            left.append(("G", i, i, gap, 0, pid, len(left)))
    # a gap is only left when no piece below it was, so all pieces left come after all gaps left
    rest = [(size, i) for size in sorted(held) for i in held[size]]
    above, docs, classes = 0, [], {}
    for n in range(len(rest) - 1, -1, -1):
        size, i = rest[n]
        docs.append(("D", i, 0, size, above, pid, n))
        above += size
        of = classes.setdefault(bisect.bisect_right(steps, size), [0, 0])
        of[0] += 1
        of[1] += size
    counts = [("C", k, n, total, 0, pid, 0) for k, (n, total) in classes.items()]
    return out + left + docs + counts + [("C", -1, len(left), rest[-1][0] if rest else 0, rest[0][0] if rest else 0, pid, 0)]


def intervals(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Ranks matched across partitions: (pid of pieces, first, last, pid of gaps, a number that piece and gap rank add up to).

    counts: by partition, gaps left and pieces left. Each gap takes the largest piece left of lower partitions."""
    stack, out = [], []
    for q in sorted(counts):
        gaps, docs = counts[q]
        nth = 0
        while nth < gaps and stack:
            p, n = stack.pop()
            took = min(n, gaps - nth)
            out.append((p, n - took, n - 1, q, n - 1 + nth))
            nth += took
            if n > took:
                stack.append((p, n - took))
        if docs:
            stack.append((q, docs))
    return out


def _parts(n: int) -> int:
    return max(1, -(-n // ROWS_A_TASK))


def _swept(scratch: Scratch, state: DataFrame, n: int, capacity: int) -> DataFrame:
    """The range-sorted state after the sweep of each of its partitions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3))))
        found = sweep(rows, capacity, TaskContext.get().partitionId())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], [x.split()[0] for x in SWEPT.split(", ")])

    tie = F.xxhash64("id")
    rows, parts = state.where("tag in ('D', 'G')").select("tag", "id", "size"), _parts(n)
    ranged = rows.repartitionByRange(parts, "size", "tag", tie) if parts > 1 else rows.coalesce(1)  # what one task holds needs no exchange
    return scratch.put(ranged.sortWithinPartitions("size", "tag", tie).mapInArrow(run, SWEPT))


def _zero() -> Column:
    return F.lit(0).cast("long")


def _matched(swept: DataFrame, between: list[tuple], capacity: int) -> DataFrame:
    """The next state: pieces and gaps left are paired by their ranks in the intervals."""
    told = swept.sparkSession.createDataFrame(pd.DataFrame(between, columns=["p", "lo", "hi", "q", "total"]), "p int, lo long, hi long, q int, total long")  # two rows a partition at most
    docs, gaps = (swept.where(F.col("tag") == t) for t in "DG")
    docs = docs.join(told, (docs.pid == told.p) & docs.nth.between(told.lo, told.hi), "left").select("id", "size", "q", (F.col("total") - F.col("nth")).alias("m"))
    gaps = gaps.select(F.col("pid").alias("q"), F.col("nth").alias("m"), F.col("id").alias("seq"), F.col("size").alias("gap"))
    pairs = docs.where("q is not null").join(gaps, ["q", "m"], "full")
    placed = F.when(F.col("id").isNotNull(), F.struct(F.lit("P").alias("tag"), "id", "seq", F.col("size"), (F.lit(capacity) - F.col("gap")).alias("at")))
    room = F.col("gap") - F.coalesce("size", F.lit(0))
    after = F.when(room > 0, F.struct(F.lit("G").alias("tag"), F.col("seq").alias("id"), "seq", room.alias("size"), _zero().alias("at")))
    rows = pairs.select(F.explode(F.array_compact(F.array(placed, after))).alias("r")).select("r.*")
    return rows.unionByName(docs.where("q is null").select(F.lit("D").alias("tag"), "id", _zero().alias("seq"), "size", _zero().alias("at")))


def _opened(swept: DataFrame, base: list[tuple[int, int]], longer_than: int, capacity: int) -> DataFrame:
    """The next state: the pieces longer than that are cut into runs, as many to a new sequence as fit between two cuts. base: the size of such pieces in all
    higher partitions."""
    told = swept.sparkSession.createDataFrame(pd.DataFrame(base, columns=["pid", "base"]), "pid int, base long")  # a row a partition
    chosen = swept.where((F.col("tag") == "D") & (F.col("size") > longer_than)).join(told, "pid").select("id", "size", (F.col("base") + F.col("at")).alias("begin"))
    cut = chosen.withColumn("bin", F.floor(F.col("begin") / capacity)).withColumn("fits", F.col("begin") + F.col("size") <= (F.col("bin") + 1) * capacity)
    run = Window.partitionBy("bin").orderBy(~F.col("fits"), "begin")  # the pieces of one sequence, and one across its end
    whole = Window.partitionBy("bin")
    full = F.sum(F.when(F.col("fits"), F.col("size"))).over(whole)
    cut = cut.withColumns({"nth": F.row_number().over(run), "seq": F.first("id").over(run), "first": F.first("begin").over(run), "room": F.lit(capacity) - full})
    piece = F.when(F.col("fits"), F.struct(F.lit("P").alias("tag"), "id", "seq", "size", (F.col("begin") - F.col("first")).alias("at"))).otherwise(F.struct(F.lit("D").alias("tag"), "id", _zero().alias("seq"), "size", _zero().alias("at")))
    gap = F.when((F.col("nth") == 1) & (F.col("room") > 0), F.struct(F.lit("G").alias("tag"), F.col("seq").alias("id"), "seq", F.col("room").alias("size"), _zero().alias("at")))
    rows = cut.select(F.explode(F.array_compact(F.array(piece, gap))).alias("r")).select("r.*")
    rest = (F.col("tag") == "G") | ((F.col("tag") == "D") & (F.col("size") <= longer_than))
    return rows.unionByName(swept.where(rest).select("tag", "id", "seq", "size", _zero().alias("at")))


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset: sequences have no holes and at most `capacity` tokens.

    Lengths lie between 1 and capacity. Columns of items that are called sequence_id or offset are replaced."""
    spark: SparkSession = items.sparkSession
    scratch = Scratch(spark, "pack")
    uid = "_uid"
    while uid in items.columns:
        uid += "_"
    items = scratch.put(items.drop("sequence_id", "offset").withColumn(uid, F.monotonically_increasing_id()))
    size = F.col(length).cast("long")
    row = lambda tag, room, seq: F.struct(F.lit(tag).alias("tag"), F.col(uid).alias("id"), seq.alias("seq"), room.alias("size"), _zero().alias("at"))
    alone = F.array(row("P", size, F.col(uid)), row("G", F.lit(capacity) - size, F.col(uid)))
    state = items.select(F.explode(F.when(2 * size > capacity, alone).otherwise(F.array(row("D", size, _zero())))).alias("r")).select("r.*").where("size > 0")
    states, n, steps = [state], items.count(), classes_from(capacity)
    while n:
        swept = _swept(scratch, state, n, capacity)
        states.append(swept)
        counts, sums, left, least, most = {}, {}, 0, capacity, 0
        for r in swept.where("tag = 'C'").collect():  # a row for each class of sizes in each partition
            of = counts.setdefault(r.pid, [0, 0])
            if r.id < 0:
                of[0], least, most = r.seq, min(least, r.at or least), max(most, r.size)
            else:
                of[1] += r.seq
                left += r.seq
                sums.setdefault(r.pid, []).append((r.id, r.size))
        if not left:
            break
        between = intervals(counts)
        if sum(hi - lo + 1 for _, lo, hi, _, _ in between) >= WORTH * left:
            new = _matched(swept, between, capacity)
        else:
            from_ = bisect.bisect_left(steps, most // 2 + 1)  # the first class of pieces longer than half the longest
            from_ = -1 if most <= capacity * SHORT or from_ == len(steps) else from_
            total, base = 0, []
            for pid in sorted(counts, reverse=True):
                base.append((pid, total))
                total += sum(size for k, size in sums.get(pid, ()) if k > from_)
            new = _opened(swept, base, steps[from_] - 1 if from_ >= 0 else 0, capacity)
        filled = swept.where("tag = 'U'").select(F.lit("G").alias("tag"), "id", "seq", "size", "at")
        new = new.unionByName(filled).where((F.col("tag") != "G") | (F.col("size") >= least))  # smaller gaps are of no more use
        state = scratch.put(new.coalesce(_parts(n)))
        states.append(state)
        n = left + sum(g for g, _ in counts.values())
    paths = [s._scratch_path for s in states[1:]]
    where = states[0].where("tag = 'P'")
    if paths:
        where = where.unionByName(spark.read.schema(STATE).parquet(*paths).where("tag = 'P'"))
    placed = where.select(F.col("id").alias(uid), F.col("seq").alias("sequence_id"), F.col("at").alias("offset"))
    return items.join(placed, uid).drop(uid)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocab: str = VOCAB, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: key, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(df, key, text, vocab, capacity), "length", capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
