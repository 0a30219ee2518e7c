"""Chat formatting in budgeted, turn-aligned windows.

A conversation's turns, in order, are written in a template with control strings around each turn. Prefix sums of the turns' tokens
cut a conversation into spans of whole turns: each window has the system turn again, then as many whole turns before its span as fit the
history, then its span. Only assistant texts of the span are targets; repeated ones are masked, so every
assistant text is a target once.

Control strings inside texts and roles are escaped with a backslash that unescaping takes away again, so texts come back unchanged.
Turns are ordered by turn, then role and text; ties and repeated rows are separate turns. Null texts and roles are empty, null turns come
first, a null conversation is one of its own. A turn longer than the budget has a window of its own and is not cut. Columns beyond the four are ignored.
An empty table gives no windows. Sums cross partitions by a total for each partition, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import VOCAB, encoded, encoder
from .common import Scratch, partitions

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 2048, 512
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S))


def template(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its text begins and ends there, in code points."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a window."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def _written(rows: DataFrame, vocab: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                made = [template(r or "", t or "") for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
                tokens = [len(x) for x in encoded(encoder(vocab), [m[0] for m in made])]
                cols = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *cols, pa.array(tokens, pa.int64())], ["conv", "turn", "role", "formatted", "lo", "hi", "tokens"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("conv", "turn")]
    return rows.mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, role string, formatted string, lo long, hi long, tokens long")


def _summed(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows with nth, their place in their conversation from 0, and begin, the tokens before them there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, now, nth, total = TaskContext.get().partitionId(), object(), 0, 0
        for b in batches:
            n, begin = [], []
            for conv, tokens in zip(b.column(0).to_pylist(), b.column(6).to_pylist()):
                if conv != now:
                    now, nth, total = conv, 0, 0
                n.append(nth)
                begin.append(total)
                nth, total = nth + 1, total + tokens
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([pid] * b.num_rows, pa.int32()), pa.array(n, pa.int64()), pa.array(begin, pa.int64())], [*b.schema.names, "pid", "nth", "begin"])

    order = ("conv", "turn", "role", "formatted")
    ranged = rows.repartitionByRange(partitions(scratch.spark), *order[:3], F.xxhash64("formatted")).sortWithinPartitions(*order[:3], F.xxhash64("formatted"), "formatted")
    local = scratch.put(ranged.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", pid int, nth long, begin long"))
    totals = local.groupBy("conv", "pid").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    earlier = Window.partitionBy("conv").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that a conversation is in
    before = totals.select(F.col("conv").alias("c"), F.col("pid").alias("p"), F.sum("n").over(earlier).alias("n0"), F.sum("t").over(earlier).alias("t0")).where("n0 is not null")
    out = local.join(before, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pid") == F.col("p")), "left")
    return out.withColumn("nth", F.col("nth") + F.coalesce("n0", F.lit(0))).withColumn("begin", F.col("begin") + F.coalesce("t0", F.lit(0))).drop("c", "p", "n0", "t0", "pid")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, vocab: str = VOCAB, target: str = "assistant") -> DataFrame:
    """Windows: (conv, window, formatted, n_tokens, n_repeated, targets): how many turns at a window's head are repeated, and the
    spans of code points of its targets' texts. Windows of a conversation are numbered upwards, with holes."""
    scratch = Scratch(df.sparkSession, "chat")
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.col(text).alias("text"))
    written = scratch.put(_written(rows, vocab))  # else the sampling of ranges tokenises all turns once more
    turns = scratch.put(_summed(scratch, written))
    scratch.drop(written)
    # places are worked out on narrow rows; texts move once they are known
    narrow = turns.select("conv", "nth", "begin", "tokens")
    system = turns.where("nth = 0 and role = 'system'").select(F.col("conv").alias("c"), F.col("tokens").alias("sys"))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce("sys", F.lit(0)))
    own = narrow.join(system, F.col("conv").eqNullSafe(F.col("c")), "left").withColumn("k", F.floor(F.col("begin") / room))
    across = F.col("begin") + F.col("tokens") > (F.col("k") + 1) * room  # lies over a cut: a span of its own
    own = scratch.put(own.select("conv", "nth", "begin", "sys", (2 * F.col("k") + across.cast("long")).alias("window")))
    spans = own.groupBy("conv", "window").agg(F.min("begin").alias("from"), F.min("nth").alias("first"), F.first("sys").isNotNull().alias("has"))
    # turns that end at most `history` tokens before a span begins: joined by place on a grid of that width
    grid = lambda c: F.floor(c / F.lit(max(1, history)))
    end = F.col("begin") + F.col("tokens")
    ahead = narrow.where(F.col("tokens") <= history).withColumn("g", F.explode(F.array(grid(end), grid(end) + 1)))
    heads = spans.select(F.col("conv").alias("c"), "window", "from", "first", "has", grid(F.col("from")).alias("h"))
    near = F.col("c").eqNullSafe(F.col("conv")) & (F.col("g") == F.col("h")) & (F.col("nth") < F.col("first")) & (F.col("begin") >= F.col("from") - history) & ~(F.col("has") & (F.col("nth") == 0))
    repeated = F.lit(True).alias("again")
    places = own.select("conv", "nth", "window", F.lit(False).alias("again"))
    places = places.unionByName(heads.join(ahead, near).select("conv", "nth", "window", repeated))
    places = places.unionByName(spans.where("has and first > 0").select("conv", F.lit(0).cast("long").alias("nth"), "window", repeated))
    texts = turns.select(F.col("conv").alias("c"), F.col("nth").alias("n"), "formatted", "lo", "hi", "role", "tokens")
    full = places.join(texts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("nth") == F.col("n")))
    full = full.groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("nth", "again", "formatted", "lo", "hi", "role", "tokens"))).alias("all"))  # a window's turns
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["formatted"])).alias("at"),
        F.when((t["role"] == target) & ~t["again"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["lo"]).alias("begin"), (acc["at"] + t["hi"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return full.select(
        F.col("conv").alias(conv),
        "window",
        F.array_join(F.transform("all", lambda t: t["formatted"]), "").alias("formatted"),
        F.aggregate("all", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
        F.size(F.filter("all", lambda t: t["again"])).alias("n_repeated"),
        F.aggregate("all", start, step, lambda a: a["spans"]).alias("targets"),
    )
