"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, by the forward algorithm over its bytes; a text's is the product over its words (runs of letters,
in lower case). The probabilities come from expectation maximisation over the words of labelled rows. Distinct words are scored
once and many at a time, so a text costs a lookup for each of its words; every word of the whole text counts.

Null texts and texts without a letter, and all texts if no row is labelled, are `und` with score 0. Ties go to the first language by name.
Very long words and texts are scored whole. Repeated rows get equal results. Other columns are kept; ones named like the results are replaced.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCAB, Known, Splitter, Words, byte_chars, chunks, numbered, vocab_path
from .common import Scratch, partitions, ship
from .u64map import U64Map

#: Labelled rows of each language that training reads, about, and words of them that a task sums at once.
TRAIN_ROWS, HELD = 1500, 1 << 16
ITERATIONS, SMOOTHING = 5, 0.01
#: Bytes of the longest piece whose key in a map is its bytes in one 64-bit number; longer ones are found by their first bytes.
LONGEST = 8
#: A score is the posterior that a passage of so many of a text's words would have.
PASSAGE = 20
REMEMBERED = 300_000


@dataclass
class Vocabulary:
    """Pieces that don't end a word and pieces that do, by their bytes. heads: the first LONGEST bytes of longer pieces, whose
    numbers tails has by head: by their bytes, and whether they end a word."""

    inner: U64Map
    closing: U64Map
    size: int
    heads: U64Map
    tails: list[dict[tuple[bytes, bool], int]]
    reach: int


def vocabulary(vocab: str) -> Vocabulary:
    """All pieces."""
    with open(vocab_path(vocab), encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, byte = model["end_of_word_suffix"], {c: b for b, c in enumerate(byte_chars())}
    keys: tuple[list[int], list[int]] = ([], [])
    ids: tuple[list[int], list[int]] = ([], [])
    size, heads, tails, reach = 0, {}, [], LONGEST
    for token in sorted(model["vocab"], key=model["vocab"].get):
        closes = token.endswith(suffix)
        raw = bytes(byte[c] for c in (token[: -len(suffix)] if closes else token))
        if not raw or 0 in raw or raw[:8] == b"\xff" * 8:  # words of letters have no such bytes
            continue
        if len(raw) > LONGEST:
            head = int.from_bytes(raw[:LONGEST], "little")
            if head not in heads:
                heads[head] = len(tails)
                tails.append({})
            tails[heads[head]][raw, closes] = size
            reach = max(reach, len(raw))
        else:
            keys[closes].append(int.from_bytes(raw, "little"))
            ids[closes].append(size)
        size += 1
    inner, closing = (U64Map(np.array(k, np.uint64), np.array(i, np.int32), size) for k, i in zip(keys, ids))
    return Vocabulary(inner, closing, size, U64Map(np.array(list(heads), np.uint64), np.arange(len(tails), dtype=np.int32)), tails, reach)


@functools.cache
def _whole(vocab: str) -> Vocabulary:
    return vocabulary(vocab)


def _longer(v: Vocabulary, word: bytes, at: int, head: int) -> Iterator[tuple[int, int]]:
    """(length, piece) of the pieces of over LONGEST bytes that the word has at a place with this head."""
    for (raw, closes), piece in v.tails[head].items():
        if word.startswith(raw, at) and closes == (at + len(raw) == len(word)):
            yield len(raw), piece


def _steps(v: Vocabulary, words: list[bytes], width: int) -> Iterator[tuple[int, int, slice | np.ndarray, np.ndarray]]:
    """(place, length, words, piece of each of these words there), by place; the piece v.size is none."""
    n = len(words)
    chars = np.zeros((n, width + LONGEST), np.uint8)
    chars[:, :width] = np.array(words, f"S{width}").view(np.uint8).reshape(n, width)
    lengths = np.array([len(w) for w in words])
    for i in range(width):
        word = np.ascontiguousarray(chars[:, i : i + LONGEST]).view("<u8").ravel()
        for size in range(1, min(LONGEST, width - i) + 1):
            if not (inside := i + size <= lengths).any():
                break
            key = word & np.uint64((1 << 8 * size) - 1)
            piece = np.where(i + size < lengths, v.inner.get(key), v.closing.get(key))
            piece[~inside] = v.size
            yield i, size, slice(None), piece
        if v.tails and width - i > LONGEST:
            head = v.heads.get(word)
            found: dict[int, tuple[list[int], list[int]]] = {}
            for k in np.flatnonzero(head >= 0).tolist():
                for size, one in _longer(v, words[k], i, head[k]):
                    rows, pieces = found.setdefault(size, ([], []))
                    rows.append(k)
                    pieces.append(one)
            for size, (rows, pieces) in found.items():
                yield i, size, np.array(rows), np.array(pieces)


def _forward(v: Vocabulary, p: np.ndarray, words: list[bytes], width: int) -> np.ndarray:
    """Log probabilities of words of at most `width` bytes, by language. p has a last row of zeros."""
    n, langs = len(words), p.shape[1]
    lengths = np.array([len(w) for w in words])
    alpha = np.zeros((width + 1, n, langs))
    alpha[0] = 1
    scale, out, last = np.zeros((n, langs)), np.zeros((n, langs)), -1
    for i, size, rows, piece in _steps(v, words, width):
        if i != last:
            last = i
            if done := np.flatnonzero(lengths == i).tolist():
                out[done] = np.log(np.maximum(alpha[i, done], 1e-300)) + scale[done]
            if i % LONGEST == 0 and i:
                top = np.maximum(alpha[i : i + v.reach].max(0), 1e-300)
                alpha[i : i + v.reach] /= top
                scale += np.log(top)
        alpha[i + size, rows] += alpha[i, rows] * p[piece]
    rest = np.flatnonzero(lengths > last)
    out[rest] = np.log(np.maximum(alpha[lengths[rest], rest], 1e-300)) + scale[rest]
    return out


def _edges(v: Vocabulary, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, piece) of all pieces in one word of any length, by place."""
    data = np.frombuffer(word + bytes(LONGEST), np.uint8)
    masks = np.array([(1 << 8 * s) - 1 for s in range(1, LONGEST)] + [2**64 - 1], np.uint64)
    out = []
    for low in range(0, len(word), 1 << 14):
        high = min(len(word), low + (1 << 14))
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data[low : high + LONGEST - 1], LONGEST)).view("<u8").ravel()
        ends = np.arange(low, high)[:, None] + np.arange(1, LONGEST + 1)
        pieces = np.where(ends == len(word), v.closing.get(keys[:, None] & masks), v.inner.get(keys[:, None] & masks))
        pieces[ends > len(word)] = v.size
        at, size = np.nonzero(pieces != v.size)
        out.append(np.array([at + low, size + 1, pieces[at, size]], np.int64))
        head = v.heads.get(keys)
        more = [(k + low, n, one) for k in np.flatnonzero(head >= 0).tolist() for n, one in _longer(v, word, k + low, head[k])]
        out.append(np.array(more, np.int64).reshape(-1, 3).T)
    at, size, piece = np.concatenate(out, 1)
    order = np.argsort(at, kind="stable")
    return at[order], size[order], piece[order]


def _sums(n: int, reach: int, at: np.ndarray, size: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logs of the sums over all ways from the begin to each place, by language: a window of sums, rescaled at every place."""
    bounds = np.searchsorted(at, np.arange(n + 1))
    out, scale = np.empty((n + 1, weight.shape[1])), np.zeros(weight.shape[1])
    window = np.zeros((reach + 1, weight.shape[1]))
    window[0] = 1
    for i in range(n + 1):
        out[i] = np.log(np.maximum(window[0], 1e-300)) + scale
        if i < n:
            a, b = bounds[i], bounds[i + 1]
            window[size[a:b]] += window[0] * weight[a:b]
            window[:-1] = window[1:]
            window[-1] = 0
            top = np.maximum(window.max(0), 1e-300)
            window /= top
            scale = scale + np.log(top)
    return out


def _long(v: Vocabulary, p: np.ndarray, word: bytes) -> np.ndarray:
    """Log probabilities of one word of any length."""
    at, size, piece = _edges(v, word)
    return _sums(len(word), v.reach, at, size, p[piece])[-1]


def _expected_long(v: Vocabulary, p: np.ndarray, word: bytes, weight: np.ndarray, uses: np.ndarray) -> None:
    """Adds the expected uses of each piece in one word of any length."""
    n = len(word)
    at, size, piece = _edges(v, word)
    ahead = _sums(n, v.reach, at, size, p[piece])
    order = np.argsort(n - at - size, kind="stable")
    behind = _sums(n, v.reach, (n - at - size)[order], size[order], p[piece[order]])[::-1]
    term = np.exp(np.minimum(ahead[at] + np.log(np.maximum(p[piece], 1e-300)) + behind[at + size] - ahead[-1], 0)) * weight
    for k in range(p.shape[1]):
        uses[:, k] += np.bincount(piece, term[:, k], v.size + 1)


#: Widths of words that are summed many at a time; longer ones one by one, in training from TRAIN_WIDTH, as there sums aren't rescaled.
WIDTHS, TRAIN_WIDTH = (8, 16, 32, 64), 32


def _by_width(words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
    sizes = np.array([len(w) for w in words])
    low = 0
    for width in WIDTHS:
        where = np.flatnonzero((sizes > low) & (sizes <= width))
        for k in range(0, len(where), 8192):
            yield width, where[k : k + 8192].tolist()
        low = width


def word_scores(v: Vocabulary, p: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log probabilities of all the words, by language."""
    out = np.zeros((len(words), p.shape[1]))
    for width, where in _by_width(words):
        out[where] = _forward(v, p, [words[k] for k in where], width)
    for k, w in enumerate(words):
        if len(w) > WIDTHS[-1]:
            out[k] = _long(v, p, w)
    return out


def _expected(v: Vocabulary, p: np.ndarray, words: list[bytes], weight: np.ndarray, width: int) -> np.ndarray:
    """Expected uses of each piece in weighted words of at most `width` bytes, by language."""
    n, langs = len(words), p.shape[1]
    lengths = np.array([len(w) for w in words])
    steps = list(_steps(v, words, width))
    alpha, beta = np.zeros((width + 1, n, langs)), np.zeros((width + 1, n, langs))
    alpha[0] = 1
    beta[lengths, np.arange(n)] = 1
    for i, size, rows, piece in steps:
        alpha[i + size, rows] += alpha[i, rows] * p[piece]
    for i, size, rows, piece in reversed(steps):
        beta[i, rows] += p[piece] * beta[i + size, rows]
    share = weight / np.maximum(beta[0], 1e-300)
    small = (beta[0] < 1e-250).any(1)
    share[small] = 0
    uses = np.zeros((v.size + 1, langs))
    for i, size, rows, piece in steps:
        term = alpha[i, rows] * p[piece] * beta[i + size, rows] * share[rows]
        for k in range(langs):
            uses[:, k] += np.bincount(piece, term[:, k], v.size + 1)
    for k in np.flatnonzero(small).tolist():
        _expected_long(v, p, words[k], weight[k], uses)
    uses[v.size] = 0
    return uses


def expected_uses(v: Vocabulary, p: np.ndarray, words: list[bytes], weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in weighted words of any length, by language."""
    uses = np.zeros((v.size + 1, p.shape[1]))
    for width, where in _by_width(words):
        if width <= TRAIN_WIDTH:
            uses += _expected(v, p, [words[k] for k in where], weight[where], width)
    for k, w in enumerate(words):
        if len(w) > TRAIN_WIDTH:
            _expected_long(v, p, w, weight[k], uses)
    return uses


def _start(v: Vocabulary, langs: int) -> np.ndarray:
    p = np.full((v.size + 1, langs), 1 / v.size)
    p[v.size] = 0
    return p


def _next(v: Vocabulary, uses: np.ndarray) -> np.ndarray:
    uses[: v.size] += SMOOTHING
    return uses / uses.sum(0)


def fit(v: Vocabulary, counts: dict[str, dict[bytes, int]], iterations: int = ITERATIONS) -> tuple[list[str], np.ndarray]:
    """Languages by name, and piece probabilities by language with a last row of zeros."""
    langs = sorted(counts)
    words = sorted({w for c in counts.values() for w in c if w and 0 not in w})
    weight = np.array([[counts[g].get(w, 0) for g in langs] for w in words], float).reshape(len(words), len(langs))
    p = _start(v, len(langs))
    for _ in range(iterations):
        p = _next(v, expected_uses(v, p, words, weight))
    return langs, p


def fit_table(spark: SparkSession, counted: DataFrame, langs: int, vocab: str, iterations: int = ITERATIONS) -> np.ndarray:
    """The same from a table (g, w, n) of counts, by the number of the language: tasks add up expected uses, and the driver gets one number a language and piece."""
    v = _whole(vocab)
    p = _start(v, langs)
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(p)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            v, p = _whole(vocab), shared.value
            uses: dict[int, np.ndarray] = {}
            held: dict[int, tuple[list[bytes], list[int]]] = {}

            def add() -> None:
                for g, (words, n) in held.items():
                    more = expected_uses(v, np.ascontiguousarray(p[:, [g]]), words, np.array(n, float)[:, None])[:, 0]
                    uses[g] = uses[g] + more if g in uses else more
                held.clear()

            size = 0
            for b in batches:
                for g, w, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                    words, counts = held.setdefault(g, ([], []))
                    words.append(w)
                    counts.append(n)
                size += b.num_rows
                if size >= HELD:
                    add()
                    size = 0
            add()
            for g, u in uses.items():
                piece = np.flatnonzero(u)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), g, np.int32)), pa.array(piece.astype(np.int32)), pa.array(u[piece])], ["g", "piece", "uses"])

        made = counted.mapInArrow(run, "g int, piece int, uses double").groupBy("g", "piece").agg(F.sum("uses").alias("uses")).toArrow()
        shared.unpersist()
        uses = np.zeros_like(p)
        uses[made.column("piece").to_numpy(), made.column("g").to_numpy()] = made.column("uses").to_numpy()
        p = _next(v, uses)
    return p


class Scorer(Splitter):
    """Scores texts; remembers the words it has met."""

    def __init__(self, vocab: str, langs: list[str], p: np.ndarray):
        super().__init__()
        self.v, self.langs, self.p = _whole(vocab), langs, p
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.rows = np.zeros((REMEMBERED // 8, len(self.langs)), np.float32)

    def _learn(self, words: list[str]) -> None:
        while self.known.n > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.known.n - len(words) : self.known.n] = word_scores(self.v, self.p, [w.encode("utf-8", "surrogatepass") for w in words])

    def letters(self, texts: list[str | None]) -> tuple[Words, np.ndarray]:
        """The texts' words that have a letter, and how many each text has. An ending with its apostrophe is such a word."""
        w = self.words([t or "" for t in texts])
        letter = w.kind == 1
        for k in np.flatnonzero(w.code[w.begin] == 39).tolist():
            letter[k] = w.end[k] - w.begin[k] > 1 and self.table[w.code[w.begin[k] + 1]] & 3 == 1
        w = w.some(letter)
        return w, np.diff(np.r_[0, w.last])

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Each text's language and score."""
        names, scores = [], []
        for a, b in chunks(texts):
            w, counts = self.letters(texts[a:b])
            if not self.langs or not len(w.begin):
                names += ["und"] * (b - a)
                scores += [0.0] * (b - a)
                continue
            place = self.known.find(w)
            if self.known.n and self.known.n + np.count_nonzero(place < 0) > REMEMBERED:
                self.forget()
                place[:] = -1
            place = numbered(w, self.known, self._learn, place)
            sums = np.zeros((len(place) + 1, len(self.langs)))
            np.cumsum(self.rows[place], 0, dtype=float, out=sums[1:])
            stop = np.cumsum(counts)
            total = (sums[stop] - sums[stop - counts]) * np.minimum(1, PASSAGE / np.maximum(counts, 1))[:, None]
            post = np.exp(total - total.max(1, keepdims=True))
            best = total.argmax(1)
            top = post[np.arange(len(best)), best] / post.sum(1)
            names += [self.langs[k] if n else "und" for k, n in zip(best.tolist(), counts.tolist())]
            scores += np.where(counts > 0, top, 0.0).tolist()
        return names, scores


_scorers: dict[int, Scorer] = {}


def train(df: DataFrame, text: str, lang: str, key: str, vocab: str = VOCAB, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Piece probabilities from all words of about `rows` labelled rows of each language, chosen by a hash of their key."""
    spark = df.sparkSession
    scratch = Scratch(spark, "langid")
    df = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r.g: r.n for r in df.groupBy(F.col(lang).alias("g")).agg(F.count("*").alias("n")).collect()}  # a row a language
    if not sizes:
        return [], np.zeros((1, 0))
    langs = sorted(sizes)
    number = {g: k for k, g in enumerate(langs)}
    share: Column = F.lit(0.0)
    for g, n in sizes.items():
        share = F.when(F.col(lang) == g, min(1.0, rows / n)).otherwise(share)
    chosen = df.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = {}
        scorer = Scorer(vocab, [], np.zeros((1, 0)))
        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w, _ = scorer.letters([t])
                seen.setdefault(g, Counter()).update(w.text(np.arange(len(w.begin))))
        for g, c in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([number[g]] * len(c), pa.int32()), pa.array([w.encode("utf-8", "surrogatepass") for w in c], pa.binary()), pa.array(c.values(), pa.int64())], ["g", "w", "n"])

    counted = chosen.select(F.col(lang).alias("g"), F.col(text).alias("t")).mapInArrow(count, "g int, w binary, n long")
    words = scratch.put(counted.repartition(partitions(spark), "g", "w").groupBy("g", "w").agg(F.sum("n").alias("n")))
    p = fit_table(spark, words, len(langs), vocab)
    scratch.drop(words)
    return langs, p


def identify(df: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", vocab: str = VOCAB) -> DataFrame:
    """df with lang_pred and score."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    made = ("lang_pred", "score")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, p = shared.value
        mark = hash((vocab, tuple(langs), p.tobytes()))
        if mark not in _scorers:
            _scorers.clear()
            _scorers[mark] = Scorer(vocab, langs, p)
        for b in batches:
            names, scores = _scorers[mark].score(b.column(b.schema.names.index(text)).to_pylist())
            kept = [n for n in b.schema.names if n not in made]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, *made])

    schema = df.drop(*made).schema.add("lang_pred", "string").add("score", "double")
    return df.mapInArrow(run, schema)
