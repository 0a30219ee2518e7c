"""BPE encoding and decoding through a minimal acyclic transducer lexicon.

The most frequent words of all rows, with the ids they encode to, are compiled into a minimal automaton whose arcs carry
numbers; the numbers along a word's path add up to its place in the table of ids. Workers map the
automaton's bytes into memory and walk it for many words at once. Words outside it are merged exactly,
also many at once. Both ways give the ids that the merge list gives, so which words are frequent decides speed only.
A worker remembers the words it has met, by a hash; the characters of each word are compared with those remembered, so words of equal hash are told apart.

Texts: null and empty texts have no tokens. Very long texts are handled piece by piece of a whole text,
never cut; the ids of a text do not depend on other rows, so ties and repeated rows are all kept.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import sys
import tempfile
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship
from .u64map import U64Map

VOCAB = "word_bpe_49k.json"
#: Words in the lexicon at most, and characters of the longest.
LEXICON_WORDS, LEXICON_CHARS = 12000, 32
#: Characters of text handled at once, and words a worker remembers before it starts afresh, in encoding and in counting.
CHUNK_CHARS, REMEMBERED, COUNTED = 1 << 19, 400_000, 100_000
INF = np.int32(2**31 - 1)
# Unicode's White_Space characters.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Endings that stay with an apostrophe before them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def vocab_path(vocab: str) -> str:
    if os.path.exists(vocab):
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


_tables: list = []


def classes() -> tuple[np.ndarray, dict[int, str]]:
    """For every code point: 0 white space, 1 letter, 2 number, 3 other; 4 more if Python's tables are older than the
    tokenizers library's there, 8 more if it may take part in composition; and the lower case that the library has where Python's are older."""
    if not _tables:
        import regex
        from tokenizers import Regex, normalizers, pre_tokenizers

        kinds = [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]
        newer = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c, k in enumerate(kinds) if k == "Cn"))
        for kind in "LN":
            has = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "isolated").pre_tokenize_str("".join(f" {c} " for c in newer))
            for w, _ in has:
                if len(w) == 1 and w != " ":
                    kinds[ord(w)] = kind
        lower = {ord(c): x for c in newer if (x := normalizers.Lowercase().normalize_str(c)) != c}
        table = np.array([{"L": 1, "N": 2}.get(k[0], 3) for k in kinds], np.uint8)
        for c in map(ord, SPACE):
            table[c] = 0
        for c in lower:
            table[c] |= 4
        jamo = {*range(0x1100, 0x1200), *range(0xA960, 0xA980), *range(0xD7B0, 0xD800)}
        for c, k in enumerate(kinds):
            if c >= 0x300 and (k[0] == "M" or c in jamo or unicodedata.normalize("NFC", chr(c)) != chr(c)):
                table[c] |= 8
        for c in newer:
            table[ord(c)] |= 8
        _tables.extend((table, lower))
    return tuple(_tables)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b if b in plain else next(shifted)) for b in range(256)]


# ---------------------------------------------------------------- the automaton


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The words' minimal acyclic automaton with additive outputs, and their ids, as one block of bytes."""
    finals, arcs, register = [False], [{}], {}
    unchecked: list[tuple[int, int, int]] = []

    def minimise(down_to: int) -> None:
        while len(unchecked) > down_to:
            parent, byte, child = unchecked.pop()
            known = register.setdefault((finals[child], tuple(arcs[child].items())), child)
            arcs[parent][byte] = known

    last, order = b"", sorted(w for w in words if w)
    for w in order:
        same = len(os.path.commonprefix([w, last]))
        minimise(same)
        at = unchecked[-1][2] if unchecked else 0
        for byte in w[same:]:
            finals.append(False)
            arcs.append({})
            arcs[at][byte] = len(arcs) - 1
            unchecked.append((at, byte, len(arcs) - 1))
            at = len(arcs) - 1
        finals[at], last = True, w
    minimise(0)
    states, todo = {0: 1}, [0]
    for s in todo:
        for t in arcs[s].values():
            if t not in states:
                states[t] = len(states) + 1
                todo.append(t)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        if more := [t for t in arcs[s].values() if t not in below]:
            stack += more
        else:
            below[s] = finals[s] + sum(below[t] for t in arcs[s].values())
            stack.pop()
    used = sorted({b for s in states for b in arcs[s]})
    classes = np.zeros(256, np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    step = np.zeros((len(states) + 1, len(used) + 1), np.int32)  # state 0 is dead, 1 the start
    add, final = np.zeros_like(step), np.zeros(len(states) + 1, np.int32)
    for s, k in states.items():
        final[k], passed = finals[s], int(finals[s])
        for byte, t in sorted(arcs[s].items()):
            step[k, classes[byte]], add[k, classes[byte]] = states[t], passed
            passed += below[t]
    ids = [words[w] for w in order]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.array([i for x in ids for i in x], np.int32)
    head = np.array([*step.shape, len(order), len(flat)], np.int32)
    return b"".join(x.tobytes() for x in (head, classes, step, add, final, ends, flat))


class Lexicon:
    """A compiled lexicon, mapped from a file that has no name any more."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        data = np.frombuffer(self.map, np.int32)
        states, width, n, n_ids = data[:4]
        parts = np.split(data[4:], np.cumsum([256, states * width, states * width, states, n + 1]))
        self.classes, self.final, self.ends, self.ids = parts[0], parts[3], parts[4], parts[5]
        self.step, self.add = parts[1].reshape(states, width), parts[2].reshape(states, width)
        self.n = int(n)

    def find(self, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each word's place, or -1; chars holds a word's bytes in each row."""
        state, place = np.ones(len(chars), np.int32), np.zeros(len(chars), np.int32)
        for j in range(chars.shape[1]):
            c = self.classes[chars[:, j]]
            inside = lengths > j
            place += np.where(inside, self.add[state, c], 0)
            state = np.where(inside, self.step[state, c], state)
        return np.where((self.final[state] == 1) & (lengths > 0), place, -1)


# ---------------------------------------------------------------- encoding


@dataclass
class Words:
    """The words of some texts, which stand in lower case in one string."""

    whole: str
    code: np.ndarray  # its code points
    begin: np.ndarray  # where words begin and end in it
    end: np.ndarray
    last: np.ndarray  # how many words come before each text's end
    hashed: np.ndarray  # 64 bits of each word
    kind: np.ndarray  # of each word's first character
    letters: np.ndarray  # the code points of all words, one after the other
    table: np.ndarray

    def some(self, keep: np.ndarray) -> Words:
        """Only these words, by a mask; texts keep their order."""
        cut = np.r_[0, np.cumsum(keep)]
        at = np.repeat(keep, self.end - self.begin)
        return Words(self.whole, self.code, self.begin[keep], self.end[keep], cut[self.last], self.hashed[keep], self.kind[keep], self.letters[at], self.table)

    def text(self, some: np.ndarray) -> list[str]:
        return [self.whole[i:j] for i, j in zip(self.begin[some].tolist(), self.end[some].tolist())]


class Splitter:
    """Splits texts into the words that are encoded one by one."""

    def __init__(self):
        self.table, self.lower = classes()

    def composed(self, texts: list[str]) -> list[str]:
        """Texts in normal form C, as the library has it. It is asked where a character may compose; other texts are in that form."""
        wide = [k for k, t in enumerate(texts) if not t.isascii()]
        if not wide:
            return texts
        out = list(texts)
        code = np.frombuffer("".join([texts[k] for k in wide]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(self.table[code] & 8)
        if len(at):
            from tokenizers import normalizers

            ends = np.cumsum([len(texts[k]) for k in wide])
            for k in np.unique(np.searchsorted(ends, at, "right")).tolist():
                out[wide[k]] = normalizers.NFC().normalize_str(texts[wide[k]])
        for k in wide:
            out[k] = out[k].replace("Σ", "σ")  # lower-casing goes without sigma's context
        return out

    def words(self, texts: list[str]) -> Words:
        texts = [t.lower() for t in self.composed(texts)]
        whole = "\n".join([*texts, ""])
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.table[code]
        if self.lower and (kind & 4).any():
            return self.words([t.translate(self.lower) for t in texts])
        kind &= 3
        begins = np.empty(len(code), bool)
        begins[0] = True
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        for q in np.flatnonzero((code == 39) & begins).tolist():
            if end := next((len(e) for e in ENDINGS if whole.startswith(e, q + 1)), 0):
                begins[q + 1], begins[q + 1 + end] = False, True
        at = np.flatnonzero(begins)
        ends = np.r_[at[1:], len(code)]
        inside = kind[at] != 0
        at, ends, first = at[inside], ends[inside], kind[at[inside]]
        last = np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts]))
        power, inverse = _powers(len(code))
        sums = np.empty(len(code) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((code + np.uint64(0x51ED27)) * power[: len(code)], out=sums[1:])
        hashed = (sums[ends] - sums[at]) * inverse[at] + (ends - at).astype(np.uint64)
        hashed ^= hashed >> np.uint64(29)
        return Words(whole, code, at, ends, last, hashed * np.uint64(0xBF58476D1CE4E5B9), first, code[kind != 0], self.table)


class Known:
    """Words that were met, numbered. A hash finds a word's number and its characters prove it; words whose hash another word has are found by their text."""

    def __init__(self):
        self.by_hash = U64Map(np.zeros(0, np.uint64), np.zeros(0, np.int32), room=1 << 12)
        self.twins: dict[str, int] = {}
        self.n, self.used = 0, 0
        self.begin, self.size, self.chars = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int32), np.zeros(1 << 12, np.uint32)

    def find(self, w: Words) -> np.ndarray:
        """The words' numbers, -1 for new ones."""
        place = self.by_hash.get(w.hashed)
        if not self.n or not len(place):
            return place
        size = w.end - w.begin
        at = np.cumsum(size, dtype=np.int64) - size
        row = np.maximum(place, 0)
        own = np.repeat(self.begin[row] - at, size)
        own += np.arange(len(own))
        np.minimum(own, self.used - 1, out=own)
        wrong = self.size[row] != size
        if len(differ := np.flatnonzero(self.chars[own] != w.letters)):
            wrong[np.searchsorted(at, differ, "right") - 1] = True
        for k in np.flatnonzero(wrong & (place >= 0)).tolist():
            place[k] = self.twins.get(w.whole[w.begin[k] : w.end[k]], -1)
        return place

    def add(self, w: Words, missing: np.ndarray) -> list[str]:
        """Numbers the distinct ones of some words that were not found, and returns those that got a number now. Words of equal hash may need another turn."""
        hashes, first = np.unique(w.hashed[missing], return_index=True)
        first = missing[first]
        there = self.by_hash.get(hashes) >= 0
        fresh = first[~there]
        twins = {}
        if there.any():
            for k in missing[np.isin(w.hashed[missing], hashes[there])].tolist():
                twins.setdefault(w.whole[w.begin[k] : w.end[k]], k)
        new = np.r_[fresh, np.fromiter(twins.values(), np.int64, len(twins))]
        rows = np.arange(self.n, self.n + len(new))
        size = w.end[new] - w.begin[new]
        while rows[-1] >= len(self.begin):
            self.begin, self.size = (np.r_[x, np.zeros_like(x)] for x in (self.begin, self.size))
        while self.used + size.sum() > len(self.chars):
            self.chars = np.r_[self.chars, np.zeros_like(self.chars)]
        ends = np.cumsum(size)
        self.begin[rows], self.size[rows] = self.used + ends - size, size
        self.chars[self.used : self.used + int(ends[-1])] = w.code[np.repeat(w.begin[new] - ends + size, size) + np.arange(int(ends[-1]))]
        self.by_hash.add(w.hashed[fresh], rows[: len(fresh)].astype(np.int32))
        self.twins.update(zip(twins, rows[len(fresh) :].tolist()))
        self.n, self.used = self.n + len(new), self.used + int(ends[-1])
        return w.text(new)


def numbered(w: Words, known: Known, learn: Callable[[list[str]], None], place: np.ndarray | None = None) -> np.ndarray:
    """Every word's number; `learn` gets the words that are new, in the order of their numbers."""
    place = known.find(w) if place is None else place
    while len(missing := np.flatnonzero(place < 0)):
        learn(known.add(w, missing))
        if len(missing) * 2 > len(place):
            place = known.find(w)
        else:
            keep = np.zeros(len(place), bool)
            keep[missing] = True
            place[missing] = known.find(w.some(keep))
    return place


class Encoder(Splitter):
    """Word pieces of a text and the ids of each word, as the vocabulary's own merges give them."""

    def __init__(self, vocab: str, block: bytes | None = None):
        super().__init__()
        with open(vocab_path(vocab), encoding="utf-8") as f:
            told = json.load(f)
        self.suffix = told["model"]["end_of_word_suffix"] or ""
        ids: dict[str, int] = told["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        chars = byte_chars()
        self.open = np.array([ids[c] for c in chars], np.int32)
        self.closed = np.array([ids[c + self.suffix] for c in chars], np.int32)
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = t
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.uint64) for k in (0, 1))
        self.rank = U64Map(left << np.uint64(32) | right, np.arange(len(pairs)), int(INF))
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.lexicon = Lexicon(block) if block else None
        self.forget()

    def forget(self) -> None:
        """Begins the tables of known words anew."""
        self.known = Known()
        self.flat, self.used = np.zeros(1 << 12, np.int32), 0
        self.start, self.size, self.n = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int32), 0

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of runs of texts, and where each text's ids end."""
        for a, b in chunks(texts):
            part = [t or "" for t in texts[a:b]]
            if self.special_at and any("<|" in t and self.special_at.search(t) for t in part):
                rows = [self._with_special(t) for t in part]
                yield np.concatenate(rows), np.cumsum([len(r) for r in rows])
            else:
                yield self._encode(part)

    def _with_special(self, text: str) -> np.ndarray:
        parts = self.special_at.split(text)
        return np.concatenate([np.array([self.special[w]], np.int32) if k % 2 else self._encode([w])[0] for k, w in enumerate(parts)])

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        w = self.words(texts)
        if not len(w.begin):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        place = self.known.find(w)
        if self.n and self.n + np.count_nonzero(place < 0) > REMEMBERED:
            self.forget()
            place[:] = -1
        place = numbered(w, self.known, self._learn, place)
        sizes = self.size[place]
        stop = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[place] - stop + sizes, sizes) + np.arange(stop[-1])]
        return ids, np.r_[0, stop][w.last]

    def _learn(self, words: list[str]) -> None:
        """Puts new words' ids into the tables."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.array([len(b) for b in raw])
        if self.n + len(words) >= len(self.start):
            more = max(len(words) + 1, len(self.start))
            self.start, self.size = np.r_[self.start, np.zeros(more, np.int64)], np.r_[self.size, np.zeros(more, np.int32)]
        low, order, parts, sizes = 0, [], [], []
        for limit in (8, 16, 32, 64):
            where = np.flatnonzero((length > low) & (length <= limit))
            low = limit
            for k in range(0, len(where), 16384):
                some = where[k : k + 16384]
                flat, size = self._ids([raw[i] for i in some.tolist()], length[some], limit)
                order.append(some)
                parts.append(flat)
                sizes.append(size)
        for i in np.flatnonzero(length > low).tolist():
            order.append([i])
            parts.append(np.frombuffer(self._merge_long(raw[i]), "<i4"))
            sizes.append([len(parts[-1])])
        flat, size, order = np.concatenate(parts), np.concatenate(sizes), np.concatenate(order)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        self.flat[self.used : self.used + len(flat)] = flat
        rows = self.n + order
        self.start[rows], self.size[rows] = self.used + np.cumsum(size) - size, size
        self.used, self.n = self.used + len(flat), self.n + len(words)

    def _ids(self, raw: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most `width` bytes, one after the other, and how many each has: from the lexicon, or merged."""
        chars = np.array(raw, f"S{width}").view(np.uint8).reshape(len(raw), width)
        if not (self.lexicon and self.lexicon.n):
            return self._merge(chars, lengths)
        place = self.lexicon.find(chars, lengths)
        other = place < 0
        merged, size = self._merge(chars[other], lengths[other])
        sizes = np.empty(len(raw), np.int64)
        sizes[other] = size
        sizes[~other] = np.diff(self.lexicon.ends)[place[~other]]
        stop = np.cumsum(sizes)
        flat = np.empty(int(stop[-1]) if len(stop) else 0, np.int32)
        for mask, source, begin in ((other, merged, np.cumsum(size) - size), (~other, self.lexicon.ids, self.lexicon.ends[place[~other]])):
            n = sizes[mask]
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(stop[mask] - n, n) + steps] = source[np.repeat(begin, n) + steps]
        return flat, sizes

    def _merge(self, chars: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words at once: in each turn every word merges its best pair. Ids row by row, and how many."""
        n, width = chars.shape
        at = np.arange(width)
        sym = self.open[chars]
        rows = np.arange(n)
        sym[rows, lengths - 1] = self.closed[chars[rows, lengths - 1]]
        sym[at >= lengths[:, None]] = -1
        done, size = np.full((n, width), -1, np.int32), lengths.astype(np.int64)
        rank = np.full((n, width), INF, np.int32)
        rank[:, :-1] = self._ranks(sym[:, :-1], sym[:, 1:])
        while len(rows):
            best = rank.argmin(1)
            k = np.arange(len(rows))
            low = rank[k, best]
            if (over := low == INF).any():
                done[rows[over]] = sym[over]
                go = ~over
                rows, sym, rank, best, low = rows[go], sym[go], rank[go], best[go], low[go]
                k = np.arange(len(rows))
                if not len(rows):
                    break
            sym[k, best] = self.merged[low]
            later = np.minimum(at + (at > best[:, None]), width - 1)
            sym, rank = np.take_along_axis(sym, later, 1), np.take_along_axis(rank, later, 1)
            size[rows] -= 1
            sym[k, size[rows]] = -1
            rank[k, size[rows] - 1] = INF
            after = np.minimum(best + 1, width - 1)
            rank[k, best] = np.where(best + 1 < width, self._ranks(sym[k, best], np.where(best + 1 < width, sym[k, after], -1)), INF)
            has = best > 0
            rank[k[has], best[has] - 1] = self._ranks(sym[k[has], best[has] - 1], sym[k[has], best[has]])
        return done[done >= 0], size

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.rank.get(a.astype(np.uint64) << np.uint64(32) | (b.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64))
        r[b < 0] = INF
        return r

    def _merge_long(self, word: bytes) -> bytes:
        """One very long word: a heap of pairs over a linked list."""
        sym = [*self.open[np.frombuffer(word, np.uint8)].tolist()]
        sym[-1] = int(self.closed[word[-1]])
        after, before = [*range(1, len(sym)), -1], [*range(-1, len(sym) - 1)]
        first = self._ranks(np.array(sym[:-1]), np.array(sym[1:])).tolist()
        heap = [(r, k) for k, r in enumerate(first) if r != INF]
        heapq.heapify(heap)
        rank = {k: r for r, k in heap}
        one = lambda a, b: int(self._ranks(np.array([a]), np.array([b]))[0])
        seen: dict[tuple[int, int], int] = {}
        while heap:
            r, k = heapq.heappop(heap)
            if rank.get(k) != r:
                continue
            gone = after[k]
            sym[k], after[k] = int(self.merged[r]), after[gone]
            rank.pop(gone, None)
            rank.pop(k, None)
            if after[k] >= 0:
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] >= 0:
                    pair = (sym[x], sym[after[x]])
                    if pair not in seen:
                        seen[pair] = one(*pair)
                    rank[x] = seen[pair]
                    if rank[x] != INF:
                        heapq.heappush(heap, (rank[x], x))
        out, k = [], 0
        while k >= 0:
            out.append(sym[k])
            k = after[k]
        return np.array(out, "<i4").tobytes()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by spaces: the vocabulary names no decoder, so marks of word ends stay."""
        return " ".join([self.tokens[i] for i in ids])


_power: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64, n at least."""
    if not _power or len(_power[0]) < n:
        base = 0x9E3779B97F4A7C15
        _power[:] = [np.cumprod(np.r_[np.uint64(1), np.full(max(n, CHUNK_CHARS + CHUNK_CHARS // 8), x, np.uint64)]) for x in (base, pow(base, -1, 2**64))]
    return _power


_encoders: dict[tuple, Encoder] = {}


def encoder(vocab: str, block: bytes | None = None) -> Encoder:
    """This process's encoder; its tables outlive a task."""
    key = (vocab, hash(block))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocab, block)
    return _encoders[key]


def chunks(texts: list[str | None], chars: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with so many characters at most, or one row."""
    start, total = 0, 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total > chars and k > start:
            yield start, k
            start, total = k, len(t or "")
    if start < len(texts):
        yield start, len(texts)


def encoded(enc: Encoder, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Each text's ids."""
    for flat, ends in enc.encode(texts):
        begin = 0
        for end in ends.tolist():
            yield flat[begin:end]
            begin = end


# ---------------------------------------------------------------- DataFrames


def count_words(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all words of all rows: counted inside tasks, then added up. Lengths don't matter; null texts have no words."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, known, words, n = Splitter(), Known(), [], np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w.encode("utf-8", "surrogatepass") for w in words], pa.binary()), pa.array(n[: len(words)], pa.int64())], ["word", "n"])
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            for a, b in chunks(texts):
                place = numbered(w, known, words.extend) if len((w := splitter.words(texts[a:b])).begin) else np.zeros(0, np.int64)
                counted = np.bincount(place, minlength=known.n)
                counted[: len(n)] += n
                n = counted
                if known.n > COUNTED:
                    yield out()
                    known, words, n = Known(), [], np.zeros(0, np.int64)
        yield out()

    return df.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, text: str = "text", vocab: str = VOCAB, words: int = LEXICON_WORDS) -> bytes:
    """A lexicon of the `words` most frequent words of all rows, of those that occur twice or more. It is compiled in a task; the driver gets its packed bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [w for b in batches for w in b.column(0).to_pylist()]
        ids = encoded(Encoder(vocab), [w.decode() for w in top])
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(compile_lexicon({w: x.tolist() for w, x in zip(top, ids)}))], pa.binary())], ["block"])

    short = F.expr(f"try_validate_utf8(cast(word as string)) is not null and octet_length(word) <= {LEXICON_CHARS}")
    top = count_words(df, text).where((F.col("n") > 1) & short).orderBy(F.desc("n"), "word").limit(words)
    made = top.select("word").coalesce(1).mapInArrow(run, "block binary").first()
    return zlib.decompress(made.block) if made else compile_lexicon({})


def encode(df: DataFrame, text: str = "text", vocab: str = VOCAB, out: str = "ids", lexicon: bytes | None = None) -> DataFrame:
    """df with a column of token ids. A column named like `out` is replaced; null and empty texts get []."""
    return with_words(df, text, vocab, lexicon, _ids_column, {out: pa.list_(pa.int32())})


def _ids_column(enc: Encoder, texts: list[str | None]) -> list[pa.Array]:
    rows = list(encoded(enc, texts))
    ends = np.cumsum([0, *map(len, rows)])
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]), pa.int32()))]


def decode(df: DataFrame, ids: str = "ids", vocab: str = VOCAB, out: str = "decoded") -> DataFrame:
    """df with the text that its ids stand for; null ids give an empty text. A column named like `out` is replaced."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [encoder(vocab).decode(x or []) for x in b.column(ids).to_pylist()]
            kept = [n for n in b.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(texts, pa.string())], [*kept, out])

    kept = [f for f in df.schema if f.name != out]
    return df.mapInArrow(run, type(df.schema)(kept).add(out, "string"))


def with_words(df: DataFrame, text: str, vocab: str, lexicon: bytes | None, columns: Callable[[Encoder, list], list[pa.Array]], made: dict[str, pa.DataType]) -> DataFrame:
    """df with the columns that `columns` makes of an encoder and a batch of texts."""
    from pyspark.sql.pandas.types import from_arrow_type

    spark: SparkSession = df.sparkSession
    ship(spark)
    lexicon = build_lexicon(df, text, vocab) if lexicon is None else lexicon
    block = spark.sparkContext.broadcast(lexicon)
    kept = [f.name for f in df.schema if f.name not in made]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab, block.value)
        for b in batches:
            new = columns(enc, b.column(b.schema.names.index(text)).to_pylist())
            names = [n for n in b.schema.names if n not in made]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in names), *new], [*names, *made])

    schema = df.select(*[F.col(f"`{n}`") for n in kept]).schema
    for n, kind in made.items():
        schema = schema.add(n, from_arrow_type(kind))
    return df.mapInArrow(run, schema)
