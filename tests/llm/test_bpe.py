import random

import numpy as np
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from curatrix.llm import bpe
from curatrix.llm.u64map import U64Map

LIBRARY = tokenizers.Tokenizer.from_file(bpe.vocab_path(bpe.VOCAB))
OWN = bpe.Encoder(bpe.VOCAB)
HARD = [
    "", " ", "\t\n", "Hello  World's 123", "'s's ''s '' don't I'LL we've X'RE", "<|endoftext|>a<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "ΣΑΣ İI ẞß", "ﬁ①²½ Ⅷ 三", "áé 가", "a" * 70,
    "ab" * 3000, "\x00\x00a \x00", "x\x1cy\x1dz\x85w\xa0v　u", "snake_case __ 9_9", "é'S à'll", "\U0001f600\U0001f601 ‍", "ǅ ŉ", "!?'s!'s",
]


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def own(texts, enc=OWN):
    return [x.tolist() for x in bpe.encoded(enc, texts)]


def test_hard_texts():
    assert own(HARD) == [library(t) for t in HARD]
    assert [own([t])[0] for t in HARD] == [library(t) for t in HARD]


def test_every_code_point():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"x{c}y " for c in chars[i : i + 400]) for i in range(0, len(chars), 400)]
    assert own(texts) == [library(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abcé'sStT <|>_-9²\ńΣ"), max_size=40), min_size=1, max_size=5))
def test_random_texts(texts):
    assert own(texts) == [library(t) for t in texts]


def test_tables_begin_anew(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    enc = bpe.Encoder(bpe.VOCAB)
    rng = random.Random(0)
    texts = [" ".join("".join(rng.choices("abcdefg", k=rng.randrange(1, 9))) for _ in range(rng.randrange(80))) for _ in range(40)]
    for part in (texts, texts[::-1]):
        for t in part:
            assert own([t], enc)[0] == library(t)


def test_chunks_cover_all():
    texts = ["a" * n for n in (0, 5, 100, 1, 1, 50)] + [None]
    ranges = list(bpe.chunks(texts, 60))
    assert [i for a, b in ranges for i in range(a, b)] == list(range(7))


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): own([w])[0] for w in ["walk", "walks", "walked", "talk", "talks", "talked", "é", "éa", "zzz", "a"]}
    lex = bpe.Lexicon(bpe.compile_lexicon(words))
    asked = [*words, b"", b"wal", b"walkss", b"q"]
    chars = np.array(asked, "S16").view(np.uint8).reshape(len(asked), 16)
    place = lex.find(chars, np.array(list(map(len, asked))))
    for w, p in zip(asked, place):
        assert (lex.ids[lex.ends[p] : lex.ends[p + 1]].tolist() == words[w]) if w in words else p == -1
    # walk and talk share everything after their first letter
    assert len(lex.final) - 1 <= 13


def test_encoder_with_lexicon():
    texts = HARD + ["walk the walk and talk the talk"] * 2
    words = [w for w in ("walk", "the", "talk", "and")]
    enc = bpe.Encoder(bpe.VOCAB, bpe.compile_lexicon({w.encode(): own([w])[0] for w in words}))
    assert own(texts, enc) == [library(t) for t in texts]


def test_empty_lexicon():
    enc = bpe.Encoder(bpe.VOCAB, bpe.compile_lexicon({}))
    assert own(["walk"], enc) == [library("walk")]


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 2**64 - 2), st.integers(0, 2**31 - 1), max_size=60), st.lists(st.integers(0, 2**64 - 2), max_size=20))
def test_map(entries, others):
    keys = np.array(list(entries), np.uint64)
    half = len(keys) // 2
    values = np.array(list(entries.values()), np.int32)
    m = U64Map(keys[:half], values[:half])
    m.add(keys[half:], values[half:])
    asked = np.array([*entries, *others], np.uint64)
    assert m.get(asked).tolist() == [entries.get(int(k), -1) for k in asked]


def test_dataframes(spark):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "y"), (2, None, "z"), (None, "", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    made = bpe.decode(bpe.encode(df))
    assert made.columns == ["doc_id", "text", "ids", "decoded"]
    for r in made.collect():
        assert r.ids == library(r.text) and r.decoded == LIBRARY.decode(r.ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 200_000])
def test_long_words(n):
    assert own(["é" * n]) == [library("é" * n)]


def thue_morse(n):
    """A word and its complement, which collide under any polynomial modulo 2**64 from 1,024 letters on."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_words_of_equal_hash(n):
    a, b = thue_morse(n)
    w = OWN.words([a, b])
    assert n < 1024 or w.hashed[0] == w.hashed[1]
    texts = [f"{a} x {b}", b, a, f"x {b} {a} {b}"]
    assert own(texts, enc := bpe.Encoder(bpe.VOCAB)) == [library(t) for t in texts]
    assert own(texts[::-1], enc) == [library(t) for t in texts[::-1]]


def test_combining_marks():
    rng = random.Random(4)
    marks = [chr(c) for c in [*range(0x300, 0x370), *range(0x483, 0x488), *range(0x591, 0x5BE), *range(0x64B, 0x660), 0x9BE, 0x9C7, 0xCC2, 0x1161, 0x11A8, 0x1100, 0xFB1D, 0x212B, 0x1D15E]]
    texts = ["".join(rng.choice("aeoÅåΩ가ㄱ") + "".join(rng.choices(marks, k=rng.randrange(5))) for _ in range(30)) for _ in range(3000)]
    assert own(texts) == [library(t) for t in texts]


def test_lexicon_counts_all_rows(spark):
    """Words beyond any prefix of the table are counted, in all partitions."""
    rows = [("common " * 3,)] * 50 + [(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}",) for i in range(300)] + [("late late late late",)] * 40 + [(None,), ("힣́ x",)]
    df = spark.createDataFrame(rows, "text string").repartition(7)
    counted = {bytes(r.word).decode(): r.n for r in bpe.count_words(df).collect()}
    assert counted["common"] == 150 and counted["late"] == 160 and counted["waa"] == 1
    lex = bpe.Lexicon(bpe.build_lexicon(df, words=2))
    chars = np.array([b"late", b"common", b"waa"], "S16").view(np.uint8).reshape(3, 16)
    assert (lex.find(chars, np.array([4, 6, 3])) >= 0).tolist() == [True, True, False]
    assert bpe.Lexicon(bpe.build_lexicon(df.limit(0))).n == 0


def test_counting_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bpe, "COUNTED", 3)
    df = spark.createDataFrame([("a b c d e a b",), ("a x y z",)] * 5, "text string")
    assert {bytes(r.word).decode(): r.n for r in bpe.count_words(df).collect()} == {"a": 15, "b": 10, "c": 5, "d": 5, "e": 5, "x": 5, "y": 5, "z": 5}
