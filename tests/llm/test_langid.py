import functools
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.llm import langid

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
V = langid.vocabulary(langid.VOCAB)


def model(langs=2, seed=0):
    p = np.random.default_rng(seed).random((V.size + 1, langs))
    p[V.size] = 0
    return p / p.sum(0)


def file_pieces():
    """The pieces of the vocabulary file itself, by bytes and whether they end a word."""
    with open(langid.vocab_path(langid.VOCAB), encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, byte = model["end_of_word_suffix"], {c: b for b, c in enumerate(langid.byte_chars())}
    tokens = [t for t in sorted(model["vocab"], key=model["vocab"].get)]
    pieces = [(bytes(byte[c] for c in t.removesuffix(suffix)), t.endswith(suffix)) for t in tokens]
    return {piece: k for k, piece in enumerate(x for x in pieces if x[0] and 0 not in x[0])}


PIECES = file_pieces()


def all_segmentations(word, p):
    """The sum over all segmentations into pieces of the vocabulary file, by recursion over the first piece."""

    @functools.cache
    def total(a):
        if a == len(word):
            return (1.0,) * p.shape[1]
        found = ((b, PIECES.get((word[a:b], b == len(word)))) for b in range(a + 1, len(word) + 1))
        return tuple(sum((p[k] * np.array(total(b)) for b, k in found if k is not None), np.zeros(p.shape[1])))

    return np.log(np.array(total(0)))


def test_forward_sums_all_segmentations():
    p = model()
    words = [w.encode() for w in ("a", "the", "heit", "Straße", "ciónmente", "abcdefgh", "abcdefghi", "x" * 17, "öäü" * 8, "internationalisation" * 2, "z" * 63)]
    got = langid.word_scores(V, p, words)
    for w, row in zip(words, got):
        assert np.allclose(row, all_segmentations(w, p))


def test_long_words_scale():
    p = model()
    w = "schifffahrt".encode() * 9
    assert np.allclose(langid.word_scores(V, p, [w])[0], all_segmentations(w, p))
    assert np.isfinite(langid.word_scores(V, p, [b"ab" * 20000])).all()


def test_pieces_of_all_lengths():
    v, pieces = langid.vocabulary(langid.VOCAB), file_pieces()
    assert v.size == len(pieces) and v.reach == max(len(raw) for raw, _ in pieces)
    p = np.random.default_rng(3).random((v.size + 1, 2))
    p[v.size] = 0
    p /= p.sum(0)
    words = [w.encode() for w in ("university", "president", "community", "communityx", "internationalisation" * 2, "universitypresident" * 5, "internationalpresidents")]
    words += [max((raw for raw, closes in pieces if closes == c), key=len) for c in (False, True)]
    for w, row in zip(words, langid.word_scores(v, p, words)):
        total = [np.ones(2)] + [np.zeros(2) for _ in w]
        for a in range(len(w)):
            for b in range(a + 1, len(w) + 1):
                if (k := pieces.get((w[a:b], b == len(w)))) is not None:
                    total[b] = total[b] + total[a] * p[k]
        assert np.allclose(row, np.log(total[-1]))
    few = [w for w in words if len(w) <= langid.TRAIN_WIDTH]
    one = np.zeros((v.size + 1, 2))
    for w in few:
        langid._expected_long(v, p, w, np.array([2.0, 1.0]), one)
    assert np.allclose(langid.expected_uses(v, p, few, np.array([[2.0, 1.0]] * len(few))), one)


def test_all_words_of_the_rows_count(spark):
    """Words of any length and of small languages, as many as there are."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    large = ["".join(letters[(i // 26**k) % 26] for k in range(4)) for i in range(60_000)]
    rows = [(i, " ".join(large[i::20] * 2), "aa") for i in range(20)] + [(30, "zyxw " + "漢字仮名" * 10, "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, p = langid.train(df, "text", "lang", "doc_id")
    counts = {"aa": {w.encode(): 2 for w in large}, "zz": {b"zyxw": 1, ("漢字仮名" * 10).encode(): 1}}
    assert langs == ["aa", "zz"]
    assert np.allclose(p, langid.fit(langid.vocabulary(langid.VOCAB), counts)[1], rtol=1e-6, atol=1e-12)
    assert p[:, 1].max() > 100 / langid.vocabulary(langid.VOCAB).size


def test_training_raises_likelihood():
    counts = {"xx": {b"thing": 5, b"there": 3, b"a": 9}, "yy": {b"eau": 4, b"beau": 6}}
    weights = lambda p, langs: sum(n * langid.word_scores(V, p, [w])[0][langs.index(g)] for g, c in counts.items() for w, n in c.items())
    told = [weights(p, langs) for langs, p in (langid.fit(V, counts, k) for k in (1, 2, 4))]
    assert told == sorted(told)
    langs, p = langid.fit(V, counts)
    assert langs == ["xx", "yy"] and np.allclose(p.sum(0), 1) and (p[V.size] == 0).all()


def test_edge_texts(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the thing there is", "en"), ("eau beau le la", "fr")] * 20)], "doc_id long, text string, lang string")
    m = langid.train(train, "text", "lang", "doc_id")
    rows = [(1, None, "a"), (2, "", "b"), (3, "12 !? 3", "c"), (4, "THE THING", "d"), (4, "THE THING", "e"), (None, "le beau", "f"), (6, "eau " * 50000, "g"), (7, "漢字", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(df, m).collect()]
    assert [g[1] for g in got][:7] == ["und", "und", "und", "en", "en", "fr", "fr"]
    assert all(0 <= g[2] <= 1 for g in got) and got[0][2] == 0
    assert langid.identify(df.limit(0), m).count() == 0


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    m = langid.train(df, "text", "lang", "doc_id")
    assert [(r.lang_pred, r.score) for r in langid.identify(df, m).collect()] == [("und", 0.0)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    from curatrix.llm.queries import op4_language_id

    told = op4_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out")
    r = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 20 and r.right > 0.97


def test_letters_after_an_apostrophe():
    """Endings that are split off with their apostrophe have letters."""
    scorer = langid.Scorer(langid.VOCAB, ["a", "b"], model())
    assert [n != "und" for n in scorer.score(["'s", "'re", "'", "' '", "12'", "it's"])[0]] == [True, True, False, False, False, True]


def test_words_of_equal_hash_are_scored_apart():
    w = "a"
    while len(w) < 1024:
        w += w.translate(str.maketrans("ab", "ba"))
    other = w.translate(str.maketrans("ab", "ba"))
    scorer = langid.Scorer(langid.VOCAB, ["a", "b"], model())
    scorer.score([w, other])
    assert scorer.known.n == 2 and not np.allclose(scorer.rows[0], scorer.rows[1])
