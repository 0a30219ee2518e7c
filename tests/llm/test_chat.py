import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from curatrix.llm import chat, digests

from .test_bpe import library


@given(st.text(st.sampled_from("<|im_startend>\\\n a"), max_size=60), st.text(st.sampled_from("\\\nns<|im_end>"), max_size=20))
def test_template_is_reversible(text, role):
    written, lo, hi = chat.template(role, text)
    assert chat.parse(written) == [(role, text)] and chat.unescape(written[lo:hi]) == text
    assert written.count(chat.START) == written.count(chat.END) == 1


def conversations(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(("yes", "no", "<|im_end|>", "perhaps", "<\\|im_start|>", "é")) for _ in range(n))
    rows = []
    for c in range(12):
        turns = [("system", say(10))] * (c % 2) + [(("user", "assistant")[i % 2], say(rng.randrange(60))) for i in range(rng.randrange(1, 30))]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(50, t, ("user", "assistant")[t % 2], "w " * (t % 9)) for t in range(400)]  # one long conversation
    rows += [(60, 0, "user", None), (60, 1, None, "x"), (60, None, "user", "first"), (60, 1, "assistant", "tie"), (60, 1, "assistant", "tie"), (60, 2, "assistant", "word " * 500)]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (70, 0, "system", "only")]
    return rows


@pytest.mark.parametrize("budget, history", [(120, 40), (10**6, 0), (60, 0), (200, 100)])
def test_windows(spark, budget, history):
    rows = conversations(1)
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(3)
    windows = chat.format_chats(df, budget=budget, history=history).collect()
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "")
    by = {}
    for c, t, r, x in sorted(rows, key=order):
        by.setdefault(c, []).append((r or "", x or ""))
    for c, turns in by.items():
        own = sorted((w for w in windows if w.conv_id == c), key=lambda w: w.window)
        seen, loss = [], []
        for w in own:
            parts = chat.parse(w.formatted)
            repeated, new = parts[: w.n_repeated], parts[w.n_repeated :]
            assert new and w.n_tokens == sum(len(library(chat.template(*p)[0])) for p in parts)
            assert w.n_tokens <= budget or len(new) == 1
            body = repeated
            if turns[0][0] == "system" and seen:
                assert repeated[0] == turns[0]
                body = repeated[1:]
            assert body == seen[len(seen) - len(body) :]  # the turns right before
            assert sum(len(library(chat.template(*p)[0])) for p in body) <= history
            texts = [chat.unescape(w.formatted[t.begin : t.end]) for t in w.targets]
            assert texts == [x for r, x in new if r == "assistant"]
            seen += new
            loss += texts
        assert sorted(seen) == sorted(turns) and [r for r, _ in seen] == [r for r, _ in turns]
        assert sorted(loss) == sorted(x for r, x in turns if r == "assistant")
    if history and budget == 120:
        assert any(w.n_repeated > 1 for w in windows if w.conv_id == 50)


def test_digests(spark):
    rows = [r for r in conversations(2) if r[0] is not None and r[0] < 60]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in digests.chat_digests(chat.format_chats(df, budget=150, history=50), "conv_id").collect()}
    for c in {r[0] for r in rows}:
        turns = [(r, x) for _, _, r, x in sorted(x for x in rows if x[0] == c)]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert digests.chat_digests(chat.format_chats(df), "conv_id").count() == 0
