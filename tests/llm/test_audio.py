import hashlib
import math
import zlib

import numpy as np
import pytest

from curatrix.llm import audio, digests


def test_wav():
    for n in (0, 1, 64, 1001):
        data = bytes(i % 256 for i in range(n))
        assert audio.read_wav(audio.write_wav(data, 11025)) == (11025, data)
    with pytest.raises(ValueError):
        audio.read_wav(b"RIFF")


@pytest.mark.parametrize("rate, target", [(16000, 8000), (16000, 12000), (8000, 16000), (44100, 16000), (8000, 8000)])
def test_resample_is_interpolation_by_the_filter(rate, target):
    x = np.random.default_rng(0).standard_normal(501).astype(np.float32)
    got = audio.resample(x, rate, target)
    if rate == target:
        assert got is x
        return
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    wide = max(up, down)
    n = np.arange(-8 * wide, 8 * wide)
    h = np.sinc(n / wide) * np.hanning(len(n) + 2)[1:-1] * up / wide
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    spread = np.zeros(len(x) * up)
    spread[::up] = x
    full = np.convolve(spread, h)
    width = len(h) // up
    # phase p of output n lies (n * down) // up input places on, shifted by half the filter
    at = np.arange(len(got)) * down
    offset = (width - 1 - width // 2) * up
    want = np.array([full[a - a % up + a % up + offset] if 0 <= a + offset < len(full) else 0 for a in at])
    assert len(got) == -(-len(x) * up // down) and np.allclose(got, want, atol=1e-4)


def test_a_tone_keeps_its_pitch():
    t = np.arange(16000) / 16000
    samples = np.round(128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    f = audio.features(samples)
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    centre = np.linspace(mel(20), mel(4000), audio.MELS + 2)[1:-1]
    assert abs(int(f.tensors[0, 10].argmax()) - int(np.abs(centre - mel(1000)).argmin())) <= 1


def test_hysteresis():
    level = np.array([0, 2, 0, 0, -2, 0, 0, 2, 2, -2, 2])
    assert audio.hysteresis(level, 1.5, -1.5) == [(1, 4), (7, 9), (10, 11)]
    assert audio.hysteresis(np.zeros(0), 1, -1) == [] and audio.hysteresis(np.zeros(5), 1, -1) == []


def test_silence_between_tones_is_no_segment():
    t = np.arange(8000) / 16000
    loud = np.round(128 + 100 * np.sin(2 * np.pi * 800 * t)).astype(np.uint8).tobytes()
    f = audio.features(loud + bytes([128]) * 8000 + loud)
    assert len(f.segments) == 2 and abs(f.segments[0][1] - 0.5) < 0.05 and abs(f.segments[1][0] - 1.0) < 0.05


def test_tensors_are_arrow(spark):
    f = audio.features(bytes(range(256)) * 100)
    tensors, spans = audio.from_arrow(audio.to_arrow(f))
    assert (tensors == f.tensors).all() and spans == f.spans and tensors.shape[1:] == (audio.CHUNK, audio.MELS)
    assert all(b[0] < a[1] for a, b in zip(spans, spans[1:]))  # frames overlap


def test_blocks_do_not_matter(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 30000, dtype=np.uint8).tobytes()
    whole = audio.features(data)
    monkeypatch.setattr(audio, "BLOCK", 37)
    again = audio.features(data).tensors
    assert np.abs(again - whole.tensors).max() <= 1 / audio.STEPS and (again == whole.tensors).mean() > 0.999


def test_log_mel_equals_plain_transform():
    """Frame by frame, with the transform and the triangles written out."""
    data = np.random.default_rng(2).integers(0, 256, 4000, dtype=np.uint8).tobytes()
    y = audio.resample((np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128, audio.RATE, audio.TARGET)
    got = audio.features(data).tensors.reshape(-1, audio.MELS)
    to_mel, to_hz = (lambda f: 2595 * math.log10(1 + f / 700)), (lambda m: 700 * (10 ** (m / 2595) - 1))
    edges = [to_hz(to_mel(20) + k * (to_mel(audio.TARGET / 2) - to_mel(20)) / (audio.MELS + 1)) for k in range(audio.MELS + 2)]
    for n in (0, 3, 20):
        frame = [float(y[n * audio.HOP + i]) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (audio.FRAME - 1))) for i in range(audio.FRAME)]
        power = [abs(sum(v * np.exp(-2j * math.pi * b * i / audio.FFT) for i, v in enumerate(frame))) ** 2 for b in range(audio.FFT // 2 + 1)]
        for m in range(audio.MELS):
            lo, mid, hi = edges[m : m + 3]
            total = sum(p * max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for b, p in enumerate(power) for f in [b * audio.TARGET / audio.FFT])
            assert abs(got[n, m] - math.log(total + 1e-6)) < 1.5 / audio.STEPS


def test_hysteresis_equals_plain_scan():
    rng = np.random.default_rng(3)
    for _ in range(50):
        level, on, begin, want = rng.normal(0, 2, 60).round(1), False, 0, []
        for k, x in enumerate(level):
            if not on and x > 1.5:
                on, begin = True, k
            elif on and x < -1.5:
                on = False
                want.append((begin, k))
        assert audio.hysteresis(level, 1.5, -1.5) == want + ([(begin, len(level))] if on else [])


def test_dataframe(spark):
    texts = [None, "", "é" * 40, "long " * 30000, "x", "x"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = digests.media_digests(audio.audio_columns(df), "doc_id", "text").orderBy("doc_id").collect()
    for r, t in zip(rows, texts):
        raw = (t or "").encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(pay) + 44, hashlib.sha256(audio.write_wav(pay)).hexdigest())
    assert rows[4].feature == rows[5].feature and rows[0].feature == rows[1].feature and len({r.feature for r in rows}) == 4
    assert audio.audio_columns(df.limit(0)).count() == 0
