"""Audio columns: WAV storage, polyphase resampling, log-mel filterbanks and hysteresis energy segments.

A clip is stored as 8-bit mono WAV and read back. Its samples are resampled by a polyphase filter, cut into overlapping frames and mapped to
log-mel energies, which are stored as one fixed-shape tensor for every CHUNK frames (the last is padded with zeros), with each
tensor's time span. Frame energies give active segments: one begins above the upper threshold and ends below the lower.

Each clip is computed by itself in blocks of fixed length, so equal texts give equal values, and very long ones need
little memory. Log-mel values are stored as multiples of 1/STEPS, computed in long floats, so the last bits of sums on another processor hardly ever change them. Null and empty texts are a clip of 64 zero bytes. Ties, repeats and further columns don't matter; columns named like the results are replaced.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from .common import ship

UNIT = 64
RATE, TARGET = 16000, 8000
FRAME, HOP, FFT, MELS, CHUNK = 200, 80, 256, 24, 64
#: Decibels above the clip's mean energy at which a segment begins, and below which it ends.
UPPER, LOWER = 1.5, -1.5
BLOCK = 4096
#: Steps that a log-mel value of 1 is stored in.
STEPS = 4096


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit unsigned mono samples as a WAV file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + b"\0" * (len(samples) % 2)


def read_wav(data: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono WAV file; other chunks are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
        elif name == b"data":
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def phases(up: int, down: int, taps: int = 8) -> np.ndarray:
    """A windowed-sinc low-pass for a rate change of up/down, split into `up` phases of 2 * taps * max(1, down / up) coefficients."""
    wide = max(up, down)
    n = np.arange(-taps * wide, taps * wide)
    h = np.sinc(n / wide) * np.hanning(len(n) + 2)[1:-1] * up / wide
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return np.stack([h[p::up] for p in range(up)])


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Polyphase: output n is phase (n * down) mod up of the filter over the input around place (n * down) // up."""
    g = math.gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        return x
    h = phases(up, down)
    width = h.shape[1]
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(width // 2), x, np.zeros(width // 2 + 1)])
    out = np.empty(n)
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    for p in range(min(up, n)):
        at = (np.arange(p, n, up) * down) // up
        for k in range(0, len(at), BLOCK * 16):
            rows = at[k : k + BLOCK * 16]
            out[p + k * up : p + (k + len(rows)) * up : up] = view[rows[0] : rows[-1] + 1 : down] @ h[(p * down) % up][::-1] if up == 1 else view[rows] @ h[(p * down) % up][::-1]
    return out


@lru_cache
def mel_bank(rate: int, fft: int, mels: int) -> np.ndarray:
    """Triangles that are evenly spaced in mel, over the bins of a real transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    rise = (bins[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - bins[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@dataclass
class Features:
    tensors: np.ndarray  # (n, CHUNK, MELS), float32
    spans: list[tuple[float, float]]  # of the tensors, in seconds
    segments: list[tuple[float, float]]  # of activity


def hysteresis(level: np.ndarray, upper: float, lower: float) -> list[tuple[int, int]]:
    """Runs that begin above `upper` and end below `lower`."""
    told = np.where(level > upper, 1, np.where(level < lower, -1, 0))
    last = np.maximum.accumulate(np.where(told != 0, np.arange(len(told)), -1))
    on = (last >= 0) & (told[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.r_[0, on.view(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def features(samples: bytes, rate: int = RATE, target: int = TARGET) -> Features:
    x = (np.frombuffer(samples, np.uint8).astype(float) - 128) / 128
    y = resample(x, rate, target)
    frames = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros((frames - 1) * HOP + FRAME - len(y))])
    view = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME), mel_bank(target, FFT, MELS)
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames)
    for k in range(0, frames, BLOCK):
        part = view[k : k + BLOCK] * window
        energy[k : k + BLOCK] = np.einsum("ij,ij->i", part, part)
        spectrum = np.fft.rfft(part, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        mel[k : k + BLOCK] = np.rint(np.log(power @ bank + 1e-6) * STEPS) / STEPS
    level = np.rint(10 * np.log10(energy + 1e-9) * STEPS) / STEPS
    runs = hysteresis(level - level.mean(), UPPER, LOWER)
    n = -(-frames // CHUNK)
    tensors = np.zeros((n * CHUNK, MELS), np.float32)
    tensors[:frames] = mel
    end = lambda f: ((f - 1) * HOP + FRAME) / target
    spans = [(k * CHUNK * HOP / target, end(min(frames, (k + 1) * CHUNK))) for k in range(n)]
    return Features(tensors.reshape(n, CHUNK, MELS), spans, [(a * HOP / target, end(b)) for a, b in runs])


def to_arrow(f: Features) -> bytes:
    """The tensors as an Arrow stream: a column of fixed-shape tensors and their time spans."""
    kind = pa.fixed_shape_tensor(pa.float32(), (CHUNK, MELS), dim_names=("frame", "mel"))
    flat = pa.FixedSizeListArray.from_arrays(pa.array(f.tensors.ravel()), CHUNK * MELS)
    begin, end = (pa.array([s[k] for s in f.spans], pa.float64()) for k in (0, 1))
    batch = pa.RecordBatch.from_arrays([begin, end, pa.ExtensionArray.from_storage(kind, flat)], ["begin", "end", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_arrow(data: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(tensors, spans) of such a stream."""
    table = pa.ipc.open_stream(data).read_all()
    tensors = table.column("log_mel").combine_chunks()
    tensors = tensors.chunk(0) if isinstance(tensors, pa.ChunkedArray) else tensors
    return tensors.to_numpy_ndarray(), list(zip(table.column("begin").to_pylist(), table.column("end").to_pylist()))


def audio_columns(df: DataFrame, text: str = "text", rate: int = RATE, target: int = TARGET) -> DataFrame:
    """df with media (a WAV file of the text's bytes), log_mel (an Arrow stream) and segments (spans of activity in seconds)."""
    ship(df.sparkSession)
    made = ("media", "log_mel", "segments")
    span = pa.list_(pa.struct([("begin", pa.float64()), ("end", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                media = [write_wav(payload_of(t), rate) for t in b.column(b.schema.names.index(text)).to_pylist()]
                found = [features(samples, r, target) for r, samples in map(read_wav, media)]
                kept = [n for n in b.schema.names if n not in made]
                new = [pa.array(media, pa.binary()), pa.array(map(to_arrow, found), pa.binary()), pa.array([[{"begin": x, "end": y} for x, y in f.segments] for f in found], span)]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in kept), *new], [*kept, *made])

    schema = df.drop(*made).schema.add("media", "binary").add("log_mel", "binary").add("segments", ArrayType(StructType().add("begin", "double").add("end", "double")))
    return df.mapInArrow(run, schema)
