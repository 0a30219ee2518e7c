"""Digest columns that the queries derive from the operators' real outputs."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import audio, bpe, chat

TOKEN_DIGESTS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def _sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode("utf-8", "surrogatepass") if isinstance(x, str) else x).hexdigest()


def _token_columns(enc: bpe.Encoder, texts: list[str | None]) -> list[pa.Array]:
    n, ids_sha, text_sha = [], [], []
    decimal = [str(i) for i in range(len(enc.tokens))]
    for found in bpe.encoded(enc, texts):
        ids = found.tolist()
        n.append(len(ids))
        ids_sha.append(_sha(" ".join([decimal[i] for i in ids])))
        text_sha.append(_sha(enc.decode(ids)))
    return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]


def token_digests(df: DataFrame, key: str, text: str, vocab: str) -> DataFrame:
    """Encodes and decodes each text and keeps the number of ids and the digests of ids and decoded text."""
    return bpe.with_words(df.select(key, text), text, vocab, None, _token_columns, TOKEN_DIGESTS).select(key, *TOKEN_DIGESTS)


def chat_digests(windows: DataFrame, conv: str) -> DataFrame:
    """Reads windows back: each conversation's turns and the text under its loss mask.

    A digest of a whole conversation needs its windows in order; a task holds one window and the running digests."""
    kind = windows.schema[conv].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (to_arrow_type(windows.schema[conv].dataType), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False
        state: list = []
        done: list[tuple] = []

        def close() -> None:
            if begun:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for c, formatted, repeated, targets in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if not begun or c != now:
                    close()
                    now, begun, state = c, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in chat.parse(formatted)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for t in targets:
                    text = chat.unescape(formatted[t["begin"] : t["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)

    ordered = windows.select(F.col(conv).alias("conv"), "window", "formatted", "n_repeated", "targets").repartition("conv").sortWithinPartitions("conv", "window")
    return ordered.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv)


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(columns: DataFrame, key: str, text: str) -> DataFrame:
    """Reads stored clips back: digests of what they hold and of their features (columns of audio.audio_columns)."""
    kind = columns.schema[key].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, media, tensors, segments in zip(*(b.column(k).to_pylist() for k in range(5))):
                _, payload = audio.read_wav(media)
                mel, spans = audio.from_arrow(tensors)
                active = sum(s["end"] - s["begin"] for s in segments)
                feature = f"{len(mel)}x{audio.CHUNK}x{audio.MELS} {spans[-1][1]:.4f}s {len(segments)} segments {active:.4f}s {_sha(mel.tobytes())[:32]}"
                rows.append((i, len((t or "").encode("utf-8", "surrogatepass")), len(payload), _sha(payload), zlib.crc32(payload[-audio.UNIT :]), len(media), _sha(media), feature))
            kinds = (to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [key, *(x.split()[0] for x in MEDIA.split(", "))])

    return columns.select(key, text, "media", "log_mel", "segments").mapInArrow(run, f"`{key}` {kind.simpleString()}, {MEDIA}")
