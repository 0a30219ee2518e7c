"""Image kernels over decoded pixels: perceptual hash and focus measure; sizes, orientations and wholeness of files from their bytes."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType

HASH, FACTOR = 8, 4


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of pixels in blue, green, red order (the image source's), in the usual 16-bit weights."""
    px = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.uint32)
    if channels == 1:
        return px[:, :, 0].astype(np.uint8)
    # ITU-R 601 weights times 65536.
    return ((px[:, :, 2] * 19595 + px[:, :, 1] * 38470 + px[:, :, 0] * 7471 + 0x8000) >> 16).astype(np.uint8)


def _resize_axis(px: np.ndarray, size: int, kernel, support: float) -> np.ndarray:
    """Along the first axis, by a kernel that widens when the image shrinks; rounded to whole grey levels."""
    old = px.shape[0]
    scale = old / size
    wide = max(scale, 1.0)
    out = np.empty((size, *px.shape[1:]))
    for i in range(size):
        centre = (i + 0.5) * scale
        lo, hi = max(0, int(centre - support * wide + 0.5)), min(old, int(centre + support * wide + 0.5))
        w = kernel((np.arange(lo, hi) - centre + 0.5) / wide)
        out[i] = (w / w.sum()) @ px[lo:hi]
    return np.clip(np.floor(out + 0.5), 0, 255)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def resize(px: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    kernel, support = {"lanczos": (_lanczos, 3.0), "bilinear": (_triangle, 1.0)}[kind]
    px = px.astype(float)
    if px.shape[1] != width:
        px = _resize_axis(px.T, width, kernel, support).T
    return _resize_axis(px, height, kernel, support) if px.shape[0] != height else px


def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)
    m = np.sqrt(2 / n) * np.cos(np.pi * k * (2 * x + 1) / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def perceptual_hash(grey: np.ndarray) -> str:
    """A bit for each low frequency that is above the median of those that are constant in neither direction; the first bit highest."""
    return _hash_small(resize(grey, HASH * FACTOR, HASH * FACTOR, "lanczos"))


def _hash_small(small: np.ndarray) -> str:
    m = dct_matrix(HASH * FACTOR)
    low = (m @ small @ m.T)[:HASH, :HASH]
    bits = (low > np.median(low[1:, 1:])).ravel()
    return np.packbits(bits).tobytes().hex()


def perceptual_hashes(grey: np.ndarray) -> list[str]:
    """The hash of the picture turned as each of the eight orientations says, the first as it is stored.

    A mirrored picture shrinks to the mirrored small one, so two small ones are enough: one shrunk along rows first, one along columns."""
    n = HASH * FACTOR
    upright, lying = resize(grey, n, n, "lanczos"), resize(grey.T, n, n, "lanczos")
    # Orientations 1 to 8 of the tag.
    turned = (upright, upright[:, ::-1], upright[::-1, ::-1], upright[::-1], lying, lying[:, ::-1], lying[::-1, ::-1], lying[::-1])
    return [_hash_small(x) for x in turned]


def focus(grey: np.ndarray, longer: int = 0) -> float:
    """Variance of the Laplacian, edges mirrored, after shrinking the longer side to `longer` if it is larger (0: never)."""
    h, w = grey.shape
    if longer and max(h, w) > longer:
        scale = longer / max(h, w)
        grey = resize(grey, max(1, int(h * scale)), max(1, int(w * scale)), "bilinear")
    px = grey.astype(float)
    mirrored = lambda a, axis: np.pad(a, [(1, 1) if k == axis else (0, 0) for k in (0, 1)], "reflect" if a.shape[axis] > 1 else "edge")
    up, side = mirrored(px, 0), mirrored(px, 1)
    return float((up[:-2] + up[2:] + side[:, :-2] + side[:, 2:] - 4 * px).var())


@F.pandas_udf(ArrayType(StringType()))
def phashes_udf(image: pd.DataFrame) -> pd.Series:
    """Of the image source's struct, by orientation; null where nothing could be decoded."""
    return pd.Series([perceptual_hashes(gray(d, h, w, c)) if h > 0 else None for d, h, w, c in zip(image["data"], image["height"], image["width"], image["nChannels"])], dtype=object)


def focus_udf(longer: int = 0):
    @F.pandas_udf(DoubleType())
    def run(image: pd.DataFrame) -> pd.Series:
        return pd.Series([focus(gray(d, h, w, c), longer) if h > 0 else None for d, h, w, c in zip(image["data"], image["height"], image["width"], image["nChannels"])], dtype="float64")

    return run


# ---------------------------------------------------------------- sizes


def _tiff_size(data: bytes) -> tuple[int, int, int]:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, _ = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        tags[tag] = struct.unpack_from(order + {3: "H", 4: "I"}.get(kind, "B"), data, at + 10 + 12 * k)[0]
    return tags.get(256, 0), tags.get(257, 0), tags.get(274, 1)


def _jpeg_size(data: bytes) -> tuple[int, int, int]:
    at, turn = 2, 1
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turn = _tiff_size(data[at + 10 : at + 2 + size])[2]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h, turn
        at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD9 else 2 + size
    raise ValueError("no frame header")


def _webp_size(data: bytes) -> tuple[int, int, int]:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), 1
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1
    w, h = struct.unpack_from("<HH", data, 26)
    return w & 0x3FFF, h & 0x3FFF, 1


def _stored(data: bytes) -> tuple[int, int, int]:
    """Width, height and orientation as a file says."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        w, h, turn = *struct.unpack_from(">II", data, 16), 1
    elif data[:2] == b"\xff\xd8":
        w, h, turn = _jpeg_size(data)
    elif data[:2] == b"BM":
        w, h = struct.unpack_from("<ii", data, 18)
        h, turn = abs(h), 1
    elif data[:4] in (b"II*\0", b"MM\0*"):
        w, h, turn = _tiff_size(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        w, h, turn = _webp_size(data)
    else:
        raise ValueError("unknown image format")
    if w <= 0 or h <= 0:
        raise ValueError("empty image")
    return w, h, turn if 1 <= turn <= 8 else 1


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height of a PNG, JPEG, BMP, TIFF or WebP file as it is to be shown: sides are swapped where its orientation tag says so."""
    w, h, turn = _stored(data)
    return (h, w) if turn >= 5 else (w, h)


# ---------------------------------------------------------------- wholeness

PIECE = 1 << 20
#: A byte pair inside JPEG data that ends a scan: neither a stuffed byte, a restart nor filling.
SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def _whole_png(data: bytes) -> None:
    """The compressed rows must give as many bytes as the header asks for; a piece of them is in memory at a time."""
    w, h, depth, kind, _, _, interlaced = struct.unpack_from(">IIBBBBB", data, 16)
    bits = depth * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    at, out, stream = 8, 0, zlib.decompressobj()
    while at + 8 <= len(data) and data[at + 4 : at + 8] != b"IEND":
        size = struct.unpack_from(">I", data, at)[0]
        if data[at + 4 : at + 8] == b"IDAT":
            rest = data[at + 8 : at + 8 + size]
            while rest:
                out += len(stream.decompress(rest, PIECE))
                rest = stream.unconsumed_tail
        at += 12 + size
    out += len(stream.flush())
    if out < (h * (1 + -(-w * bits // 8)) if not interlaced else 1) or (interlaced and not stream.eof):
        raise ValueError("image data cut off")


def _whole_jpeg(data: bytes) -> None:
    """Segments and scans must lead to the end mark."""
    at = 2
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xD9:
            return
        if mark == 0xFF or mark == 1 or 0xD0 <= mark <= 0xD7:
            at += 1 if mark == 0xFF else 2
            continue
        if at + 4 > len(data):
            break
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
        if mark == 0xDA:
            if (end := SCAN_END.search(data, at)) is None:
                break
            at = end.start()
    raise ValueError("image data cut off")


def _whole_tiff(data: bytes) -> None:
    """All strips or tiles of the first picture must lie inside the file."""
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    at = struct.unpack_from(order + "I", data, 4)[0]
    found = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        if tag in (273, 279, 324, 325) and kind in (3, 4):
            form, here = "HI"[kind - 3], at + 10 + 12 * k
            if n * struct.calcsize(form) > 4:
                here = struct.unpack_from(order + "I", data, here)[0]
            found[tag] = struct.unpack_from(f"{order}{n}{form}", data, here)
    for place, size in ((273, 279), (324, 325)):
        if any(a + b > len(data) for a, b in zip(found.get(place, ()), found.get(size, ()))):
            raise ValueError("image data cut off")


def check_whole(data: bytes) -> None:
    """Raises where a file that has a header lacks image data, as decoders do. Single wrong pixels are not found."""
    if data[:4] == b"\x89PNG":
        _whole_png(data)
    elif data[:2] == b"\xff\xd8":
        _whole_jpeg(data)
    elif data[:2] == b"BM":
        start, w, h, bits, packed = *struct.unpack_from("<I", data, 10), *struct.unpack_from("<ii", data, 18), *struct.unpack_from("<HI", data, 28)
        if packed in (0, 3) and len(data) < start + (w * bits + 31) // 32 * 4 * abs(h):
            raise ValueError("image data cut off")
    elif data[:4] in (b"II*\0", b"MM\0*"):
        _whole_tiff(data)
    elif data[:4] == b"RIFF" and len(data) < 8 + struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("image data cut off")


@F.pandas_udf(StructType().add("width", "integer").add("height", "integer").add("turn", "integer").add("error", "string"))
def size_udf(content: pd.Series) -> pd.DataFrame:
    """Sides as shown and the orientation of each file's bytes; an error instead where the file is no whole image."""
    out = []
    for data in content:
        try:
            w, h, turn = _stored(data)
            check_whole(data)
            out.append((*((h, w) if turn >= 5 else (w, h)), turn, None))
        except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
            out.append((None, None, None, f"{type(e).__name__}: {e}"))
    frame = pd.DataFrame(out, columns=["width", "height", "turn", "error"])
    return frame.astype({"width": "Int32", "height": "Int32", "turn": "Int32"})
