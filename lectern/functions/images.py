"""Pixels of images and checks on them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# How many pixels are looked at, and from where on a channel is white.
SAMPLED = 500
WHITE = 250


def is_blank(samples: Column, channels: Column) -> Column:
    """Whether about SAMPLED pixels, evenly spread over the image, are white in all channels.

    samples holds the bytes of all pixels, `channels` bytes each; an image without pixels is blank.
    """

    @F.pandas_udf("boolean")
    def blank(data: pd.Series, n: pd.Series) -> pd.Series:
        def one(raw, c):
            if raw is None or not c:
                return True
            pixels = np.frombuffer(raw, np.uint8)[: len(raw) // c * c].reshape(-1, c)
            return bool((pixels[:: max(1, len(pixels) // SAMPLED)] >= WHITE).all())

        return pd.Series([one(raw, int(c or 0)) for raw, c in zip(data, n)])

    return blank(samples, channels)


#: Of each kind of PNG: channels, by colour type.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Of the seven passes of an interlaced image: first column and row, and the steps between.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png(data: bytes) -> np.ndarray:
    """Height, width and channels of the 8-bit pixels of a PNG file; palettes are resolved, of 16 bits the upper eight count."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, chunks = 8, {}
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunks[kind] = chunks.get(kind, b"") + data[at + 8 : at + 8 + size]
        at += size + 12
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    channels = _CHANNELS[colour]
    raw = zlib.decompress(chunks[b"IDAT"])
    out = np.zeros((height, width, channels), np.uint8)
    at = 0
    for x, y, dx, dy in _PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = len(range(x, width, dx)), len(range(y, height, dy))
        if w and h:
            row = (w * channels * depth + 7) // 8
            part = unfiltered(raw[at : at + h * (row + 1)], row, max(1, channels * depth // 8))
            at += h * (row + 1)
            out[y::dy, x::dx] = _samples(part, w * channels, depth, colour != 3).reshape(h, w, channels)
    return np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)[out[:, :, 0]] if colour == 3 else out


def _samples(rows: np.ndarray, n: int, depth: int, spread: bool) -> np.ndarray:
    """Rows of n samples of some bits each, as bytes; spread: so that the largest value is 255."""
    if depth == 16:
        return rows[:, ::2]
    if depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(len(rows), -1, depth)[:, :n]
        rows = (bits << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
        return rows * np.uint8(255 // ((1 << depth) - 1)) if spread else rows
    return rows


def png_pixels(content: Column) -> Column:
    """Struct of width, height, channels, samples (see is_blank) and error of PNG files; null files have nulls."""

    @F.pandas_udf("width int, height int, channels int, samples binary, error string")
    def decoded(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                pixels = None if data is None else png(bytes(data))
                rows.append((None,) * 5 if pixels is None else (pixels.shape[1], pixels.shape[0], pixels.shape[2], pixels.tobytes(), None))
            except Exception as e:  # a broken file is a row like any other
                rows.append((None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
        return pd.DataFrame(rows, columns=["width", "height", "channels", "samples", "error"]).astype({"width": "Int32", "height": "Int32", "channels": "Int32"})

    return decoded(content)


def made_png(pixels: np.ndarray, colour: int, depth: int = 8, palette: bytes = b"") -> bytes:
    """A PNG file of rows of samples as bytes, each row with a filter of its own kind, for queries and tests."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, row = pixels.shape
    step = max(1, _CHANNELS[colour] * depth // 8)
    near = np.zeros((height + 1, row + step), np.int16)  # with nothing above and to the left
    near[1:, step:] = pixels
    now, left, up, corner = near[1:, step:], near[1:, :-step], near[:-1, step:], near[:-1, :-step]
    to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
    paeth = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
    rows = np.empty((height, row + 1), np.uint8)
    for kind, guess in enumerate((0, left, up, (left + up) >> 1, paeth)):
        rows[kind::5, 0] = kind
        rows[kind::5, 1:] = (now[kind::5] - (guess[kind::5] if kind else 0)) & 255
    body = rows.tobytes()
    head = struct.pack(">IIBBBBB", row * 8 // (_CHANNELS[colour] * depth), height, depth, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def unfiltered(data: bytes, width: int, step: int) -> np.ndarray:
    """Rows of `width` bytes, each behind a byte that names its filter, as they were before; `step` bytes are a pixel."""
    rows = np.frombuffer(data, np.uint8)
    n = len(rows) // (width + 1)
    rows = rows[: n * (width + 1)].reshape(n, width + 1)
    out = np.zeros((n, width), np.uint8)
    above = np.zeros(width, np.uint8)
    pad = -width % step
    for i, kind in enumerate(rows[:, 0].tolist()):
        row = rows[i, 1:]
        if kind == 1:  # sums along each channel
            row = np.add.accumulate(np.pad(row, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:width]
        elif kind == 2:
            row = row + above
        elif kind in (3, 4):
            row = _by_left(row.tolist(), above.tolist(), step, kind == 4)
        elif kind:
            raise ValueError(f"row filter {kind}")
        out[i] = above = row
    return out


def _by_left(row: list[int], above: list[int], step: int, paeth: bool) -> np.ndarray:
    """A row whose bytes depend on the byte to the left as it was: its mean with the one above, or the nearest of three."""
    out = [0] * step  # what stands to the left of the first pixel
    if paeth:
        for k, (now, up, corner) in enumerate(zip(row, above, [0] * step + above)):
            left = out[k]
            a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            out.append(now + (left if a <= b and a <= c else up if b <= c else corner) & 255)
    else:
        for k, (now, up) in enumerate(zip(row, above)):
            out.append(now + (out[k] + up) // 2 & 255)
    return np.array(out[step:], np.uint8)
