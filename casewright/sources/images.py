"""PNG pixels and what is asked of them; standard library and numpy, Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def png_pixels(raw: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of an 8-bit PNG without interlacing: grey, colour, palette, with or without alpha."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, data, palette = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or interlace:
                raise ValueError("only 8 bits without interlacing")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += size + 12
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    flat = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * n)
    rows = np.zeros((height, width * n), np.uint8)
    for y in range(height):
        form, line = flat[y, 0], flat[y, 1:].astype(np.int64)
        above = rows[y - 1].astype(np.int64) if y else np.zeros(width * n, np.int64)
        if form == 0:
            out = line
        elif form == 2:
            out = line + above
        elif form == 1:
            out = np.cumsum(line.reshape(width, n), axis=0).reshape(-1)
        else:
            out = line.copy()
            for x in range(width * n):
                a, b, c = (out[x - n] if x >= n else 0), above[x], (above[x - n] if x >= n else 0)
                if form == 3:
                    out[x] = (line[x] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    out[x] = (line[x] + near) & 255
        rows[y] = out & 255
    image = rows.reshape(height, width, n)
    return palette[image[..., 0]] if colour == 3 else np.repeat(image[..., :1], 3, 2) if colour in (0, 4) else image[..., :3]


def image_facts(df: DataFrame, key: str, before: str, after: str, threshold: int = 16, blank: int = 245) -> DataFrame:
    """``key``, ``width``, ``height``, ``changed`` (pixels with a channel that differs by more than ``threshold``; null if sizes
    differ) and ``blank_percent`` (pixels of ``after`` that are nearly white); unreadable images give nulls."""
    source = df.select(F.col(key).alias(key), F.col(before).alias("_a"), F.col(after).alias("_b"))

    def facts(a: bytes | None, b: bytes | None) -> tuple:
        try:
            y = png_pixels(bytes(b)).astype(int)
        except (ValueError, TypeError, KeyError, zlib.error, struct.error):
            return None, None, None, None
        try:
            x = png_pixels(bytes(a)).astype(int)
            moved = int((np.abs(x - y) > threshold).any(2).sum()) if x.shape == y.shape else None
        except (ValueError, TypeError, KeyError, zlib.error, struct.error):
            moved = None
        return y.shape[1], y.shape[0], moved, round(100 * float((y >= blank).all(2).mean()), 2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *facts(a, b)) for k, a, b in zip(batch[key], batch["_a"], batch["_b"])]
            yield pd.DataFrame(rows, columns=[key, "width", "height", "changed", "blank_percent"], dtype=object)

    return source.mapInPandas(run, f"`{key}` {source.schema[0].dataType.simpleString()}, width int, height int, changed int, blank_percent double")
