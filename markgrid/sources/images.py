"""Image scan: files to rows of gray pixels, unreadable files to error rows.

PNG (8 bits a sample, not interlaced) is decoded with zlib and NumPy; other formats, JPEG among
them, give an error row unless a decoder is passed in.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(raw: bytes) -> np.ndarray:
    """Gray pixels (height x width) of a PNG."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("unsupported PNG")
    n = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width * n), np.uint8)
    for y in range(height):
        how, line, up = lines[y, 0], lines[y, 1:], out[y]
        if how == 0:
            out[y + 1] = line
        elif how == 2:
            out[y + 1] = line + up
        elif how == 1:
            out[y + 1] = np.cumsum(line.reshape(width, n), axis=0, dtype=np.uint8).ravel()
        else:  # depends on the pixel before: all channels of a pixel at once
            a = c = np.zeros(n, np.int32)
            row = []
            for bits, b in zip(line.reshape(width, n).astype(np.int32), up.reshape(width, n).astype(np.int32)):
                if how == 3:
                    guess = (a + b) // 2
                else:
                    to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
                a, c = (bits + guess) & 255, b
                row.append(a)
            out[y + 1] = np.concatenate(row)
    pixels = out[1:].reshape(height, width, n)
    if n >= 3:
        return np.rint(pixels[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)
    return pixels[..., 0]


def encode_png(gray: np.ndarray) -> bytes:
    """A PNG of gray pixels, for sinks and tests."""
    height, width = gray.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((height, 1), np.uint8), gray.astype(np.uint8)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines.tobytes())) + part(b"IEND", b"")


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the image files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(folder)


def decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray] = decode_png) -> DataFrame:
    """path, h, w, gray, error: error names what kept a file from being read."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    gray = decode(bytes(content))
                    rows.append((path, *gray.shape, gray.tobytes(), None))
                except (ValueError, struct.error, zlib.error, TypeError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "gray", "error"]).astype({"h": "Int32", "w": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, h int, w int, gray binary, error string")
