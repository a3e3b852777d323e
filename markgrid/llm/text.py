"""Word arrays of UTF-8 texts: NumPy helpers used inside tasks.

Words are runs of bytes other than 0x20 and 0x09-0x0D, lower-cased in A-Z only unless told not to; a
word is represented by a 64-bit hash. Work is done over slices, so memory is bounded by the slice and
eight bytes a word, however long a text is.
"""

from __future__ import annotations

import ctypes
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LONG_WORD = 256
SLICE = 1 << 20
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.cumprod(np.full(LONG_WORD, 0x9E3779B97F4A7C15, dtype=np.uint64))
_gap = re.compile(rb"[ \t-\r]")
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(raw: bytes, size: int = SLICE) -> Iterator[bytes]:
    """raw cut at white space into pieces of about size bytes."""
    at = 0
    while len(raw) - at > size:
        m = _gap.search(raw, at + size)
        end = m.start() if m else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    edge = np.empty(len(buf) + 1, bool)
    ink = ~SPACE[buf]
    edge[1:-1] = ink[1:] != ink[:-1]
    edge[0] = ink[0] if len(buf) else False
    edge[-1] = ink[-1] if len(buf) else False
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash for each word, of A-Z as a-z with fold; words of over LONG_WORD bytes are hashed one by one."""
    case = LOWER if fold else np.arange(256, dtype=np.uint8)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    ink = ~SPACE[buf]
    if int(size.max()) <= LONG_WORD:
        low = case[buf[ink]]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(len(low)) - np.repeat(first, size)
        return mix(np.add.reduceat(_BYTE[low] * _POWER[place], first) + size.astype(np.uint64))
    out = np.zeros(len(starts), np.uint64)
    long = size > LONG_WORD
    for i in np.flatnonzero(long):
        out[i] = int.from_bytes(hashlib.blake2b(case[buf[starts[i] : ends[i]]].tobytes(), digest_size=8).digest(), "little")
    if not long.all():
        keep = np.repeat(~long, size)
        low = case[buf[ink][keep]]
        size = size[~long]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(len(low)) - np.repeat(first, size)
        out[~long] = mix(np.add.reduceat(_BYTE[low] * _POWER[place], first) + size.astype(np.uint64))
    return out


def word_hashes(raw: bytes, fold: bool = True) -> np.ndarray:
    parts = []
    for piece in slices(raw):
        buf = np.frombuffer(piece, np.uint8)
        parts.append(hash_spans(buf, *spans(buf), fold))
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k words; fewer words make one shingle, no word none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        h = np.full(1, n, np.uint64)
        for i in range(n):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + 1])
        return h
    h = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return h


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = 3 << 18) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts have about size bytes together (a longer text comes alone), with
    their texts as bytes; a null text is empty."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        at, held = 0, 0
        for i, t in enumerate(texts):
            if t is None:
                texts[i] = t = b""
            if held and held + len(t) > size:
                yield batch.slice(at, i - at), texts[at:i]
                at, held = i, 0
            held += len(t)
        if at < len(texts):
            yield batch.slice(at), texts[at:]
        del texts
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that waits for its next task holds little of it."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def chunk_words(texts: list[bytes], fold: bool = True) -> list[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    total = sum(map(len, texts)) + len(texts)
    if total > 4 * SLICE:
        return [word_hashes(t, fold) for t in texts]
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, ends = spans(buf)
    h = hash_spans(buf, starts, ends, fold)
    cut = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])[:-1])
    return np.split(h, cut)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
