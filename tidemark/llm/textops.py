"""Vectorised text work in numpy: many texts as one byte array.

Words are the runs of bytes other than 0x20 and 0x09 to 0x0D. All of these are ASCII, so cutting UTF-8
bytes there is the same as cutting the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The same, and a space for each ASCII character that is no letter or digit.
PLAIN = np.where([i < 128 and not chr(i).isalnum() for i in range(256)], 32, LOWER).astype(np.uint8)
#: A fixed odd base and its inverse modulo 2**64, and a random word for each byte.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 16), base, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = base**s times the hash of data[s:e]."""
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = _BYTE[data]
    out[1:] *= _power(len(data))[0]
    return np.cumsum(out, out=out)


def span_hashes(prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _power(len(prefix))[1][start])


def long_span_hashes(h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 64) -> np.ndarray:
    """The hashes ``h`` of spans, XXH3 for those over ``most`` bytes, as long spans of two bytes in a pattern can share a polynomial."""
    long = np.flatnonzero(end - start > most)
    h[long] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b].tobytes()) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return h


def pack(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, a line feed after each, and where each starts (with the end as last)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1, out=at[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n" if raw else b"", np.uint8), at


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and where each text's words start among them (with the end as last)."""
    gap = _SPACE[data]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, end, np.searchsorted(start, at)


def word_hashes(texts: Iterable[str | None], table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and where each text's words start among them; bytes are read through ``table``."""
    data, at = pack(texts)
    data = table[data]
    start, end, first = words(data, at)
    return long_span_hashes(span_hashes(prefix_hashes(data), start, end), data, start, end), first


def slices(frame: pd.DataFrame, text: str = "text", most: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Cuts a frame into pieces of about ``most`` characters; a longer text is a piece of its own."""
    size = frame[text].map(lambda t: 0 if t is None else len(t)).to_numpy(np.int64) + 64
    piece = np.cumsum(size) // most
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(frame)], strict=True):
        if b > a:
            yield frame.iloc[a:b]
