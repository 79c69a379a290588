"""Numpy arrays as compressed bytes, for exchanges between tasks."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def dump(**arrays: np.ndarray) -> bytes:
    return _dumped(arrays, planes=False, level=1)


def dump_planes(**arrays: np.ndarray) -> bytes:
    """The first bytes of an array's numbers, then all second bytes and so on: smaller where high bytes are often alike."""
    return _dumped(arrays, planes=True, level=3)


def _dumped(arrays: dict[str, np.ndarray], planes: bool, level: int) -> bytes:
    head, body = [], []
    for name, x in arrays.items():
        shape = "s" if not np.ndim(x) else "p" if planes and x.dtype.itemsize > 1 else "n"
        x = np.ascontiguousarray(x)
        raw = x.reshape(-1, 1).view(np.uint8).T.tobytes() if shape == "p" else x.tobytes()
        head.append(f"{name} {x.dtype.str} {shape} {len(raw)}")
        body.append(raw)
    top = "\n".join(head).encode()
    return zstandard.ZstdCompressor(level=level).compress(struct.pack("<I", len(top)) + top + b"".join(body))


def load(data: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<I", raw)
    at, out = 4 + n, {}
    for line in raw[4:at].decode().split("\n") if n else []:
        name, kind, shape, size = line.split(" ")
        dtype = np.dtype(kind)
        if shape == "p":
            x = np.frombuffer(raw, np.uint8, int(size), at).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel()
        else:
            x = np.frombuffer(raw, dtype, int(size) // dtype.itemsize, at)
        out[name] = x[0] if shape == "s" else x
        at += int(size)
    return out


def small(x: np.ndarray) -> np.ndarray:
    """The narrowest unsigned type that holds all values."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)
