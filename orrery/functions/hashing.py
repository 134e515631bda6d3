"""Murmur hashes with an explicit seed, of the bytes of texts.

The JVM's own ``hash`` mixes the last bytes of a text in another way, so that these run as Pandas UDFs. A batch is laid
out as one matrix of words, and each step of the hash is taken for all rows at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _words(texts: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole words of ``width`` bytes, the rest as one word, lengths in bytes); null texts count as empty."""
    data = [b"" if t is None else bytes(t) if isinstance(t, (bytes, bytearray)) else t.encode("utf-8", "surrogatepass") for t in texts]
    n = np.array([len(b) for b in data], dtype=np.int64)
    columns = int(n.max(initial=0)) // width + 1
    kind = np.dtype(f"<u{width}")
    flat = np.frombuffer(b"".join(b.ljust(columns * width, b"\0") for b in data), dtype=kind).reshape(len(data), columns)
    rest = flat[np.arange(len(data)), n // width] if len(data) else np.zeros(0, dtype=kind)
    return flat, rest, n


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def murmur3_32(texts: pd.Series, seed: int) -> np.ndarray:
    """Murmur3, x86, 32 bits."""
    flat, rest, n = _words(texts, 4)
    h = np.full(len(n), seed & 0xFFFFFFFF, dtype=np.uint32)
    mixed = lambda k: _turn(k * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    for at in range(flat.shape[1]):
        live = at < n // 4
        h[live] = _turn(h[live] ^ mixed(flat[live, at]), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.where(n % 4 > 0, mixed(rest), np.uint32(0))
    h ^= n.astype(np.uint32)
    for shift, times in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(times)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def murmur2_64(texts: pd.Series, seed: int) -> np.ndarray:
    """Murmur2, 64 bits, version A."""
    flat, rest, n = _words(texts, 8)
    m, r = np.uint64(0xC6A4A7935BD1E995), np.uint64(47)
    h = np.uint64(seed & 0xFFFFFFFF) ^ (n.astype(np.uint64) * m)
    for at in range(flat.shape[1]):
        live = at < n // 8
        k = flat[live, at] * m
        h[live] = (h[live] ^ ((k ^ (k >> r)) * m)) * m
    h = np.where(n % 8 > 0, (h ^ rest) * m, h)
    h = (h ^ (h >> r)) * m
    return (h ^ (h >> r)).view(np.int64)


def murmur2_32(texts: pd.Series, seed: int) -> np.ndarray:
    """Murmur2, 32 bits."""
    flat, rest, n = _words(texts, 4)
    m = np.uint32(0x5BD1E995)
    h = np.uint32(seed & 0xFFFFFFFF) ^ n.astype(np.uint32)
    for at in range(flat.shape[1]):
        live = at < n // 4
        k = flat[live, at] * m
        h[live] = (h[live] * m) ^ ((k ^ (k >> np.uint32(24))) * m)
    h = np.where(n % 4 > 0, (h ^ rest) * m, h)
    h = (h ^ (h >> np.uint32(13))) * m
    return (h ^ (h >> np.uint32(15))).view(np.int32)


_KINDS = {"murmur3_32": (murmur3_32, "int"), "murmur2_64": (murmur2_64, "long"), "murmur2_32": (murmur2_32, "int")}


def murmur(c: Column, kind: str = "murmur3_32", seed: int = 0) -> Column:
    """The hash of a text's UTF-8 bytes, or of a binary; null for null. ``kind`` is murmur3_32, murmur2_64 or murmur2_32."""
    f, result = _KINDS[kind]

    def run(texts: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(f(texts, seed), index=texts.index)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.when(c.isNotNull(), F.pandas_udf(run, result)(c))
