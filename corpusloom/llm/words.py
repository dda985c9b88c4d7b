"""Words of whole texts as 64-bit hashes: a word is a run of bytes other than ASCII white space."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.llm import caches

ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)


#: Words whose hashes a worker remembers: about 50 MB.
REMEMBERED = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED and len(word) <= 40:
            self[word] = found
        return found


_HASHES = _Hashes()
caches.register("words", _HASHES.clear)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def split(column: pa.Array) -> list[list[bytes]]:
    return [t.split() for t in column.to_pylist()]


def hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and where each text begins (one more at the end)."""
    caches.only("words")
    at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) for w in words], out=at[1:])
    out = np.fromiter((h for w in words for h in map(_HASHES.__getitem__, w)), dtype=np.uint64, count=int(at[-1]))
    return out, at


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; len(h) - k + 1 of them. By doubling: log2(k) passes."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    out, size, power, factor = None, 0, h.copy(), ODD
    span = 1
    while k:
        if k & 1:  # append a run of `span` words to what there is
            out = power if out is None else out[: len(power) - size] * factor + power[size : size + len(out[: len(power) - size])]
            size += span
        k >>= 1
        if k:
            power, factor, span = power[:-span] * factor + power[span:], factor * factor, 2 * span
    return mix(out)
