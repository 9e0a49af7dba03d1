"""Words of texts as 64-bit keys, for code that runs inside tasks."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import xxhash

#: The words a task remembers; a larger vocabulary only means that some words are hashed again.
REMEMBERED = 1 << 18


class WordKeys(dict):
    """Word (bytes) to its 64-bit key."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        key = self[word] = xxhash.xxh3_64_intdigest(word)
        return key

    def of(self, text: bytes | None) -> np.ndarray:
        """Keys of the words ``[^\\x20\\x09-\\x0D]+`` of ``text`` in order, A-Z lower-cased."""
        words = text.lower().split() if text else ()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def utf8(texts: pa.Array) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    return texts.cast(kind).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(keys: np.ndarray, width: int) -> np.ndarray:
    """Distinct keys, sorted, of the runs of ``width`` words; fewer words count as one run, none as no run."""
    if len(keys) == 0:
        return keys
    runs = max(1, len(keys) - width + 1)
    out = np.full(runs, len(keys) if len(keys) < width else width, np.uint64)
    for i in range(min(width, len(keys))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + keys[i : i + runs])
    return np.unique(out)


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library returns it by itself, or not at all
        pass
