"""Words of a text and their hashes, for whole batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word is a maximal run of letters and digits of any script, compared in lower case.
WORD = re.compile(r"[^\W_]+")

_B = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHasher:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 500_000):
        self._seen: dict[str, int] = {}
        self._most = most

    def __call__(self, tokens: list[str]) -> list[int]:
        seen = self._seen
        if len(seen) > self._most:
            seen.clear()
        out = []
        for w in tokens:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flatten(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values in one array, and the offset at which each list begins (with the total at the end)."""
    offsets = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((v for x in lists for v in x), dtype=np.uint64, count=int(offsets[-1]))
    return flat, offsets


def grams(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k-word run that begins at each position, and whether it ends inside the same list."""
    n = len(flat)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.zeros(n, dtype=bool)
    if n >= k:
        whole[: n - k + 1] = own[: n - k + 1] == own[k - 1 :]
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = np.zeros(n, dtype=np.uint64)
            part[: max(n - j, 0)] = flat[j:]
            h = h * _B + part
        h = mix(h)
    return h, whole
