"""Character n-grams of many texts at once, as 64-bit hashes, and lookups of chosen ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from faultline.llm.common import mix

RADIX = 0xD1342543DE82EF95
SLOTS = 20


def characters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts laid end to end, and the n + 1 borders; null is empty."""
    low = [t.lower() if t else "" for t in text.to_pylist()]
    borders = np.zeros(len(low) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=borders[1:])
    return np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4"), borders


def hashes(codes: np.ndarray, borders: np.ndarray, sizes: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: places of the n-grams that lie in one text, and their hashes before mixing."""
    left = np.repeat(borders[1:], np.diff(borders)) - np.arange(len(codes))
    h = np.zeros(len(codes), np.uint64)
    wide = codes.astype(np.uint64) + np.uint64(1)
    for n in range(1, sizes.stop):
        if n > len(codes):
            return
        h = h[: len(codes) - n + 1] * np.uint64(RADIX)
        h += wide[n - 1 :]
        if n >= sizes.start:
            at = np.flatnonzero(left[: len(h)] >= n)
            yield at, h[at]


class Lookup:
    """Which of the chosen n-grams each hash is: a table by hash bits, then the whole hash."""

    def __init__(self, chosen: np.ndarray):
        self.order = np.argsort(mix(chosen.copy()), kind="stable")
        self.mixed = mix(chosen.copy())[self.order]
        self.table = np.zeros(1 << SLOTS, bool)
        self.table[(self.mixed >> np.uint64(64 - SLOTS)).astype(np.int64)] = True

    def find(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into `raw`, index into the chosen ones) of every hash that is chosen."""
        h = mix(raw.copy())
        some = np.flatnonzero(self.table[(h >> np.uint64(64 - SLOTS)).astype(np.int64)])
        if not len(some) or not len(self.mixed):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.mixed, h[some])
        at[at == len(self.mixed)] = 0
        same = self.mixed[at] == h[some]
        return some[same], self.order[at[same]]
