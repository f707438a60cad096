"""Tokenizing each distinct segment of text once, with results kept in flat arrays.

One `SegmentIds` serves the tasks of one query in a worker: what it keeps must not outlive the query.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from faultline.llm.common import span_hashes, strings

#: Segments that one worker keeps; about 40 bytes each. Others are encoded again when they come again.
CACHE_SEGMENTS = 1_500_000

#: Ids of some texts laid end to end, and how many each has.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def one_by_one(tokenizer) -> Encode:
    """Each text by itself."""

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        sizes = np.fromiter((len(ids) for ids in found), np.int32, len(found))
        return np.array([i for ids in found for i in ids], np.uint32), sizes

    return encode


def many_at_once(tokenizer, each: int = 64) -> Encode:
    """Texts with spaces between them, `each` to a call, told apart by the places of their ids; for tokenizers
    that drop spaces and join nothing over them. A third of the cost of single short texts."""

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        calls = range(0, len(texts), each)
        found = tokenizer.encode_batch([" ".join(texts[i : i + each]) for i in calls], add_special_tokens=False)
        places = [np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0] + starts[i] for i, e in zip(calls, found)]
        owner = np.searchsorted(starts, np.concatenate(places), side="right") - 1
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        return ids, np.bincount(owner, minlength=len(texts)).astype(np.int32)

    return encode


class SegmentIds:
    """Ids of segments by their hash, length and first bytes, as `encode` gave them."""

    def __init__(self, encode: Encode, most: int = CACHE_SEGMENTS):
        self.fresh, self.most = encode, most
        self.hash = np.zeros(0, np.uint64)
        self.head = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint16)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments laid end to end (uint32), and the n + 1 borders of each segment's ids."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        h, head = span_hashes(data, starts, ends), _heads(data, starts, ends)
        keys, first, code = np.unique(h, return_index=True, return_inverse=True)
        head = head[first]
        at = np.searchsorted(self.hash, keys)
        at[at == len(self.hash)] = 0
        known = (self.hash[at] == keys) & (self.head[at] == head) if len(self.hash) else np.zeros(len(keys), bool)
        new = np.flatnonzero(~known)
        start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        start[known], size[known] = self.start[at[known]], self.size[at[known]]
        pool = self.pool
        if len(new):
            a, b = starts[first[new]], ends[first[new]]
            fresh, sizes = self._fresh(data, a, b)
            size[new], start[new] = sizes, np.cumsum(sizes) - sizes + len(pool)
            pool = np.concatenate([pool, fresh if len(fresh) and fresh.max() > 0xFFFF else fresh.astype(pool.dtype)])
            if len(self.hash) + len(new) <= self.most:
                into = np.searchsorted(self.hash, keys[new])
                # Of two segments with one hash the first stays; the other is told apart by its head.
                self.hash, self.head, self.start, self.size = (
                    np.insert(old, into, values[new])
                    for old, values in ((self.hash, keys), (self.head, head), (self.start, start), (self.size, size))
                )
                self.pool = pool
        each = size[code].astype(np.int64)
        borders = np.zeros(len(code) + 1, np.int64)
        np.cumsum(each, out=borders[1:])
        where = np.arange(borders[-1]) + np.repeat(start[code] - borders[:-1], each)
        return pool[where].astype(np.uint32), borders

    def _fresh(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = b - a
        borders = np.zeros(len(a) + 1, np.int64)
        np.cumsum(size, out=borders[1:])
        where = np.arange(borders[-1]) + np.repeat(a - borders[:-1], size)
        texts = strings(data[where], borders).to_pylist()
        ids, sizes = zip(*(self.fresh(texts[at : at + 8192]) for at in range(0, len(texts), 8192)))
        return np.concatenate(ids), np.concatenate(sizes)


def _heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A segment's length and its first seven bytes as one number."""
    size = ends - starts
    out = np.minimum(size, 255).astype(np.uint64) << np.uint64(56)
    for k in range(7):
        has = np.flatnonzero(size > k)
        out[has] |= data[starts[has] + k].astype(np.uint64) << np.uint64(8 * k)
    return out
