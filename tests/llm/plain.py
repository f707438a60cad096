"""Brute-force versions, written for clearness alone."""

import hashlib
import re
from collections import defaultdict

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {65 + i: 97 + i for i in range(26)}


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def without_repeats(docs, window=20):
    """{doc_id: (n_words, kept words)} for {doc_id: text}; distinct ids."""
    seen, out = set(), {}
    for i in sorted(docs, key=lambda i: (i is not None, i)):
        words = SPACE_WORD.findall(docs[i] or "")
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            run = tuple(words[at : at + window])
            if run in seen:
                gone[at : at + window] = [True] * window
            seen.add(run)
        out[i] = (len(words), [w for w, g in zip(words, gone) if not g])
    return out


def simhash(text, shingle=4):
    words = SPACE_WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    ones = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def groups(prints, radius=4):
    """{id: least id reachable} for {id: fingerprint}."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius and find(a) != find(b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def contamination(docs, items, window=13):
    """{doc_id: (n_words, n_hit, items)}; items is a list of (item_id, text)."""
    windows = defaultdict(set)
    for i, text in items:
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        n = min(window, len(words))
        for at in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[at : at + n])].add("" if i is None else str(i))
    out = {}
    for i, text in docs.items():
        words = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = [False] * len(words), set()
        for n in {len(w) for w in windows}:
            for at in range(len(words) - n + 1):
                if (key := tuple(words[at : at + n])) in windows:
                    hit[at : at + n] = [True] * n
                    found |= windows[key]
        out[i] = (len(words), sum(hit), sorted(found))
    return out
