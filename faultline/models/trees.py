"""Trees, forests and boosted trees over binned features, grown for all folds together.

Features are cut into at most 256 bins once, at quantiles of all rows; a row is then a few bytes. Every tree of
every cell (a round and fold, say) grows level by level from sums per node, feature and bin:

* nodes with many training rows are split by whole passes over the rows. Each task sums the histograms of the
  open nodes of all cells and trees, the sums of a node's feature are merged where its best cut is chosen, and one
  line per node and feature comes back;
* a node of at most `LOCAL_ROWS` training rows is finished in one task, which gets its training rows and those to
  predict. A cell that a task can hold as a whole (`CELL_ROWS`) is dealt out by runs of trees instead, so its rows
  travel once per run, not once per tree.

Both take the same cuts, so where the border lies changes no tree. Nodes are named by their path from the root;
which features a node tries, random cuts and the rows of a forest's tree follow from hashes of path, seed and row key,
so nothing depends on partitions or order. No tree is gathered: rows are predicted where their leaf is found.

A node splits if it has `min_samples_split` rows, both labels and less than the greatest depth, at the cut of
least impurity between two bins that occur in it, at the middle of their greatest values (at their middle bin, if
`Settings.tops` does not tell these); ties go to the feature tried first and the lower bin. Where none of the features a node may try can split it, it tries the others. Depth has no bound.
Missing values share the last bin. A tree without training rows predicts 0.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from faultline.session import stage

BINS = 256
#: Training rows of a node that one task finishes.
LOCAL_ROWS = 50_000
#: Training rows of a cell that one task holds, about 1 GB with 30 features and a fifth as many rows to predict.
CELL_ROWS = 2_500_000
#: Rows times trees that grow at once: a larger cell's trees grow one by one, which stays nearer to the cache.
ENTRIES = 100_000
#: Training rows of a cell whose boosting runs in one task: 30 bytes each at 30 features.
BOOSTED_ROWS = 1_000_000
#: Entries of the nodes that grow together: what they take stays in the cache.
NEAR = 32_768
#: Trees of one cell that a task grows side by side.
TREES_EACH = 16
#: Nodes whose histograms a task holds at once, 6 KB each and feature tried.
OPEN_NODES = 1024


@dataclass(frozen=True)
class Settings:
    """`features` a node tries, None for all; `bootstrap` draws each tree's rows with replacement; `tops` of `bin_tops`."""

    trees: int = 1
    criterion: str = "gini"
    splitter: str = "best"
    max_depth: int | None = None
    min_samples_split: int = 2
    features: int | None = None
    bootstrap: bool = False
    boosted: bool = False
    rate: float = 0.1
    tops: np.ndarray | None = field(default=None, compare=False, repr=False)


def settings(name: str, config: dict, width: int, tops: np.ndarray | None = None) -> Settings:
    """Of a tree (DT), a forest (RF) that tries the root of the number of features, or boosted trees (GBOOST)."""
    shared = {"max_depth": config.get("max_depth"), "min_samples_split": config.get("min_samples_split", 2), "tops": tops}
    if name == "DT":
        return Settings(criterion=config["criterion"], splitter=config.get("splitter", "best"), **shared)
    if name == "RF":
        return Settings(trees=config["n_estimators"], features=max(1, int(width**0.5)), bootstrap=True, **shared)
    if name == "GBOOST":
        return Settings(trees=config["n_estimators"], boosted=True, **shared)
    raise ValueError(f"no such model: {name}")


# ---- hashes --------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _even(h: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1)."""
    return (h >> np.uint64(11)) * 2.0**-53


def roots(seed: int, trees: np.ndarray) -> np.ndarray:
    """The paths of the trees' roots."""
    with np.errstate(over="ignore"):
        return _mix(_mix(np.full(len(trees), seed % (1 << 64), np.uint64)) + (trees.astype(np.uint64) + np.uint64(1)) * _ODD)


def children(path: np.ndarray) -> np.ndarray:
    """Two paths per path: of the rows up to the cut, and of the others."""
    with np.errstate(over="ignore"):
        return np.stack([_mix(path + _ODD), _mix(path + _ODD + _ODD)], axis=1).ravel()


#: The chances of at most 0, 1, 2, ... copies of a row among as many draws as there are rows.
_AT_MOST = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1), dtype=float) for k in range(16)])


def drawn(key: np.ndarray, root: np.ndarray) -> np.ndarray:
    """How often each row is drawn for the tree of each root."""
    return np.searchsorted(_AT_MOST, _even(_mix(key ^ root)), side="right").astype(float)


def tried(path: np.ndarray, width: int, some: int | None) -> np.ndarray:
    """The order in which the nodes try features: as they are if all count, else by hash."""
    if some is None or some >= width:
        return np.broadcast_to(np.arange(width), (len(path), width))
    with np.errstate(over="ignore"):
        draws = _mix(path[:, None] + np.arange(1, width + 1, dtype=np.uint64) * _ODD)
    # Numbers sort several times faster than places do, so the place takes the last bits of each.
    last = np.uint64((1 << (width - 1).bit_length()) - 1)
    return (np.sort(draws & ~last | np.arange(width, dtype=np.uint64), axis=1) & last).astype(np.int64)


# ---- cuts ----------------------------------------------------------------------------------------


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log2(np.maximum(x, 1e-300))


def _purity(criterion: str, lw, lp, rw, rp) -> np.ndarray:
    """Grows as the weighted impurity of the two sides falls; w are weights, p those of label 1 (or target sums).
    Gini impurity of two labels and squared error of a target order cuts alike."""
    if criterion == "entropy":
        return sum(_plogp(p) + _plogp(w - p) - _plogp(w) for w, p in ((lw, lp), (rw, rp)))
    return lp * lp / lw + rp * rp / rw


def _middle(tops: np.ndarray, feature, low, high) -> np.ndarray:
    """The last bin that ends no higher than the middle of the greatest values of two bins, at least the lower one."""
    with np.errstate(invalid="ignore"):
        middle = tops[feature, low] / 2 + tops[feature, high] / 2
    while (high - low > 1).any():
        at = (low + high) >> 1
        below = (tops[feature, at] <= middle) | (at == low)
        low, high = np.where(below, at, low), np.where(below, high, at)
    return low


def pick(key, w, p, total_w, total_p, path, order, choice: Settings):
    """The best cut of each node that has one: (node, purity, bin, left weight, left sum).

    `key` is node * 256 + bin, ascending, for the bins that occur in the nodes; `order` the feature each tries.
    """
    node, bin_ = key >> 8, key & 255
    first = np.searchsorted(node, np.arange(len(path)))
    sum_w, sum_p = np.append(0, np.cumsum(w)), np.append(0, np.cumsum(p))
    if choice.splitter == "random":
        last = np.searchsorted(node, np.arange(len(path)), side="right") - 1
        at = np.flatnonzero((last > first) & (first < len(node)))
        low, high = bin_[first[at]], bin_[last[at]]
        with np.errstate(over="ignore"):
            share = _even(_mix(path[at] ^ _mix((order[at] + 1).astype(np.uint64) * _ODD)))
        cut = low + np.floor(share * (high - low)).astype(np.int64)
        to = np.searchsorted(key, at * BINS + cut, side="right") - 1
    else:
        to = np.flatnonzero(node[:-1] == node[1:])
        at, cut = node[to], (bin_[to] + bin_[to + 1]) >> 1
    lw, lp = sum_w[to + 1] - sum_w[first[at]], sum_p[to + 1] - sum_p[first[at]]
    purity = _purity(choice.criterion, lw, lp, total_w[at] - lw, total_p[at] - lp)
    if not len(at):
        return at, purity, cut, lw, lp
    begin = np.flatnonzero(np.diff(at, prepend=-1))
    best = np.maximum.reduceat(purity, begin)
    hit = np.flatnonzero(purity == np.repeat(best, np.diff(np.append(begin, len(at)))))
    chosen = hit[np.flatnonzero(np.diff(at[hit], prepend=-1))]
    if choice.tops is not None and choice.splitter != "random":
        cut[chosen] = _middle(choice.tops, order[at[chosen]], bin_[to[chosen]], bin_[to[chosen] + 1])
    return at[chosen], purity[chosen], cut[chosen], lw[chosen], lp[chosen]


def _sums(key: np.ndarray, size: int, w: np.ndarray, p: np.ndarray):
    """The keys that occur, ascending, with their sums."""
    if size <= 4 * len(key):
        there = np.flatnonzero(np.bincount(key, minlength=size))
        return there, np.bincount(key, w, size)[there], np.bincount(key, p, size)[there]
    there, code = np.unique(key, return_inverse=True)
    return there, np.bincount(code, w, len(there)), np.bincount(code, p, len(there))


def _best(bins, row, node, w, p, total_w, total_p, path, choice: Settings):
    """(feature, bin) of each node's best cut; feature -1 where none splits it."""
    n, width = len(path), bins.shape[1]
    order, some = tried(path, width, choice.features), choice.features or width
    top, feature, cut = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64)
    for j in range(width):
        if j >= some:
            open_ = feature < 0
            if not open_.any():
                break
            left = open_[node]
            row, node, w, p = row[left], node[left], w[left], p[left]
        key, sum_w, sum_p = _sums(node * BINS + bins[row, order[node, j]], n * BINS, w, p)
        at, purity, at_bin, _, _ = pick(key, sum_w, sum_p, total_w, total_p, path, order[:, j], choice)
        better = purity > top[at]
        at = at[better]
        top[at], feature[at], cut[at] = purity[better], order[at, j], at_bin[better]
    return feature, cut


def _both(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Two whole numbers as one, so that both are summed at once; no digit is lost while weights sum to less than `_HALF`."""
    return w + p * _HALF


def _apart(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = both * (1 / _HALF)
    np.floor(p, out=p)
    return both - p * _HALF, p


_HALF = 2.0**26
#: Most copies of a drawn row; copies and label are the last bits of an entry, and `_ENTRY` has what they sum to.
_COPIES = 31
_BITS = 6
_ENTRY = _both(np.arange(2.0 * _COPIES + 2) // 2, np.arange(2.0 * _COPIES + 2) // 2 * (np.arange(2 * _COPIES + 2) % 2))


def _best_of_labels(flat, at, node, entry, total, path, width: int, choice: Settings):
    """What `_best` gives for whole weights and labels, and the same cuts, by short sorts in place of wide sums.

    `flat[at + j]` is the j-th feature's bin of an entry, `total` what the entries of each node sum to.
    """
    n = len(path)
    order, some = tried(path, width, choice.features), choice.features or width
    top, feature, low, high = np.full(n, -np.inf), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    total_w, total_p = _apart(total)
    before = np.cumsum(total) - total
    kind = np.uint32 if n < 1 << (32 - 8 - _BITS) else np.uint64
    dense = n * BINS <= 4 * len(node)
    shifted = node << 8
    base = _ENTRY.take(entry) if dense else (shifted << _BITS | entry).astype(kind)
    for j in range(width):
        if j >= some:
            open_ = feature < 0
            if not open_.any():
                break
            left = np.flatnonzero(open_.take(node))
            at, node, shifted, base = at[left], node[left], shifted[left], base[left]
            before = np.cumsum(np.where(open_, total, 0)) - total
        turn = np.ascontiguousarray(order[:, j])
        bin_ = flat.take(at + turn.take(node))
        if dense:
            sums = np.bincount(shifted + bin_, base, n * BINS)
            key = np.flatnonzero(sums)
            sums = np.cumsum(sums.take(key))
        else:
            line = bin_.astype(kind)
            line <<= kind(_BITS)
            line += base
            line.sort()
            place = line >> kind(_BITS)
            last = np.append(np.flatnonzero(place[1:] != place[:-1]), len(place) - 1)
            key = place.take(last)
            line &= kind((1 << _BITS) - 1)
            sums = np.cumsum(_ENTRY.take(line)).take(last)
        # Runs of a node's bins; a cut follows each but the last one of a run.
        own = key >> key.dtype.type(8)
        ends = np.append(np.flatnonzero(own[1:] != own[:-1]), len(own) - 1)
        begin, there = np.append(0, ends[:-1] + 1), own.take(ends).astype(np.int64)
        count = ends - begin + 1
        lw, lp = _apart(sums - np.repeat(before[there], count))
        rw, rp = np.repeat(total_w[there], count), np.repeat(total_p[there], count)
        rw -= lw
        rp -= lp
        rw[ends] = 1.0
        purity = _purity(choice.criterion, lw, lp, rw, rp)
        purity[ends] = -np.inf
        best = np.maximum.reduceat(purity, begin)
        better = best > top[there]
        hit = np.flatnonzero(purity == np.repeat(np.where(better, best, np.inf), count))
        mine = own.take(hit).astype(np.int64)
        first = np.flatnonzero(np.diff(mine, prepend=-1))
        hit, won = hit[first], mine[first]
        top[won], feature[won], low[won], high[won] = purity[hit], turn[won], key[hit] & 255, key[hit + 1] & 255
    cut = (low + high) >> 1
    if choice.tops is not None:
        found = np.flatnonzero(feature >= 0)
        cut[found] = _middle(choice.tops, feature[found], low[found], high[found])
    return feature, cut


@dataclass
class _Part:
    """Nodes that grow together, few enough to stay in the cache: their entries, the rows asked and the bins of both.

    `flat[at + j]` is an entry's bin of feature j, `flat[asked + j]` that of an asked row; `alive` is its place in the answer.
    """

    flat: np.ndarray
    at: np.ndarray
    node: np.ndarray
    entry: np.ndarray
    asked: np.ndarray
    asked_node: np.ndarray
    alive: np.ndarray
    path: np.ndarray

    def cut(self, width: int) -> list["_Part"]:
        """Parts of whole nodes with some `NEAR` entries each."""
        n = len(self.path)
        if len(self.node) <= 2 * NEAR or n == 1:
            return [self]
        number = np.cumsum(np.bincount(self.node, minlength=n)) // NEAR
        edges = np.append(np.flatnonzero(np.diff(number, prepend=-1)), n)
        if len(edges) == 2:
            return [self]
        which = np.repeat(np.arange(len(edges) - 1), np.diff(edges)).astype(np.uint16 if len(edges) <= 1 << 16 else np.int64)
        mine, ask = (
            np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(edges) - 1))[:-1])
            for of in (which[self.node], which[self.asked_node])
        )
        return [self._some(slice(*some), *both, width) for *some, both in zip(edges[:-1], edges[1:], zip(mine, ask))]

    def _some(self, nodes: slice, mine: np.ndarray, ask: np.ndarray, width: int) -> "_Part":
        rows = np.concatenate([self.at[mine], self.asked[ask]]) // width
        at = np.arange(0, len(rows) * width, width)
        flat = self.flat.reshape(-1, width)[rows].ravel()
        node, asked_node = self.node[mine] - nodes.start, self.asked_node[ask] - nodes.start
        return _Part(flat, at[: len(mine)], node, self.entry[mine], at[len(mine) :], asked_node, self.alive[ask], self.path[nodes])

    @staticmethod
    def joined(parts: list["_Part"], width: int) -> "_Part":
        if len(parts) == 1:
            return parts[0]
        # What is left of a part's rows is laid together anew.
        parts = [p._some(slice(0, None), np.arange(len(p.node)), np.arange(len(p.alive)), width) for p in parts]
        nodes, rows = (np.cumsum([0, *(len(x) for x in xs)]) for xs in ([p.path for p in parts], [p.flat for p in parts]))
        more = {"node": nodes, "asked_node": nodes, "at": rows, "asked": rows}
        return _Part(*(np.concatenate([getattr(p, c) + more[c][i] if c in more else getattr(p, c) for i, p in enumerate(parts)]) for c in _Part.__match_args__))

    def step(self, depth: int, width: int, choice: Settings, out: np.ndarray) -> bool:
        """Split the nodes once; rows asked that stand at leaves are answered. Whether any are left."""
        n, node, asked_node = len(self.path), self.node, self.asked_node
        total = np.bincount(node, _ENTRY.take(self.entry), n)
        total_w, total_p = _apart(total)
        value = total_p / np.maximum(total_w, 1e-300)
        # Nodes of both labels have two rows at least.
        count = np.bincount(node, minlength=n) if choice.min_samples_split > 2 else 2
        to = np.flatnonzero(splits((total_p > 0) & (total_p < total_w), count, depth, choice))
        feature, cut, place = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
        if len(to):
            if len(to) < n:
                place[to] = np.arange(len(to))
                inside = place.take(node)
                on = np.flatnonzero(inside >= 0)
                self.at, node, self.entry = self.at[on], inside[on], self.entry[on]
            feature[to], cut[to] = _best_of_labels(self.flat, self.at, node, self.entry, total[to], self.path[to], width, choice)
        grown = np.flatnonzero(feature >= 0)
        if len(grown) < n:
            ends = feature.take(asked_node) < 0
            out[self.alive[ends]] = value[asked_node[ends]]
            on = np.flatnonzero(~ends)
            self.alive, self.asked, asked_node = self.alive[on], self.asked[on], asked_node[on]
        if not len(self.alive):
            return False
        place[grown] = np.arange(len(grown)) * 2
        self.asked_node = place.take(asked_node) + (self.flat.take(self.asked + feature.take(asked_node)) > cut.take(asked_node))
        # Entries stand at the nodes of `to` by now.
        feature, cut = feature[to], cut[to]
        if len(grown) < len(to):
            on = np.flatnonzero(feature.take(node) >= 0)
            self.at, node, self.entry = self.at[on], node[on], self.entry[on]
        self.node = place[to].take(node) + (self.flat.take(self.at + feature.take(node)) > cut.take(node))
        self.path = children(self.path[grown])
        return True


def _finish_labels(bins, label, row, node, w, asked, asked_node, path, depth: int, choice: Settings) -> np.ndarray:
    """`finish` for whole weights and labels: level by level too, but part by part of a level."""
    out, width = np.zeros(len(asked)), bins.shape[1]
    entry = w.astype(np.int64) << 1 | label[row].astype(np.int64)
    flat = np.ascontiguousarray(bins).ravel()
    parts = [_Part(flat, row * width, node, entry, asked * width, asked_node, np.arange(len(asked)), path)] if len(asked) else []
    while parts:
        parts = [p for whole in parts for p in whole.cut(width)]
        parts = [p for p in parts if p.step(depth, width, choice, out)]
        depth += 1
        # Parts that have become small are joined.
        size = np.array([len(p.node) + len(p.alive) for p in parts])
        if len(parts) > 1 and size.min() < NEAR // 4:
            number = np.cumsum(size) // NEAR
            parts = [_Part.joined([parts[i] for i in np.flatnonzero(number == k)], width) for k in np.unique(number)]
    return out


def splits(mixed, count, depth: int, choice: Settings) -> np.ndarray:
    """Which nodes are to be split, by whether their targets differ, and their rows."""
    deep = choice.max_depth is not None and depth >= choice.max_depth
    return mixed & (count >= choice.min_samples_split) & (not deep)


def finish(bins, target, row, node, w, asked, asked_node, path, depth: int, choice: Settings, share=None) -> np.ndarray:
    """Grow nodes to their leaves and give each asked row its leaf's value.

    Training entries are (row, node, w), asked ones (asked, asked_node); node k has path[k]. A leaf's value is
    the mean target, or its sum over that of `share` per entry.
    """
    if share is None and not choice.boosted and choice.splitter == "best" and w.max(initial=0) <= _COPIES and w.sum() < _HALF:
        return _finish_labels(bins, target, row, node, w, asked, asked_node, path, depth, choice)
    out, alive = np.zeros(len(asked)), np.arange(len(asked))
    p = w * target[row]
    share = w if share is None else share
    while len(alive):
        n = len(path)
        total_w, total_p = np.bincount(node, w, n), np.bincount(node, p, n)
        value = total_p / np.maximum(np.bincount(node, share, n), 1e-300)
        feature, cut = np.full(n, -1), np.zeros(n, np.int64)
        mixed = (total_p > 0) & (total_p < total_w)
        if choice.boosted:
            mixed = total_w * np.bincount(node, p * target[row], n) > total_p**2 + 1e-12 * total_w**2
        to = np.flatnonzero(splits(mixed, np.bincount(node, minlength=n), depth, choice))
        if len(to):
            place = np.full(n, -1)
            place[to] = np.arange(len(to))
            on = place[node] >= 0
            feature[to], cut[to] = _best(bins, row[on], place[node[on]], w[on], p[on], total_w[to], total_p[to], path[to], choice)
        ends = feature[asked_node] < 0
        out[alive[ends]] = value[asked_node[ends]]
        alive, asked, asked_node = alive[~ends], asked[~ends], asked_node[~ends]
        grown = np.flatnonzero(feature >= 0)
        place = np.full(n, -1)
        place[grown] = np.arange(len(grown)) * 2
        on = place[node] >= 0
        row, node, w, p, share = row[on], node[on], w[on], p[on], share[on]
        node = place[node] + (bins[row, feature[node]] > cut[node])
        asked_node = place[asked_node] + (bins[asked, feature[asked_node]] > cut[asked_node])
        path, depth = children(path[grown]), depth + 1
    return out


def grow(bins, label, key, trains, seed: int, trees: np.ndarray, choice: Settings) -> np.ndarray:
    """The sum over whole trees of the value of each row that does not train."""
    train, ask = np.flatnonzero(trains), np.flatnonzero(~trains)
    each = max(1, ENTRIES // max(len(trains), 1))
    out = np.zeros(len(ask))
    for at in range(0, len(trees), each):
        for value in _grow_some(bins, label, key, train, ask, roots(seed, trees[at : at + each]), choice):
            out += value
    return out


def _grow_some(bins, label, key, train, ask, path, choice: Settings) -> np.ndarray:
    """The value of each asked row in each tree."""
    trees = path
    tree = np.repeat(np.arange(len(trees)), len(train))
    row = np.tile(train, len(trees))
    w = drawn(key[row], path[tree]) if choice.bootstrap else np.ones(len(row))
    row, tree, w = row[w > 0], tree[w > 0], w[w > 0]
    asked, asked_tree = np.tile(ask, len(trees)), np.repeat(np.arange(len(trees)), len(ask))
    value = finish(bins, label, row, tree, w, asked, asked_tree, path, 0, choice)
    return value.reshape(len(trees), len(ask))


def boost(bins, label, trains, seed: int, choice: Settings) -> np.ndarray:
    """The log-odds of each row that does not train, by trees fitted to the gradient of the log loss."""
    train, ask = np.flatnonzero(trains), np.flatnonzero(~trains)
    if not len(train):
        return np.full(len(ask), -np.inf)
    share = label[train].mean()
    if share in (0.0, 1.0):
        return np.full(len(ask), np.inf if share else -np.inf)
    odds = np.full(len(label), np.log(share / (1 - share)))
    everyone, zeros = np.arange(len(label)), np.zeros(len(label), np.int64)
    for tree in range(choice.trees):
        chance = 1 / (1 + np.exp(-odds))
        left = label - chance
        path = roots(seed, np.array([tree]))
        curve = np.maximum((chance * (1 - chance))[train], 1e-12)
        odds += choice.rate * finish(
            bins, left, train, zeros[: len(train)], np.ones(len(train)), everyone, zeros, path, 0, choice, curve
        )
    return odds[ask]


# ---- rows ----------------------------------------------------------------------------------------


def bin_tops(rows: DataFrame, features: list[str]) -> np.ndarray:
    """The greatest value of each bin, a line per feature: quantiles of all rows' values, their maximum, then infinity.

    Labels are not looked at. This is the only thing gathered.
    """
    shares = [(k + 1) / BINS for k in range(BINS - 1)]
    ends = [F.percentile_approx(c, shares, 10_000) for c in features]
    found = rows.agg(*ends, *(F.max(c) for c in features)).first()
    tops = np.full((len(features), BINS), np.inf)
    for line, values, greatest in zip(tops, found, found[len(features) :]):
        if values is not None:
            known = np.append(np.unique(np.array(values, float)), float(greatest))
            line[: len(known)] = known
    return tops


def binned(rows: DataFrame, features: list[str], keys: list[str], tops: np.ndarray | None = None) -> DataFrame:
    """`rows` with `bins`, a byte per feature, in the features' place, and `key`, a hash of the keys; staged.

    Bins end at `tops`, those of `bin_tops` if not given.
    """
    tops = bin_tops(rows, features) if tops is None else tops
    others = [c for c in rows.columns if c not in features]
    schema = T.StructType([rows.schema[c] for c in others] + [T.StructField("bins", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.empty((batch.num_rows, len(features)), np.uint8)
            for k, c in enumerate(features):
                values = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                wide[:, k] = np.where(np.isnan(values), BINS - 1, np.searchsorted(tops[k, : BINS - 1], values))
            cut = np.arange(batch.num_rows + 1, dtype=np.int32) * len(features)
            packed = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cut), pa.py_buffer(wide)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), packed], names=[*others, "bins"])

    return stage(rows.select(*others, *features).mapInArrow(run, schema).withColumn("key", F.xxhash64(*keys)))


def _unpacked(column: pa.Array) -> np.ndarray:
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    joined = []
    for data in parts:
        kind = np.int64 if pa.types.is_large_binary(data.type) else np.int32
        edges = np.frombuffer(data.buffers()[1], kind)[data.offset : data.offset + len(data) + 1]
        if len(data):
            joined.append(np.frombuffer(data.buffers()[2], np.uint8)[edges[0] : edges[-1]])
    return np.concatenate(joined or [np.zeros(0, np.uint8)]).reshape(len(column), -1)


def _numbers(table, name: str, kind) -> np.ndarray:
    return np.asarray(table.column(name).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(name).to_numpy(), kind)


def fit_predict(
    rows: DataFrame,
    keys: list[str],
    choice: Settings,
    by: list[str],
    seed: str = "round",
    local_rows: int | None = None,
) -> DataFrame:
    """Predict the rows that do not train of every `by` cell: (by, split, keys, y, p, train_seconds).

    `rows` comes from `binned`, each once per cell with `split` ('train' or not) and an int `label`. The seed
    of a cell's trees is its `seed` column. `train_seconds` is the time tasks spent growing the cell's trees.
    """
    local = local_rows or (BOOSTED_ROWS if choice.boosted else LOCAL_ROWS)
    held = local_rows or (BOOSTED_ROWS if choice.boosted else CELL_ROWS)
    sizes = rows.where(F.col("split") == "train").groupBy(*by).agg(F.count(F.lit(1)).alias("n")).collect()
    large = [tuple(r)[:-1] for r in sizes if r.n > held]
    if large and choice.boosted:
        raise ValueError(f"boosting takes at most {local} training rows in a fold")
    named = rows.withColumn("seed", F.col(seed).cast("bigint")) if seed in by else rows.withColumn("seed", F.lit(0).cast("bigint"))
    is_large = F.lit(False)
    for cell in large:
        same = F.lit(True)
        for c, v in zip(by, cell):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        is_large = is_large | same
    small = named.where(~is_large) if large else named
    # Cells that take long get a task for each run of trees.
    apart = len(sizes) - len(large) if any(LOCAL_ROWS < r.n <= held for r in sizes) else None
    found = _whole_cells(small, keys, choice, by, apart)
    if large:
        found = found.unionByName(_Top(named.where(is_large), keys, choice, by, large, local).values())
    found = stage(found)
    chance = F.sum("value") / (1 if choice.boosted else choice.trees)
    seconds = found.groupBy(*by, "part").agg(F.max("seconds").alias("s")).groupBy(*by).agg(F.sum("s").alias("train_seconds"))
    label = F.col("label").alias("y")
    # A share of one half, but for rounding of the sum, is label 0.
    predicted = (chance > (0.0 if choice.boosted else 0.5 + 1e-9)).cast("int").alias("p")
    summed = found.groupBy(*by, "split", *keys, label).agg(predicted)
    timed = seconds.select(F.struct(*by).alias("cell"), "train_seconds")
    return summed.withColumn("cell", F.struct(*by)).join(timed, "cell").select(*by, "split", *keys, "y", "p", "train_seconds")


def boosts(rows: DataFrame, by: list[str]) -> bool:
    """Whether the training rows of every cell are few enough to boost in one task."""
    sizes = rows.where(F.col("split") == "train").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return (sizes.agg(F.max("n")).first()[0] or 0) <= BOOSTED_ROWS


def _value_schema(rows: DataFrame, keys: list[str], by: list[str]) -> T.StructType:
    kept = [rows.schema[c] for c in [*by, "split", *keys, "label"]]
    extra = [("part", T.LongType()), ("value", T.DoubleType()), ("seconds", T.DoubleType())]
    return T.StructType(kept + [T.StructField(n, t) for n, t in extra])


def _valued(table: pa.Table, ask: np.ndarray, names: list[str], part: int, value: np.ndarray, began: float) -> pa.Table:
    out = table.select(names).take(pa.array(ask))
    for name, column in (
        ("part", np.full(len(ask), part, np.int64)),
        ("value", value),
        ("seconds", np.full(len(ask), time.process_time() - began)),
    ):
        out = out.append_column(name, pa.array(column))
    return out


def _whole_cells(rows: DataFrame, keys: list[str], choice: Settings, by: list[str], apart: int | None = None) -> DataFrame:
    """Values of cells that a task can hold: a group per cell and run of trees, for `apart` cells nearly a task each."""
    names = [*by, "split", *keys, "label"]
    parts = 1 if choice.boosted else -(-choice.trees // TREES_EACH)
    dealt = rows.withColumn("part", F.explode(F.lit(list(range(parts))).cast("array<bigint>")))
    if apart is not None:
        # A number that is given is not coalesced to fewer.
        dealt = dealt.repartition(4 * apart * parts, *by, "part")

    def run(table: pa.Table) -> pa.Table:
        began = time.process_time()
        if choice.boosted:
            # Sums of targets depend on order, if only in the last digit; those of labels and draws are whole.
            table = table.sort_by("key")
        bins, label, trains = _unpacked(table.column("bins")), _numbers(table, "label", float), _numbers(table, "split", object) == "train"
        part, seed = table.column("part")[0].as_py(), table.column("seed")[0].as_py()
        if choice.boosted:
            value = boost(bins, label, trains, seed, choice)
        else:
            trees = np.arange(part * TREES_EACH, min(choice.trees, (part + 1) * TREES_EACH))
            value = grow(bins, label, _numbers(table, "key", np.int64).view(np.uint64), trains, seed, trees, choice)
        return _valued(table, np.flatnonzero(~trains), names, part, value, began)

    return dealt.groupBy(*by, "part").applyInArrow(run, _value_schema(rows, keys, by))


# ---- large cells ---------------------------------------------------------------------------------


@dataclass
class _Tree:
    """The top of one tree: node 0 is its root. feature -1 is a leaf, -2 finished elsewhere, -3 open."""

    path: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    child: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def add(self, path: int, depth: int, feature: int, value: float) -> int:
        for column, v in zip((self.path, self.depth, self.feature, self.cut, self.child, self.value), (path, depth, feature, 0, -1, value)):
            column.append(v)
        return len(self.path) - 1

    def arrays(self) -> dict:
        return {"feature": np.array(self.feature), "cut": np.array(self.cut), "child": np.array(self.child), "value": np.array(self.value)}


def _route(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node of a tree's top where each row stands."""
    node = np.zeros(len(bins), np.int64)
    while True:
        on = np.flatnonzero(tree["feature"][node] >= 0)
        if not len(on):
            return node
        at = node[on]
        node[on] = tree["child"][at] + (bins[on, tree["feature"][at]] > tree["cut"][at])


class _Top:
    """Grows the trees of large cells by passes over their rows down to nodes that one task can finish."""

    def __init__(self, rows: DataFrame, keys: list[str], choice: Settings, by: list[str], cells: list[tuple], local: int):
        self.rows, self.keys, self.choice, self.by, self.local = rows, keys, choice, by, local
        self.cells = {cell: at for at, cell in enumerate(cells)}
        seeds = rows.select(*by, "seed").distinct().collect()
        self.seeds = {self.cells[tuple(r)[:-1]]: r.seed for r in seeds}
        self.width = len(rows.select("bins").first().bins)
        self.trees: dict[tuple[int, int], _Tree] = {}
        for cell, seed in self.seeds.items():
            for t, path in enumerate(roots(seed, np.arange(choice.trees))):
                tree = self.trees[cell, t] = _Tree()
                tree.add(path, 0, -3, 0.0)
        self._grow()

    def _grow(self) -> None:
        # (cell, tree, node) with the number of features it has tried in vain.
        open_ = [(cell, t, 0, 0) for cell, t in self.trees]
        some = self.choice.features or self.width
        while open_:
            now, open_ = open_[:OPEN_NODES], open_[OPEN_NODES:]
            best = self._cuts(now, some)
            for slot, (cell, t, node, skip) in enumerate(now):
                tree, found = self.trees[cell, t], best[slot]
                w, p, count = found["total"]
                tree.value[node] = p / w if w else 0.0
                if not splits(0 < p < w, count, tree.depth[node], self.choice):
                    tree.feature[node] = -1
                elif count <= self.local:
                    tree.feature[node] = -2
                elif found["cut"] is None:
                    tree.feature[node] = -1 if skip + some >= self.width else -3
                    if skip + some < self.width:
                        open_.append((cell, t, node, skip + some))
                else:
                    tree.feature[node], tree.cut[node] = found["feature"], found["cut"]
                    for at, path in enumerate(children(np.array([tree.path[node]], np.uint64))):
                        child = tree.add(path, tree.depth[node] + 1, -3, 0.0)
                        if at == 0:
                            tree.child[node] = child
                        open_.append((cell, t, child, 0))

    def _arrays(self) -> dict:
        return {at: tree.arrays() | {"root": tree.path[0]} for at, tree in self.trees.items()}

    def _cuts(self, now: list[tuple], some: int) -> dict[int, dict]:
        """For each node of `now`: its weight, sum and rows, and its best cut among the features it tries."""
        trees, cells, by, choice = self._arrays(), self.cells, self.by, self.choice
        path = np.array([self.trees[c, t].path[node] for c, t, node, _ in now], np.uint64)
        orders = tried(path, self.width, choice.features)
        skips = np.array([skip for *_, skip in now])
        slots = {}
        for slot, (cell, t, node, _) in enumerate(now):
            slots.setdefault((cell, t), {})[node] = slot

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for cell, bins, label, key, _ in _by_cell(batches, by, cells):
                for (c, t), places in slots.items():
                    if c != cell:
                        continue
                    tree = trees[c, t]
                    w = drawn(key, tree["root"]) if choice.bootstrap else np.ones(len(key))
                    slot_of = np.full(len(tree["feature"]), -1)
                    slot_of[list(places)] = list(places.values())
                    slot = slot_of[_route(tree, bins)]
                    on = np.flatnonzero((w > 0) & (slot >= 0))
                    for s in np.unique(slot[on]):
                        mine = on[slot[on] == s]
                        for j in range(skips[s], min(skips[s] + some, bins.shape[1])):
                            b = bins[mine, orders[s, j]]
                            add = np.stack([np.bincount(b, x, BINS) for x in (w[mine], w[mine] * label[mine])] + [np.bincount(b, minlength=BINS)])
                            held[s, j] = held[s, j] + add if (s, j) in held else add
            if held:
                places = list(held)
                yield pa.record_batch(
                    {
                        "slot": pa.array([int(s) for s, _ in places], pa.int32()),
                        "turn": pa.array([j for _, j in places], pa.int32()),
                        "sums": pa.array([held[at].astype(float).tobytes() for at in places], pa.binary()),
                    }
                )

        def merge(table: pa.Table) -> pa.Table:
            slot, turn = table.column("slot")[0].as_py(), table.column("turn")[0].as_py()
            w, p, n = sum(np.frombuffer(x, float) for x in table.column("sums").to_pylist()).reshape(3, BINS)
            there = np.flatnonzero(n)
            one = path[slot : slot + 1]
            at, purity, cut, _, _ = pick(there, w[there], p[there], w.sum(keepdims=True), p.sum(keepdims=True), one, orders[slot : slot + 1, turn], choice)
            some_cut = len(at) > 0
            return pa.table(
                {
                    "slot": pa.array([slot], pa.int32()),
                    "turn": pa.array([turn], pa.int32()),
                    "w": [w.sum()], "p": [p.sum()], "n": [int(n.sum())],
                    "purity": pa.array([float(purity[0]) if some_cut else None], pa.float64()),
                    "cut": pa.array([int(cut[0]) if some_cut else None], pa.int32()),
                }
            )

        train = self.rows.where(F.col("split") == "train").select(*by, "bins", "label", "key", "split")
        sums = train.mapInArrow(count, "slot int, turn int, sums binary")
        merged = sums.groupBy("slot", "turn").applyInArrow(merge, "slot int, turn int, w double, p double, n bigint, purity double, cut int")
        out: dict[int, dict] = {}
        for r in sorted(merged.collect(), key=lambda r: (r.slot, r.turn)):
            node = out.setdefault(r.slot, {"total": (r.w, r.p, r.n), "cut": None, "purity": -np.inf})
            # Of the features beyond those a node may try, the first that splits it counts.
            if r.cut is not None and r.purity > (np.inf if r.turn >= some and node["cut"] is not None else node["purity"]):
                node.update(cut=r.cut, purity=r.purity, feature=int(orders[r.slot, r.turn]))
        return out

    def values(self) -> DataFrame:
        """Values of the rows to predict: at leaves of the tops, and from tasks that finish one node each."""
        trees, cells, by, choice = self._arrays(), self.cells, self.by, self.choice
        kept = [*by, "split", *self.keys, "label", "key", "bins", "seed"]
        extra = [("part", T.LongType()), ("node", T.IntegerType()), ("drawn", T.DoubleType()), ("value", T.DoubleType())]
        schema = T.StructType([self.rows.schema[c] for c in kept] + [T.StructField(n, t) for n, t in extra])

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, bins, _, key, batch in _by_cell(batches, by, cells):
                trains = np.asarray(batch.column("split").to_numpy(zero_copy_only=False)) == "train"
                for (c, t), tree in trees.items():
                    if c != cell:
                        continue
                    node = _route(tree, bins)
                    w = np.where(trains, drawn(key, tree["root"]) if choice.bootstrap else 1.0, 0.0)
                    ends = tree["feature"][node] == -1
                    out = np.flatnonzero((w > 0) & ~ends | ~trains)
                    rows = batch.take(pa.array(out))
                    more = [
                        pa.array(np.full(len(out), t, np.int64)),
                        pa.array(node[out].astype(np.int32), mask=ends[out]),
                        pa.array(w[out]),
                        pa.array(tree["value"][node[out]], mask=~ends[out]),
                    ]
                    yield pa.RecordBatch.from_arrays([*(rows.column(x) for x in kept), *more], schema=pa.schema([*(rows.schema.field(x) for x in kept), *(pa.field(n, a.type) for (n, _), a in zip(extra, more))]))

        paths = {at: (np.array(tree.path, np.uint64), tree.depth) for at, tree in self.trees.items()}
        names = [*by, "split", *self.keys, "label"]

        def end(table: pa.Table) -> pa.Table:
            began = time.process_time()
            table = table.sort_by("key")
            cell = cells[tuple(table.column(c)[0].as_py() for c in by)]
            part, node = table.column("part")[0].as_py(), table.column("node")[0].as_py()
            bins, label, w = _unpacked(table.column("bins")), _numbers(table, "label", float), _numbers(table, "drawn", float)
            trains = _numbers(table, "split", object) == "train"
            train, ask = np.flatnonzero(trains), np.flatnonzero(~trains)
            path, depth = paths[cell, part]
            zeros = np.zeros(len(table), np.int64)
            value = finish(bins, label, train, zeros[: len(train)], w[train], ask, zeros[: len(ask)], path[node : node + 1], depth[node], choice)
            return _valued(table, ask, names, part, value, began)

        placed = stage(self.rows.select(*kept).mapInArrow(place, schema))
        done = placed.where(F.col("node").isNull()).select(*names, "part", "value", F.lit(0.0).alias("seconds"))
        rest = placed.where(F.col("node").isNotNull()).drop("value")
        return done.unionByName(rest.groupBy(*by, "part", "node").applyInArrow(end, _value_schema(self.rows, self.keys, by)))


def _by_cell(batches: Iterator[pa.RecordBatch], by: list[str], cells: dict[tuple, int]):
    """(cell, bins, label, key, rows) of the rows of one cell in each batch."""
    for batch in batches:
        found = [cells[row] for row in zip(*(batch.column(c).to_pylist() for c in by))]
        number = np.array(found, np.int64)
        for cell in np.unique(number):
            rows = batch.take(pa.array(np.flatnonzero(number == cell)))
            yield int(cell), _unpacked(rows.column("bins")), _numbers(rows, "label", float), _numbers(rows, "key", np.int64).view(np.uint64), rows
