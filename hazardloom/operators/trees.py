"""Decision trees on histograms: bins, splits, growth and walking, as array functions.

All sums are of integers (gradients and weights in fixed point), so a tree doesn't depend
on how rows are partitioned or ordered.  Plans that bring these functions to the rows are in
:mod:`hazardloom.plans.boosting`.

A feature is cut into ``CELLS`` cells of equal width between its least and greatest training
value, and the cells into at most ``BINS`` bins of about equally many rows.  A node sends a row
left if its cell is at most the node's.  Nodes are numbered by their path: the root is 1, the
children of p are 2p and 2p + 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import md5

import numpy as np

CELLS = 4096
BINS = 256
FIXED = 1 << 24
LEAST_GAIN = 1e-9
# Cells whose places are held at once while a histogram is summed.
HISTOGRAM_CELLS = 1 << 20
# Rows from which a histogram is summed a feature at a time.
COLUMN_ROWS = 2048
# A forest's nodes that are split at a time, and their rows unless one node has more.
NODES_AT_ONCE = 256
ROWS_AT_ONCE = 1 << 16
# Rows that walk down all trees at a time.
WALK_ROWS = 1024
# A prime below 2**31 for the arithmetic hashes.
PRIME = 2**31 - 1
# Poisson(1) probabilities of at most 0, 1, ... draws.
DRAWS = np.cumsum([0.36787944117144233, 0.36787944117144233, 0.18393972058572117, 0.061313240195240384,
                   0.015328310048810096, 0.0030656620097620191, 0.00051094366829366987])


@dataclass(frozen=True)
class TreeSpec:
    """Settings of a boosted model (one tree per round and class) or a forest (one tree per round)."""

    kind: str  # "boosted" or "forest"
    rounds: int
    rate: float = 0.1
    max_depth: int = 60
    max_leaves: int | None = None  # set: growth by best leaf first
    min_rows: int = 1
    min_split_rows: int = 2
    min_hessian: float = 0.0
    l2: float = 0.0
    balanced: bool = False
    seed: int = 42


# --- bins ---------------------------------------------------------------------------------
def cells(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Cell of every value; values outside the range and missing ones go to the nearest and the first cell."""
    width = high - low
    with np.errstate(invalid="ignore"):
        at = np.floor((x - low) * float(CELLS) / np.where(width > 0, width, 1.0))
    return np.clip(np.nan_to_num(at, nan=0.0), 0, CELLS - 1).astype(np.uint16)


def bins_of_cells(counts: np.ndarray) -> np.ndarray:
    """Bin of every cell from the row counts (features x cells)."""
    before = np.cumsum(counts, axis=1) - counts
    return (before * BINS // max(1, int(counts[0].sum()))).astype(np.uint8)


def last_cell(bins: np.ndarray, feature: int, at: int) -> int:
    """The last cell whose bin is at most ``at``."""
    return int(np.searchsorted(bins[feature], at, side="right")) - 1


# --- splits -------------------------------------------------------------------------------
@dataclass
class Split:
    """The best cut of a node: rows with a bin up to ``bin`` go left; sums before, and left of, the cut."""

    gain: float
    feature: int
    bin: int
    total: list[int]
    left: list[int]
    worth: float = field(default=0.0, compare=False)  # of both sides, to choose between cuts

    @property
    def right(self) -> list[int]:
        return [t - x for t, x in zip(self.total, self.left, strict=True)]


def histogram(bins: np.ndarray, measures: np.ndarray) -> np.ndarray:
    """Sums (measure, feature, bin) of integer measures (row, measure), a feature or a slice of the rows at a time."""
    d = bins.shape[1]
    total = np.zeros((measures.shape[1], d, BINS), np.int64)
    if len(bins) >= COLUMN_ROWS:
        weights = [None if (m == 1).all() else m.astype(np.float64) for m in measures.T]
        for f in range(d):
            column = bins[:, f].astype(np.intp)
            for i, m in enumerate(weights):
                total[i, f] = np.bincount(column, m, BINS)
        return total
    step = max(1, HISTOGRAM_CELLS // max(1, d))
    for first in range(0, len(bins), step):
        at = (bins[first : first + step].astype(np.int64) + np.arange(d) * BINS).ravel()
        # Sums of integers below 2**53 are exact in float64.
        sums = [np.bincount(at, np.repeat(m.astype(np.float64), d), d * BINS) for m in measures[first : first + step].T]
        total += np.array(sums).reshape(total.shape).astype(np.int64)
    return total


def _worth(spec: TreeSpec, sums):
    """What a node is worth, times ``FIXED``: G**2 / (H + l2), or the sum of squared class weights over the weight."""
    if spec.kind == "boosted":
        return sums[0] * sums[0] / (sums[1] + spec.l2 * FIXED)
    squares, weight = sums[0] * sums[0], sums[0]
    for c in sums[1:-1]:
        squares, weight = squares + c * c, weight + c
    return squares / weight


def _worths(spec: TreeSpec, sums: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return _worth(spec, sums)


def _best(spec: TreeSpec, left: np.ndarray, total: np.ndarray, allowed: np.ndarray | None) -> tuple[float, tuple, float]:
    """Gain, place and worth of the best cut, from the sums left of each (measure, feature, cut) as whole doubles.

    The best cut leaves the two sides worth most; the first of equals.  A gain of 0 means none.
    """
    whole = total.astype(np.float64)
    right = whole[:, None, None] - left
    least_rows = max(1, spec.min_rows)
    ok = (left[-1] >= least_rows) & (right[-1] >= least_rows)
    if allowed is not None:
        ok &= allowed
    if spec.kind == "boosted" and spec.min_hessian:
        least = round(spec.min_hessian * FIXED)
        ok &= (left[1] >= least) & (right[1] >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        worth = np.where(ok, _worth(spec, left) + _worth(spec, right), -1.0)
        own = _worth(spec, whole)
    at = np.unravel_index(int(worth.argmax()), worth.shape)
    gain = (float(worth[at]) - float(own)) / FIXED
    return (gain if ok[at] and gain > LEAST_GAIN else 0.0), at, float(worth[at])


def hopeless(spec: TreeSpec, total: list[int]) -> bool:
    """Whether a node with these sums can't be split, whatever its rows."""
    if total[-1] < max(2 * spec.min_rows, spec.min_split_rows, 2):
        return True
    return spec.kind == "boosted" and total[1] < 2 * round(spec.min_hessian * FIXED)


def best_split(spec: TreeSpec, hist: np.ndarray, features: np.ndarray) -> Split:
    """The best cut of a histogram; of equal gains the first feature, then bin.  A gain of 0 means none."""
    total, left = hist[:, 0, :].sum(axis=1), np.cumsum(hist.astype(np.float64), axis=2)  # below 2**53
    gain, (f, b), worth = _best(spec, left, total, None)
    return Split(gain, int(features[f]), int(b), total.tolist(), left[:, f, b].astype(np.int64).tolist(), worth)


def sorted_split(spec: TreeSpec, ranked: np.ndarray, ordered: np.ndarray, total: np.ndarray, features: np.ndarray) -> Split:
    """As :func:`best_split`, from the rows themselves; for nodes with fewer rows than bins.

    ``ranked`` has each feature's bins rising (feature, place), ``ordered`` the measures but the row
    count in the same order (measure, feature, place).
    """
    left = np.empty((len(ordered) + 1, *ranked.shape))
    np.cumsum(ordered, axis=2, out=left[:-1])  # integers below 2**53
    left[-1] = np.arange(1, ranked.shape[1] + 1)
    ends = np.ones(ranked.shape, bool)
    ends[:, :-1] = ranked[:, 1:] != ranked[:, :-1]
    gain, (f, at), worth = _best(spec, left, total, ends)
    return Split(gain, int(features[f]), int(ranked[f, at]), total.tolist(), left[:, f, at].astype(np.int64).tolist(), worth)




# --- growth -------------------------------------------------------------------------------
@dataclass
class Growing:
    """A tree that grows as the splits of its leaves become known.

    Without ``max_leaves`` every leaf with a gain is split, level by level.  With it the leaf with the
    greatest gain is split first; ``ahead`` leaves more may be looked at early, so that one
    pass over the rows serves several steps.
    """

    spec: TreeSpec
    ahead: int = 0
    known: dict[int, Split] = field(default_factory=dict)
    leaves: set[int] = field(default_factory=lambda: {1})
    opened: set[int] = field(default_factory=set)  # nodes whose rows went on to their children
    selected: set[int] = field(default_factory=set)

    def _gain(self, node: int) -> float:
        return self.known[node].gain if node in self.known else 0.0

    def _final(self, node: int) -> bool:
        return node > 1 and (node.bit_length() > self.spec.max_depth or hopeless(self.spec, self.totals(node)))

    def _open(self, node: int) -> list[int]:
        self.opened.add(node)
        return [2 * node, 2 * node + 1]

    def wanted(self) -> list[int]:
        """Nodes whose splits are needed to go on; none when the tree is grown."""
        while True:
            unknown = [n for n in self.leaves if n not in self.known and not self._final(n)]
            gains = sorted(((-self._gain(n), n) for n in self.leaves if self._gain(n) > 0))
            if self.spec.max_leaves is None:
                if unknown:
                    return sorted(unknown)
                if not gains:
                    return []
                chosen = [n for _, n in gains]
            else:
                room = self.spec.max_leaves - len(self.leaves)
                if room <= 0:
                    return []
                if unknown:
                    early = [c for _, n in gains[: min(self.ahead, room)] for c in self._open(n)]
                    return sorted({*unknown, *(c for c in early if c not in self.known and not self._final(c))})
                if not gains:
                    return []
                chosen = [gains[0][1]]
            for n in chosen:
                self.leaves.remove(n)
                self.selected.add(n)
                self.leaves.update(self._open(n))

    def accept(self, splits: dict[int, Split]) -> None:
        self.known.update(splits)

    def totals(self, node: int) -> list[int]:
        if node in self.known:
            return self.known[node].total
        parent = self.known[node // 2]
        return parent.right if node % 2 else parent.left

    def rows(self, bins: np.ndarray) -> list[dict]:
        """The grown tree as node rows."""
        out = []
        for node in sorted(self.selected | self.leaves):
            split, total = (self.known[node] if node in self.selected else None), self.totals(node)
            row = {"node": node, "n": total[-1], "feature": None, "bin": None, "cell": None, "left": None, "right": None}
            if split is None:
                row |= {"gain": None, "value": leaf_value(self.spec, total)}
            else:
                row |= {"feature": split.feature, "bin": split.bin, "cell": last_cell(bins, split.feature, split.bin)}
                row |= {"left": 2 * node, "right": 2 * node + 1, "gain": split.gain, "value": None}
            out.append(row)
        return out


def leaf_value(spec: TreeSpec, total: list[int]) -> list[float]:
    """The step of a boosted leaf, or the class shares of a forest's."""
    if spec.kind == "boosted":
        g, h = total[0] / FIXED, total[1] / FIXED
        return [-g / max(h + spec.l2, 1e-16) * spec.rate]
    weights = [t / FIXED for t in total[:-1]]
    whole = sum(weights)
    return [w / whole if whole else 0.0 for w in weights]


def moved(nodes: np.ndarray, bins: np.ndarray, tree: Growing) -> np.ndarray:
    """Node of every row after it went on through the opened nodes."""
    if not tree.opened:
        return nodes
    opened = np.array(sorted(tree.opened), np.int64)
    feature, last = (np.array([getattr(tree.known[n], of) for n in opened.tolist()], np.int64) for of in ("feature", "bin"))
    nodes, here = nodes.copy(), np.arange(len(nodes))
    while len(here):
        place = np.minimum(np.searchsorted(opened, nodes[here]), len(opened) - 1)
        found = opened[place] == nodes[here]
        here, place = here[found], place[found]
        nodes[here] = 2 * nodes[here] + (bins[here, feature[place]] > last[place])
    return nodes


def two_valued(columns: np.ndarray) -> np.ndarray:
    """Which features (feature, row) have at most two bins."""
    return np.array([bool(((c == c.min()) | (c == c.max())).all()) for c in columns]) if columns.size else np.ones(len(columns), bool)


@dataclass
class Columns:
    """Bins by feature: a bit a row, set for the lower bin, of features with at most two bins, and a byte of the others."""

    two: np.ndarray  # which features have at most two bins
    low: np.ndarray  # each feature's lowest bin
    bits: np.ndarray  # (feature with two bins, byte of eight rows)
    rest: np.ndarray  # (other feature, row)

    @staticmethod
    def pack(columns: np.ndarray, two: np.ndarray | None = None, low: np.ndarray | None = None) -> Columns:
        """From the bins (feature, row)."""
        two = two_valued(columns) if two is None else two
        low = columns.min(axis=1, initial=BINS - 1).astype(np.uint8) if low is None else low
        return Columns(two, low, np.packbits(columns[two] == low[two, None], axis=1, bitorder="little"), columns[~two])

    @property
    def place(self) -> np.ndarray:
        """Each feature's row in ``bits`` or ``rest``."""
        return np.where(self.two, np.cumsum(self.two), np.cumsum(~self.two)) - 1

    def __len__(self) -> int:
        return len(self.two)


# The bit of a row in its byte.
_ROW_BIT = (1 << np.arange(8)).astype(np.uint8)


class LocalTree:
    """Growth over rows in memory.

    Nodes with more rows than bins use histograms, a larger child's by subtraction; below, each feature's
    rows are sorted once and handed down in order.  A forest's columns are packed.
    """

    def __init__(self, spec: TreeSpec, columns: np.ndarray | Columns, measures: np.ndarray, tree: int = 0):
        """``columns`` are the bins by feature (feature, row), for a forest perhaps packed already."""
        self.spec, self.columns, self.number = spec, columns, tree
        if spec.kind == "forest":
            self.columns = columns if isinstance(columns, Columns) else Columns.pack(columns)
            self.place = self.columns.place
        else:
            self.measures = measures
        self.floats = measures[:, :-1].T.astype(np.float64)
        drawn = np.flatnonzero(measures[:, -1])
        self.index = {1: drawn.astype(np.int32) if len(measures) < 2**31 else drawn}
        self.histograms, self.orders, self.tree = {}, {}, Growing(spec)
        while wanted := self.tree.wanted():
            self.tree.accept(self._forest_splits(wanted) if spec.kind == "forest" else {n: self._split(n) for n in wanted})

    def rows(self, node: int) -> np.ndarray:
        if node not in self.index:
            at, split = self.rows(node // 2), self.tree.known[node // 2]
            right = self._right(split, at)
            self.index[node // 2 * 2], self.index[node // 2 * 2 + 1] = at[~right], at[right]
        return self.index[node]

    def _right(self, split: Split, at: np.ndarray) -> np.ndarray:
        """Which rows a cut sends to the right."""
        if self.spec.kind != "forest":
            return self.columns[split.feature, at] > split.bin
        place = self.place[split.feature]
        if self.columns.two[split.feature]:
            return self.columns.bits[place].take(at >> 3) & _ROW_BIT.take(at & 7) == 0
        return self.columns.rest[place].take(at) > split.bin

    def _histogram(self, node: int) -> np.ndarray:
        if node not in self.histograms:
            own, other = self.rows(node), self.rows(node ^ 1) if node > 1 else ()
            if node > 1 and node // 2 in self.histograms and len(other) < len(own):
                # The larger child is the parent without the smaller one.
                self.histograms[node] = self.histograms[node // 2] - self._histogram(node ^ 1)
            else:
                whole = len(own) == self.columns.shape[1]
                columns, measures = (self.columns, self.measures) if whole else (self.columns[:, own], self.measures[own])
                self.histograms[node] = histogram(columns.T, measures)
        return self.histograms[node]

    def _order(self, node: int) -> np.ndarray:
        """Rows of a node by rising bin, for every feature."""
        if node not in self.orders:
            above = self.orders.get(node // 2)
            if above is None:
                at = self.rows(node)
                self.orders[node] = at[np.argsort(self.columns[:, at], axis=1, kind="stable")]
            else:
                split = self.tree.known[node // 2]
                mine = (self.columns[split.feature] > split.bin)[above] == bool(node & 1)
                self.orders[node] = above[mine].reshape(len(above), -1)
        return self.orders[node]

    def _split(self, node: int) -> Split:
        at, chosen = self.rows(node), np.arange(len(self.columns))
        if len(at) > BINS:
            return best_split(self.spec, self._histogram(node), chosen)
        order = self._order(node)
        ranked = self.columns[chosen[:, None], order]
        return sorted_split(self.spec, ranked, self.floats[:, order], self.measures[at].sum(axis=0), chosen)

    def _forest_splits(self, nodes: list[int]) -> dict[int, Split]:
        """The splits of a forest's nodes, many nodes at a time."""
        out, some, rows = {}, [], 0
        for node in nodes:
            some.append(node)
            rows += len(self.rows(node))
            if len(some) == NODES_AT_ONCE or rows > ROWS_AT_ONCE:
                out |= dict(zip(some, self._splits_of(some), strict=True))
                some, rows = [], 0
        return out | dict(zip(some, self._splits_of(some), strict=True)) if some else out

    def _splits_of(self, nodes: list[int]) -> list[Split]:
        """As :func:`best_split` per node: the best of its two-valued features, of the others, and the first of equals."""
        lists, low = [self.rows(n) for n in nodes], self.columns.low
        if any(not len(at) for at in lists):  # a tree that drew no row
            return [Split(0.0, 0, 0, [0] * (len(self.floats) + 1), [0] * (len(self.floats) + 1)) for _ in nodes]
        at, lengths = np.concatenate(lists), np.array([len(x) for x in lists])
        starts = np.cumsum(lengths) - lengths
        chosen = nodes_features(self.spec.seed, self.number, nodes, len(self.columns))
        measures = np.vstack([self.floats[:, at], np.ones(len(at))])
        total = np.add.reduceat(measures, starts, axis=1)  # this and all below: integers below 2**53
        own, flags = _worths(self.spec, total), self.columns.two[chosen]
        # Two-valued features: the rows in the lower bin are left of the only cut.
        left, node = np.zeros((len(measures), *chosen.shape)), np.repeat(np.arange(len(nodes)), lengths)
        bits, byte, bit = self.columns.bits.ravel(), at >> 3, _ROW_BIT.take(at & 7)
        first = np.where(flags, self.place[chosen], 0) * self.columns.bits.shape[1]
        for j in range(chosen.shape[1]):
            if flags[:, j].any():
                lower = bits.take(byte + np.repeat(first[:, j], lengths)) & bit != 0
                some = np.flatnonzero(lower)
                many = 2 * len(some) > len(lower)
                if many:  # the fewer are summed
                    some = np.flatnonzero(~lower)
                of = node.take(some)
                sums = [np.bincount(of, m.take(some), len(nodes)) for m in measures[:-1]] + [np.bincount(of, minlength=len(nodes))]
                left[:, :, j] = total - sums if many else sums
        worth = np.where(flags, self._cut_worths(left, total[:, :, None]), -1.0)
        j, each = worth.argmax(axis=1), np.arange(len(nodes))
        feature, bin_, best, left = chosen[each, j], low[chosen[each, j]].astype(np.int64), worth[each, j], left[:, each, j]
        for of, f, b, w, sums in self._other_cuts(at, starts, lengths, chosen, flags, measures, total):
            better = (w > best[of]) | ((w == best[of]) & (f < feature[of]))
            of = of[better]
            feature[of], bin_[of], best[of], left[:, of] = f[better], b[better], w[better], sums[:, better]
        gain = np.where(best >= 0, (best - own) / FIXED, 0.0)
        gain[~(gain > LEAST_GAIN)] = 0.0
        totals, lefts = total.T.astype(np.int64).tolist(), left.T.astype(np.int64).tolist()
        return [Split(*row) for row in zip(gain.tolist(), feature.tolist(), bin_.tolist(), totals, lefts, best.tolist(), strict=True)]

    def _cut_worths(self, left: np.ndarray, total: np.ndarray) -> np.ndarray:
        """What both sides of cuts are worth, -1 where a side has too few rows."""
        right, least = total - left, max(1, self.spec.min_rows)
        return np.where((left[-1] >= least) & (right[-1] >= least), _worths(self.spec, left) + _worths(self.spec, right), -1.0)

    def _other_cuts(self, at, starts, lengths, chosen, flags, measures, total):
        """(place of the node, feature, bin, worth, sums left) of the best cuts of features with more bins.

        Nodes with more rows than bins use histograms; the others' rows are sorted together, by node, feature and bin.
        """
        for i in np.flatnonzero(~flags.all(axis=1) & (lengths > BINS)):
            some, here = chosen[i, ~flags[i]], slice(starts[i], starts[i] + lengths[i])
            hist = histogram(self.columns.rest[self.place[some][:, None], at[here]].T, measures[:, here].T)
            s = best_split(self.spec, hist, some)
            yield np.array([i]), np.array([s.feature]), np.array([s.bin]), np.array([s.worth]), np.array(s.left, np.float64)[:, None]
        pairs = np.argwhere(~flags & (lengths <= BINS)[:, None])
        if not len(pairs):
            return
        node, feature = pairs[:, 0], chosen[pairs[:, 0], pairs[:, 1]]
        many = lengths[node]
        first = np.cumsum(many) - many
        pair = np.repeat(np.arange(len(pairs)), many)
        places = np.arange(len(pair)) - first[pair] + starts[node][pair]
        key = pair * BINS + self.columns.rest[self.place[feature][pair], at[places]]
        order = np.argsort(key)
        key, sums = key[order], np.cumsum(measures[:, places[order]], axis=1)
        ends = np.flatnonzero(key[1:] != key[:-1])
        ends = ends[pair[ends] == pair[ends + 1]]  # the last bin of a node's feature leaves nothing right of it
        if not len(ends):
            return
        before = np.where(first > 0, sums[:, first - 1], 0.0)
        left, of = sums[:, ends] - before[:, pair[ends]], node[pair[ends]]
        worth = self._cut_worths(left, total[:, of])
        here, where = np.unique(of, return_index=True)
        top = np.repeat(np.maximum.reduceat(worth, where), np.diff([*where, len(of)]))
        equal = np.flatnonzero(worth == top)
        here, where = np.unique(of[equal], return_index=True)
        e = equal[where]
        yield here, feature[pair[ends[e]]], key[ends[e]] % BINS, worth[e], left[:, e]


# --- reproducible draws -------------------------------------------------------------------
def draw_pair(text: str) -> tuple[int, int]:
    """Two numbers below ``PRIME`` from a text, the same in every engine; the first is not 0."""
    digest = md5(text.encode()).hexdigest()
    return int(digest[:8], 16) % (PRIME - 1) + 1, int(digest[8:16], 16) % PRIME


def row_numbers(keys: list[str], seed: int) -> np.ndarray:
    """A number below ``PRIME`` per row key."""
    return np.array([int(md5(f"{seed}:row:{k}".encode()).hexdigest()[:8], 16) % PRIME for k in keys], np.int64)


def draws(numbers: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree of the forest: Poisson(1)."""
    a, b = draw_pair(f"{seed}:tree:{tree}")
    u = ((a * numbers + b) % PRIME) / PRIME
    return np.searchsorted(DRAWS, u, side="right").astype(np.int64)


def nodes_features(seed: int, tree: int, nodes: list[int], size: int) -> np.ndarray:
    """The square root of all features, chosen anew for every node of a forest, a row per node, ascending."""
    a, b = np.array([draw_pair(f"{seed}:tree:{tree}:node:{node}") for node in nodes], np.int64).T[:, :, None]
    wanted = max(1, int(size**0.5))
    drawn = (a * (np.arange(size, dtype=np.int64) + 1) + b) % PRIME  # all different: a is no multiple of the prime
    return np.sort(np.argpartition(drawn, wanted - 1, axis=1)[:, :wanted], axis=1)


def node_features(seed: int, tree: int, node: int, size: int) -> np.ndarray:
    return nodes_features(seed, tree, [node], size)[0]


# --- gradients and walking ----------------------------------------------------------------
def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-point first and second derivatives of the weighted softmax loss per row and class."""
    p = softmax(margins)
    g = (p - (y[:, None] == np.arange(p.shape[1]))) * weight[:, None]
    h = 2.0 * p * (1.0 - p) * weight[:, None]
    return np.rint(g * FIXED).astype(np.int64), np.rint(h * FIXED).astype(np.int64)


@dataclass
class Forest:
    """Node rows of many trees as flat arrays, for walking; ``of`` names the column each tree adds to."""

    roots: np.ndarray
    of: np.ndarray
    feature: np.ndarray
    cell: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    n: np.ndarray

    @staticmethod
    def from_rows(rows: list[dict], cut: str = "cell") -> Forest:
        """From node rows (round, cls, node, n, feature, bin, cell, left, right, value), to walk on cells or on bins."""
        rows = sorted(rows, key=lambda r: (r["round"], r["cls"], r["node"]))
        at = {(r["round"], r["cls"], r["node"]): i for i, r in enumerate(rows)}

        def go(r, side):
            return at[r["round"], r["cls"], r[side]] if r["feature"] is not None else at[r["round"], r["cls"], r["node"]]

        width = max((len(r["value"]) for r in rows if r["value"] is not None), default=1)
        return Forest(
            np.array([i for i, r in enumerate(rows) if r["node"] == 1], np.int64),
            np.array([r["cls"] for r in rows if r["node"] == 1], np.int64),
            np.array([r["feature"] if r["feature"] is not None else 0 for r in rows], np.int64),
            np.array([r[cut] if r[cut] is not None else CELLS for r in rows], np.int64),
            np.array([go(r, "left") for r in rows], np.int64),
            np.array([go(r, "right") for r in rows], np.int64),
            np.array([r["value"] if r["value"] is not None else [0.0] * width for r in rows], np.float64).reshape(-1, width),
            np.array([r["n"] for r in rows], np.float64),
        )

    @staticmethod
    def from_columns(columns: dict[str, np.ndarray], value: np.ndarray) -> Forest:
        """As :meth:`from_rows` to walk on cells, from whole columns (a feature of -1 for a leaf); children as 32-bit places."""
        order = np.lexsort((columns["node"], columns["cls"], columns["round"]))
        c, value = {name: of[order] for name, of in columns.items()}, value[order]
        roots = np.flatnonzero(c["node"] == 1)
        here = np.arange(len(order), dtype=np.int32)
        left, right = here.copy(), here.copy()
        for first, end in zip(roots, [*roots[1:], len(order)], strict=True):
            inner = first + np.flatnonzero(c["feature"][first:end] >= 0)
            for to, side in ((left, "left"), (right, "right")):
                to[inner] = first + np.searchsorted(c["node"][first:end], c[side][inner])
        leaf = c["feature"] < 0
        feature, cell = np.where(leaf, 0, c["feature"]).astype(np.int32), np.where(leaf, CELLS, c["cell"]).astype(np.int32)
        return Forest(roots, c["cls"][roots].astype(np.int64), feature, cell, left, right, value, c["n"].astype(np.float64))

    def means(self) -> np.ndarray:
        """Mean value below every node, by training rows."""
        out = self.value.copy()
        for i in range(len(out) - 1, -1, -1):  # children come after their parent
            a, b = self.left[i], self.right[i]
            if a != i:
                out[i] = (out[a] * self.n[a] + out[b] * self.n[b]) / max(self.n[a] + self.n[b], 1.0)
        return out

    def contributions(self, x: np.ndarray, k: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, class, feature) contributions and the base of each class: every step down a tree gives the change
        of the mean to the feature that decided it, so base and contributions add up to the prediction."""
        mean, width = self.means(), self.value.shape[1]
        trees = len(self.roots)
        out, base = np.zeros((len(x), k, d)), np.zeros(k)
        if not trees:
            return out, base
        if width == 1:
            np.add.at(base, self.of, mean[self.roots, 0])
        else:
            base = mean[self.roots].mean(axis=0)
        at, rows = np.repeat(self.roots[None, :], len(x), axis=0), np.arange(len(x))[:, None]
        while True:
            chosen = self.feature[at]
            down = np.where(x[rows, chosen] <= self.cell[at], self.left[at], self.right[at])
            if np.array_equal(down, at):
                return out, base
            change = mean[down] - mean[at]
            if width == 1:
                np.add.at(out, (np.broadcast_to(rows, at.shape), np.broadcast_to(self.of, at.shape), chosen), change[:, :, 0])
            else:
                for c in range(width):
                    np.add.at(out, (np.broadcast_to(rows, at.shape), c, chosen), change[:, :, c] / trees)
            at = down

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf (row, tree) of every row of cells."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        flat, first = np.ascontiguousarray(x).ravel(), np.arange(len(x))[:, None] * x.shape[1]
        while True:
            # A right child follows its left one; a leaf is its own child, and no cell is beyond its cut.
            down = self.left.take(at) + (flat.take(first + self.feature.take(at)) > self.cell.take(at))
            if np.array_equal(down, at):
                return at
            at = down

    def margins(self, x: np.ndarray, k: int) -> np.ndarray:
        """Sums of the boosted leaf values per class, in round order."""
        out = np.zeros((len(x), k))
        for first in range(0, len(x) if len(self.roots) else 0, WALK_ROWS):
            steps = self.value[self.leaves(x[first : first + WALK_ROWS]), 0]
            for c in range(k):
                out[first : first + WALK_ROWS, c] = steps[:, self.of == c].cumsum(axis=1)[:, -1] if (self.of == c).any() else 0.0
        return out

    def add(self, x: np.ndarray, total: np.ndarray) -> None:
        """Add every tree's step, or class shares, to the totals of the rows, in tree order."""
        at = self.leaves(x)
        for tree, c in enumerate(self.of.tolist()):
            if self.value.shape[1] == 1:
                total[:, c] += self.value[at[:, tree], 0]
            else:
                total += self.value[at[:, tree]]

    def shares(self, x: np.ndarray, k: int) -> np.ndarray:
        """Mean class shares of a forest's leaves."""
        if not len(self.roots):
            return np.full((len(x), k), 1.0 / k)
        return self.value[self.leaves(x)].mean(axis=1) if len(x) else np.zeros((0, k))
