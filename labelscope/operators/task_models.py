"""Many fits as tasks: learners in numpy, one fold a row of a task table.

Leave-one-out evaluation with inner selection makes thousands of fits on a few hundred
rows. As Spark jobs their cost is the launch; here each task fits the candidates of one family
on the training rows of one fold, from a broadcast table (labelled rows, numbers only, in
pieces of bounded size), and the cluster runs as many at once as it has cores. The learners
are the same for tables of every size; trees that are grown one at a time, since there are many
rows, take their sums from a table of all pairs of values where there are few (``Grid``).

Logistic regression is fitted by Newton steps with an L2 penalty, forests of Gini trees on
bootstrap rows with a square root of the features at each node, boosted trees by second
order with row and column sampling. All are deterministic for a seed.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.functions.seeds import child_seed
from labelscope.operators import models
from labelscope.operators.splits import inner_split

#: Cells (rows times features) of one piece of the broadcast training table: 64 MB of doubles.
BROADCAST_CELLS = 8_000_000
LAMBDA = 1.0


def balanced_weights(y: np.ndarray, on: bool) -> np.ndarray:
    n1 = y.sum()
    return np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1))) if on else np.ones(len(y))


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float, weight: np.ndarray) -> np.ndarray:
    """Coefficients, the intercept last and penalised like the others: half the squared norm plus c times the loss."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])

    def objective(v: np.ndarray) -> float:
        z = a @ v
        return 0.5 * float(v @ v) + c * float((weight * (np.logaddexp(0, z) - y * z)).sum())

    now = objective(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        gradient = w + c * (a.T @ (weight * (p - y)))
        hessian = np.eye(len(w)) + c * (a.T * (weight * p * (1 - p))) @ a
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while size > 1e-6 and (ahead := objective(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - ahead < 1e-10 * max(1.0, abs(now)):
            break
        w, now = w - size * step, ahead
    return w


@dataclass
class Tree:
    """A binary tree in arrays; a feature of -1 marks a leaf."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def node(self, value: float) -> int:
        for held, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            held.append(v)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, left, right = (np.array(v) for v in (self.feature, self.cut, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= cut[node], left[node], right[node])
        return np.array(self.value)[at]


@dataclass
class Trees:
    """Trees in one set of arrays, each tree's root at its number. Children stand side by side; a leaf is its own child, with a cut that nothing exceeds."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # the left one
    value: np.ndarray
    owner: np.ndarray  # the tree of each node
    levels: int
    count: int

    @classmethod
    def of(cls, parts: list[Trees]) -> Trees:
        """The trees of all parts, part after part."""
        if not parts:
            return cls(*(np.zeros(0, kind) for kind in (int, float, int, float, int)), 0, 0)
        counts = [p.count for p in parts]
        firsts = np.cumsum([0, *counts])
        rest = firsts[-1] + np.cumsum([0, *[len(p.value) - p.count for p in parts]])
        new = [np.concatenate([np.arange(p.count) + a, np.arange(len(p.value) - p.count) + b]) for p, a, b in zip(parts, firsts, rest, strict=False)]  # the roots of all parts come first
        to = np.concatenate(new)
        out = [np.empty(len(to), v.dtype) for v in (parts[0].feature, parts[0].cut, parts[0].child, parts[0].value, parts[0].owner)]
        for held, values in zip(out, zip(*[(p.feature, p.cut, n[p.child], p.value, p.owner + a) for p, n, a in zip(parts, new, firsts, strict=False)], strict=True), strict=True):
            held[to] = np.concatenate(values)
        return cls(*out, max(p.levels for p in parts), int(firsts[-1]))

    def dealt(self, k: int) -> list[Trees]:
        """Every ``k``-th tree, from each of the first ``k``."""
        out = []
        for i in range(k):
            mine = np.flatnonzero(self.owner % k == i)
            number = np.zeros(len(self.owner), np.int64)
            number[mine] = np.arange(len(mine))
            out.append(Trees(self.feature[mine], self.cut[mine], number[self.child[mine]], self.value[mine], self.owner[mine] // k, self.levels, self.count // k))
        return out

    def totals(self, x: np.ndarray) -> np.ndarray:
        """The sum of all trees' values for each row, added tree after tree."""
        n, total, values = len(x), np.zeros(len(x)), np.ascontiguousarray(x.T).ravel()
        some = max(1, TOGETHER // max(n, 1))
        column = self.feature * n
        for first in range(0, self.count, some):
            trees = min(some, self.count - first)
            at = np.repeat(np.arange(first, first + trees), n)
            row = np.tile(np.arange(n), trees)
            for _ in range(self.levels):
                at = self.child.take(at) + (values.take(column.take(at) + row) > self.cut.take(at))
            for v in self.value.take(at).reshape(trees, n):
                total += v
        return total

    def __iter__(self) -> Iterator[Tree]:
        own = np.argsort(self.owner, kind="stable")
        ends = np.cumsum(np.bincount(self.owner, minlength=self.count))
        number = np.empty(len(own), np.int64)  # a node's place in its tree
        number[own] = np.arange(len(own)) - np.repeat(np.append(0, ends[:-1]), np.diff(np.append(0, ends)))
        inner = self.child != np.arange(len(own))
        left = np.where(inner, number[self.child], -1)
        right = np.where(inner, number[self.child + inner], -1)
        held = np.where(inner, self.feature, -1), np.where(inner, self.cut, 0.0), left, right, self.value
        for mine in np.split(own, ends[:-1]):
            yield Tree(*(v[mine].tolist() for v in held))


def grow(x: np.ndarray, order: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, leaf_rows: int, reg: float, columns, value, gain_floor: float = 1e-12) -> Tree:
    """A tree that maximises sum(g)^2 / (sum(h) + reg) over its leaves.

    ``order`` has each feature's rows in order of value, for the rows the tree is grown on.
    With g the weighted labels centred on their node and h the weights this is the Gini
    criterion; with gradients and curvatures it is second-order boosting. ``columns`` gives the
    features to try at a node, ``value`` the value of a leaf.
    """
    tree = Tree()
    member = np.zeros(len(x), bool)

    def build(rows: np.ndarray, sorted_rows: np.ndarray, level: int) -> int:
        at = tree.node(value(rows))
        if level == depth or len(rows) < 2 * leaf_rows:
            return at
        tried = columns()
        s = sorted_rows[tried]
        gs, hs = np.cumsum(g[s], axis=1), np.cumsum(h[s], axis=1)
        gt, ht = gs[:, -1:], hs[:, -1:]
        v = np.take_along_axis(x.T[tried], s, axis=1)
        score = gs**2 / (hs + reg + 1e-300) + (gt - gs) ** 2 / (ht - hs + reg + 1e-300)
        ok = np.zeros(score.shape, bool)
        ok[:, leaf_rows - 1 : len(rows) - leaf_rows] = True
        ok[:, :-1] &= v[:, 1:] > v[:, :-1]
        ok[:, -1] = False
        score = np.where(ok, score, -np.inf)
        best = int(score.argmax())
        k, i = divmod(best, score.shape[1])
        if not score[k, i] - float(gt[k, 0] ** 2 / (ht[k, 0] + reg + 1e-300)) > gain_floor:
            return at
        member[s[k, : i + 1]] = True
        inside = member[sorted_rows]
        low = sorted_rows[inside].reshape(len(sorted_rows), -1)
        high = sorted_rows[~inside].reshape(len(sorted_rows), -1)
        member[s[k, : i + 1]] = False
        tree.feature[at], tree.cut[at] = int(tried[k]), float((v[k, i] + v[k, i + 1]) / 2)
        tree.left[at] = build(low[0], low, level + 1)
        tree.right[at] = build(high[0], high, level + 1)
        return at

    build(order[0], order, 0)
    return tree


def _orders(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return rows[np.argsort(x[rows], axis=0, kind="stable").T]


#: Rows of all trees that are grown together, which bounds the memory of a level.
TOGETHER = 50_000


def ranks(x: np.ndarray) -> np.ndarray:
    """The rank of every value among its column's distinct ones."""
    return np.column_stack([np.unique(c, return_inverse=True)[1] for c in x.T])


@dataclass
class Cells:
    """Rows that no split can part, since all their features are equal: what a tree is grown on."""

    first: np.ndarray  # a row of each cell
    cell: np.ndarray  # of each row
    rank: np.ndarray  # of each feature, the cells' ranks

    @classmethod
    def of(cls, rank: np.ndarray) -> Cells:
        code = rank[:, 0]
        for c in rank.T[1:]:
            code = np.unique(code * (np.int64(c.max()) + 1) + c, return_inverse=True)[1]
        _, first, cell = np.unique(code, return_index=True, return_inverse=True)
        return cls(first, cell, rank[first].T.copy())

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums over each cell's rows."""
        return np.bincount(self.cell, values, len(self.first))


def grow_by_ranks(cells: Cells, levels: list[np.ndarray], columns: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, reg: float, value, gain_floor: float = 1e-12) -> Tree:
    """The tree of ``grow`` with leaves of any size, on the cells ``rows``: a node's sums are by the values (``levels``) of ``columns``."""
    tree = Tree()

    def build(rows: np.ndarray, level: int) -> int:
        at = tree.node(value(rows))
        if level == depth or len(rows) < 2:
            return at
        g_, h_, best, found = g[rows], h[rows], -np.inf, None
        gt, ht = float(g_.sum()), float(h_.sum())
        for f in columns.tolist():
            rank = cells.rank[f][rows]
            there = np.flatnonzero(np.bincount(rank))
            if len(there) < 2:
                continue
            gs, hs = (np.cumsum(np.bincount(rank, v)[there])[:-1] for v in (g_, h_))
            score = gs**2 / (hs + reg + 1e-300) + (gt - gs) ** 2 / (ht - hs + reg + 1e-300)
            i = int(score.argmax())
            if score[i] > best:
                best, found = float(score[i]), (f, there[i], rank, (levels[f][there[i]] + levels[f][there[i + 1]]) / 2)
        if not best - gt**2 / (ht + reg + 1e-300) > gain_floor:
            return at
        tree.feature[at], last, rank, tree.cut[at] = found
        tree.left[at] = build(rows[rank <= last], level + 1)
        tree.right[at] = build(rows[rank > last], level + 1)
        return at

    build(rows, 0)
    return tree


def _by_key(key: np.ndarray, most: int, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys (below ``most``) that have a first value above 0, in order, and sums of all values by them; keys are sorted only where few of many are taken."""
    if most > 8 * len(key) + 1000:
        there, key = np.unique(key, return_inverse=True)
        sums = [np.bincount(key, v, len(there)) for v in values]
        kept = np.flatnonzero(sums[0] > 0)
        return there[kept], [v[kept] for v in sums]
    sums = [np.bincount(key, v, most) for v in values]
    there = np.flatnonzero(sums[0] > 0)
    return there, [v[there] for v in sums]


def _running(values: np.ndarray, start: np.ndarray, groups: np.ndarray, place: np.ndarray, k: np.ndarray, count: int) -> np.ndarray:
    """Sums up to each ``place`` within its group ``k`` (below ``count``); ``groups`` follow one another from ``start``."""
    total, base = np.cumsum(values), np.zeros(count)
    base[groups] = total[start] - values[start]
    return total.take(place) - base.take(k)


def _starts(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)


def grow_levels(
    cells: Cells, levels: list[np.ndarray], tree: np.ndarray, cell: np.ndarray, sums: tuple[np.ndarray, np.ndarray], depth: np.ndarray, choose, turned, value, leaf_rows: int = 0, reg: float = 0.0, centred: bool = False, gain_floor: float = 1e-12
) -> tuple[Trees, np.ndarray]:
    """Trees of at most ``depth`` (of each), all of them level by level, and the leaf of each entry.

    An entry is a cell (``cell``) in a tree (``tree``) with two sums over the tree's rows in
    it, the first above 0 where there are any. ``turned`` makes weights h and labels or
    gradients g of them. A level's split maximises sum(g)^2 / (sum(h) + reg), with g
    ``centred`` on its node or not. Sums are taken by node and value of the feature that the
    node tries (``choose`` gives the features for so many nodes of the trees), so no rows are
    sorted. Where ``leaf_rows`` is given, the first sums are numbers of rows.
    """
    n_trees, width, ranks_ = len(depth), len(cells.first), cells.rank.ravel()
    low, high = np.zeros((n_trees, len(cells.rank)), np.int64), np.tile(cells.rank.max(axis=1).astype(np.int64), (n_trees, 1))  # of a node's ranks
    owner, node, entry, (s0, s1) = np.arange(n_trees), tree, np.arange(len(tree)), sums
    leaf = np.zeros(len(tree), np.int64)
    t0, t1 = (np.bincount(node, v, n_trees) for v in sums)
    made: list[tuple] = []  # of each level
    first = level = 0
    while True:
        count = len(owner)
        each = np.arange(count)
        ht, gt = turned(t0, t1)
        feature, cut, child = np.zeros(count, np.int64), np.full(count, np.inf), first + each
        made.append((feature, cut, child, value(ht, gt, owner), owner))
        large = (depth[owner] > level) & (t0 >= 2 * leaf_rows)
        if not large.any():
            break
        if not large.all():
            stay = large[node]
            leaf[entry[~stay]] = first + node[~stay]
            node, cell, entry, s0, s1 = node[stay], cell[stay], entry[stay], s0[stay], s1[stay]
        choice = choose(count)
        mean = gt / np.maximum(ht, 1e-300) if centred else np.zeros(count)
        whole = np.zeros(count) if centred else gt
        best, best_feature, best_cut = np.full(count, -np.inf), np.zeros(count, np.int64), np.zeros(count)
        left0, left1 = np.zeros(count), np.zeros(count)
        for f in choice.T:
            rank = ranks_.take((f * width).take(node) + cell)
            least = low[each, f]
            ends = np.cumsum(np.where(large, high[each, f] - least + 1, 0))
            offset = np.append(0, ends[:-1]) - least
            there, (b0, b1) = _by_key(offset.take(node) + rank, int(ends[-1]), s0, s1)
            k = np.repeat(each, np.diff(np.append(0, ends))).take(there) if ends[-1] < 8 * len(node) else np.searchsorted(ends, there, side="right")
            start = _starts(k)
            groups = k[start]
            place = np.flatnonzero(k[1:] == k[:-1])  # a split is after a value that the node has a larger one than
            k = k.take(place)
            low0 = _running(b0, start, groups, place, k, count)
            if leaf_rows:
                ok = np.flatnonzero((low0 >= leaf_rows) & (low0 <= (t0 - leaf_rows).take(k)))
                place, low0, k = place.take(ok), low0.take(ok), k.take(ok)
            if not len(place):
                continue
            low1 = _running(b1, start, groups, place, k, count)
            h, g = turned(low0, low1)
            g = g - mean.take(k) * h if centred else g
            rest = g if centred else gt.take(k) - g
            score = g * g / (h + (reg + 1e-300)) + rest * rest / (ht.take(k) - h + (reg + 1e-300))
            start = _starts(k)
            kinds, top = k[start], np.maximum.reduceat(score, start)
            where = np.flatnonzero(score == np.repeat(top, np.diff(np.append(start, len(k)))))
            where = where[_starts(k[where])]  # of equally good splits the first
            better = top > best[kinds]
            at, which = place[where[better]], kinds[better]
            best[which], best_feature[which], left0[which], left1[which] = top[better], f[which], low0[where[better]], low1[where[better]]
            for q in np.unique(f[which]).tolist():
                i, w = (v[f[which] == q] for v in (at, which))
                under, over = (levels[q][there[i + s] - offset[w]] for s in (0, 1))
                best_cut[w] = np.where((under + over) / 2 < over, (under + over) / 2, under)
        split = best - whole**2 / (ht + (reg + 1e-300)) > gain_floor
        if not split.any():
            break
        feature[split], cut[split] = best_feature[split], best_cut[split]
        below = 2 * (np.cumsum(split) - 1)  # in the next level
        child[split] = first + count + below[split]
        if not split.all():
            stay = split[node]
            leaf[entry[~stay]] = first + node[~stay]
            node, cell, entry, s0, s1 = node[stay], cell[stay], entry[stay], s0[stay], s1[stay]
            rank = rank[stay]
        last = np.zeros(count, np.int64)  # rank on the left side
        for q in np.unique(best_feature[split]).tolist():
            mine = split & (best_feature == q)
            last[mine] = np.searchsorted(levels[q], best_cut[mine], side="right") - 1
        if choice.shape[1] > 1:
            rank = ranks_.take((best_feature * width).take(node) + cell)
        node = below.take(node) + (rank > last.take(node))
        pairs = np.repeat(each[split], 2)
        low, high, owner = low[pairs], high[pairs], owner[pairs]
        even = np.arange(0, len(pairs), 2)
        high[even, best_feature[split]], low[even + 1, best_feature[split]] = last[split], last[split] + 1
        t0, t1 = (np.column_stack([v[split], (t - v)[split]]).ravel() for t, v in ((t0, left0), (t1, left1)))
        first += count
        level += 1
    leaf[entry] = first + node
    return Trees(*(np.concatenate(v) for v in zip(*made, strict=True)), level, n_trees), leaf


#: Places of a grid for each row, at most.
GRID = 8


@dataclass
class Grid:
    """All pairs of values, for features of at most two orders (those of one order share an axis) with few pairs beside the rows.

    A node of a tree is a box, whose sums by value are read from the table of all pairs: a
    tree passes over its rows once, not at every level.
    """

    shape: tuple[int, int]  # values of each axis, the longer last
    axis: list[int]  # of each feature
    levels: list[np.ndarray]  # of each feature, the values along its axis
    place: np.ndarray  # of each row

    @classmethod
    def of(cls, x: np.ndarray) -> Grid | None:
        rank = ranks(x)
        own = [next(i for i in range(rank.shape[1]) if (rank[:, i] == r).all()) for r in rank.T]
        axes = sorted(set(own), key=lambda f: rank[:, f].max())
        shape = tuple(int(rank[:, f].max()) + 1 for f in axes)
        if len(axes) > 2 or math.prod(shape) > GRID * len(x):
            return None
        if len(axes) == 1:
            return cls((1, *shape), [1] * len(own), [np.unique(c) for c in x.T], rank[:, 0])
        return cls(shape, [axes.index(f) for f in own], [np.unique(c) for c in x.T], rank[:, axes[0]] * shape[1] + rank[:, axes[1]])

    def stacked(self, sums: np.ndarray) -> np.ndarray:
        """Of tables of sums, those of all rows above each."""
        out = np.empty((len(sums), self.shape[0] + 1, self.shape[1]), sums.dtype)
        out[:, 0] = 0
        for i in range(self.shape[0]):
            np.add(out[:, i], sums[:, i], out=out[:, i + 1])
        return out

    def filled(self, boxes: list[tuple]) -> np.ndarray:
        """The sum of the values of all boxes (low, high, value) at each place."""
        ends, values = np.array([b[:2] for b in boxes]), np.array([b[2] for b in boxes])
        out = np.zeros((self.shape[0] + 1) * (self.shape[1] + 1))
        for i, j in itertools.product((0, 1), repeat=2):
            out += np.bincount(ends[:, i, 0] * (self.shape[1] + 1) + ends[:, j, 1], values if i == j else -values, out.size)
        return out.reshape(self.shape[0] + 1, -1).cumsum(axis=0).cumsum(axis=1)[:-1, :-1]


def grow_boxes(grid: Grid, sums: np.ndarray, depth: int, choose, turned, value, leaf_rows: int = 0, reg: float = 0.0, gain_floor: float = 1e-12) -> tuple[Trees, list[tuple]]:
    """One tree of ``grow_levels`` on a grid, node by node, and its leaves as boxes (low, high, value).

    ``sums`` are two tables: with ``leaf_rows`` numbers of rows of each class, and g is
    centred; else curvatures (above 0 where there are rows) and gradients.
    """
    stacked = grid.stacked(sums)
    level = [((0, 0), grid.shape, *stacked[:, -1].sum(axis=1).tolist())]
    made, leaves, first = [], [], 0
    for deep in itertools.count():
        large = [deep < depth and a + b >= 2 * leaf_rows if leaf_rows else deep < depth for _, _, a, b in level]
        choice = choose(len(level)).tolist() if any(large) else level
        below, after = [], first + len(level)
        for number, ((low, high, a, b), big, columns) in enumerate(zip(level, large, choice, strict=True), first):
            ht, gt = turned(a, b)
            mean, whole, best = *((gt / ht, 0.0) if leaf_rows else (0.0, gt)), -np.inf
            for f in columns if big else ():
                if axis := grid.axis[f]:
                    by = stacked[:, high[0], low[1] : high[1]]
                    by = by - stacked[:, low[0], low[1] : high[1]] if low[0] else by
                else:
                    by = sums[:, low[0] : high[0], low[1] : high[1]].sum(axis=2)
                there = np.flatnonzero((by[0] + by[1] if leaf_rows else by[0]) != 0)
                s0, s1 = by[0].take(there).cumsum(), by[1].take(there).cumsum()
                start, end = 0, len(there) - 1  # a split is after a value that the node has a larger one than
                if leaf_rows:
                    rows = s0 + s1
                    start, end = int(rows.searchsorted(leaf_rows)), int(rows.searchsorted(a + b - leaf_rows, side="right"))
                if start >= end:
                    continue
                s0, s1 = s0[start:end].astype(float), s1[start:end].astype(float)
                h, g = turned(s0, s1)
                if leaf_rows:
                    g = g - mean * h
                    square = g * g
                    score = square / h + square / (ht - h)
                else:
                    score = g**2 / (h + reg) + (gt - g) ** 2 / (ht - h + reg)
                i = int(score.argmax())
                if score[i] > best:
                    best, found = score[i], (f, axis, int(there[start + i]), int(there[start + i + 1]), s0[i].item(), s1[i].item())
            if not best - whole**2 / (ht + reg) > gain_floor:
                made.append((0, np.inf, number, value(ht, gt)))
                leaves.append((low, high, made[-1][3]))
                continue
            f, axis, under, over, s0, s1 = found
            under, over = grid.levels[f][low[axis] + under], grid.levels[f][low[axis] + over]
            cut = middle if (middle := (under + over) / 2) < over else under
            at = int(grid.levels[f].searchsorted(cut, side="right"))
            made.append((f, cut, after + len(below), value(ht, gt)))
            below.append((low, (high[0], at) if axis else (at, high[1]), s0, s1))
            below.append(((low[0], at) if axis else (at, low[1]), high, a - s0, b - s1))
        if not below:
            break
        level, first = below, after
    kinds = (np.int64, float, np.int64, float)
    return Trees(*(np.array(v, kind) for v, kind in zip(zip(*made, strict=True), kinds, strict=True)), np.zeros(len(made), np.int64), deep, 1), leaves


def _class_weights(y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """The weights of the rows of class 0 and 1; those of a class are equal."""
    found = [weight[y == v] for v in (0, 1)]
    if any(len(v) and np.ptp(v) for v in found):
        raise ValueError("rows of a class have different weights")
    return tuple(float(v[0]) if len(v) else 1.0 for v in found)


def _choice(rng: np.random.Generator, m: int, tried: int):
    """Columns to try at so many nodes."""
    return lambda count: np.sort(rng.random((count, m)).argpartition(tried - 1, axis=1)[:, :tried], axis=1) if tried < m else np.tile(np.arange(tried), (count, 1))


def _grow_drawn(cells: Cells, levels: list[np.ndarray], kind: np.ndarray, drawn: np.ndarray, weights: tuple[float, float], depth: int, leaf_rows: int, tried: int, rng: np.random.Generator, gain_floor: float = 1e-12) -> Trees:
    """Gini trees on the rows ``drawn`` for each; ``kind`` is twice a row's cell, plus its class."""
    n_trees, width, m = len(drawn), len(cells.first), len(cells.rank)
    kinds = kind[drawn]
    if n_trees > 1:
        kinds += 2 * width * np.arange(n_trees)[:, None]
    often = np.bincount(kinds.ravel(), minlength=2 * width * n_trees).reshape(-1, 2)
    ones = often[:, 1]
    rows = often[:, 0] + ones
    there = np.flatnonzero(rows)
    tree, cell = np.divmod(there, width) if n_trees > 1 else (np.zeros(len(there), np.int64), there)
    turned = (lambda s0, s1: (s0, s1)) if weights == (1.0, 1.0) else lambda s0, s1: (weights[0] * (s0 - s1) + weights[1] * s1, weights[1] * s1)
    sums = rows[there].astype(float), ones[there].astype(float)
    return grow_levels(cells, levels, tree, cell, sums, np.full(n_trees, depth), _choice(rng, m, tried), turned, lambda h, g, _: g / h, leaf_rows, centred=True, gain_floor=gain_floor)[0]


def grow_together(
    x: np.ndarray, rank: np.ndarray, drawn: np.ndarray, y: np.ndarray, weight: np.ndarray, depth: int, leaf_rows: int, tried: int, rng: np.random.Generator, gain_floor: float = 1e-12
) -> Trees:
    """Trees by the Gini criterion of ``grow``: ``drawn`` has each tree's rows of ``x``, ``rank`` the ranks of each feature's values, every node tries ``tried`` features of its own."""
    cells = Cells.of(rank)
    return _grow_drawn(cells, [np.unique(c) for c in x.T], 2 * cells.cell + y.astype(np.int64), drawn, _class_weights(y, weight), depth, leaf_rows, tried, rng, gain_floor)


@dataclass
class Sample:
    """Training rows as trees are grown on them, the same for all candidates: on a grid with the held rows, if there is one, else in cells."""

    y: np.ndarray
    columns: int
    grid: Grid | None
    cells: Cells | None
    levels: list[np.ndarray]
    place: np.ndarray  # of each row, on the grid or among the cells
    held: np.ndarray  # places of the held rows on the grid

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Sample:
        grid = Grid.of(np.concatenate([x, held])) if TOGETHER // len(x) < 2 else None  # with fewer rows, trees grow faster together
        if grid:
            return cls(y, x.shape[1], grid, None, grid.levels, grid.place[: len(x)], grid.place[len(x) :])
        cells = Cells.of(ranks(x))
        return cls(y, x.shape[1], None, cells, [np.unique(c) for c in x.T], cells.cell, np.zeros(0, np.int64))


def fit_forest(s: Sample, depth: int, leaf_rows: int, weight: np.ndarray, trees: int, seed: int) -> tuple[Trees, np.ndarray | None]:
    """The forest, and on a grid the sums of its trees' values for the held rows."""
    rng = np.random.default_rng(seed)
    n, tried = len(s.y), max(1, int(np.sqrt(s.columns)))
    weights, out, boxes = _class_weights(s.y, weight), [], []
    kind = s.place + (s.y == 1) * math.prod(s.grid.shape) if s.grid else 2 * s.place + s.y.astype(np.int64)
    turned = (lambda n0, n1: (n0 + n1, n1)) if weights == (1.0, 1.0) else lambda n0, n1: (weights[0] * n0 + weights[1] * n1, weights[1] * n1)
    choose = _choice(rng, s.columns, tried)
    for first in range(0, trees, some := max(1, TOGETHER // n)):
        drawn = rng.integers(0, n, (min(trees - first, some), n))
        if s.grid:
            sums = np.bincount(kind[drawn[0]], minlength=2 * math.prod(s.grid.shape)).reshape(2, *s.grid.shape)
            made, leaves = grow_boxes(s.grid, sums, depth, choose, turned, lambda h, g: g / h, leaf_rows)
            out.append(made)
            boxes += leaves
        else:
            out.append(_grow_drawn(s.cells, s.levels, kind, drawn, weights, depth, leaf_rows, tried, rng))
    return Trees.of(out), s.grid.filled(boxes).ravel()[s.held] if s.grid else None


def fit_boosted(s: Sample, params: list[tuple[int, float, float]], rounds: int, seed: int, share: float = 0.8) -> list[tuple[Trees, np.ndarray | None]]:
    """Boosted trees for each (depth, rate, weight of class 1), and on a grid their sums for the held rows. All have the same seed, so a round draws the same rows and columns for all."""
    rng = np.random.default_rng(seed)
    n, m = len(s.y), s.columns
    depth, rate, weight = (np.array(v) for v in zip(*params, strict=True))
    there = np.unique(s.place) if s.grid else np.arange(len(s.cells.first))  # places that have rows
    width = len(there)
    kind = 2 * (np.searchsorted(there, s.place) if s.grid else s.place) + s.y.astype(np.int64)
    order = s.grid.axis if s.grid else [next(i for i in range(m) if (s.cells.rank[i] == r).all()) for r in s.cells.rank]
    size = 1 if s.grid else max(1, TOGETHER // width)
    groups = [slice(i, min(i + size, len(params))) for i in range(0, len(params), size)]
    score, out = np.zeros((len(params), *(s.grid.shape if s.grid else [width]))), [[] for _ in groups]
    sums = np.zeros((2, math.prod(s.grid.shape))) if s.grid else None
    same = lambda h, g: (h, g)
    for _ in range(rounds):
        kept = rng.random(n) < share
        if np.count_nonzero(kept) < 2:
            continue
        cols = np.sort(rng.choice(m, max(1, int(share * m)), replace=False)).tolist()
        cols = np.array([c for i, c in enumerate(cols) if order[c] not in [order[d] for d in cols[:i]]])  # columns of one order are tried once
        often = np.bincount(kind.take(np.flatnonzero(kept)), minlength=2 * width).reshape(-1, 2)
        zeros, ones, least = often[:, 0].astype(float), often[:, 1].astype(float), often.sum(axis=1) * 1e-16
        for group, made in zip(groups, out, strict=True):
            # rows of a place have one chance p: their gradients sum to w y - w p, their curvatures to w p (1 - p)
            p = 1 / (1 + np.exp(-(score[group].reshape(-1)[there][None] if s.grid else score[group])))
            positive = weight[group, None] * ones
            wp = (zeros + positive) * p
            h, g = np.maximum(wp * (1 - p), least), positive - wp
            by = rate[group]
            choose = lambda count, cols=cols: np.tile(cols, (count, 1))
            if s.grid:
                sums[0][there], sums[1][there] = h[0], g[0]
                grown, leaves = grow_boxes(s.grid, sums.reshape(2, *s.grid.shape), int(depth[group.start]), choose, same, lambda h, g, by=float(by[0]): by * (g / (h + LAMBDA)), reg=LAMBDA)
                for (a, b), (c, d), v in leaves:
                    score[group.start, a:c, b:d] += v
            else:
                cell, tree = np.tile(there, group.stop - group.start), np.repeat(np.arange(group.stop - group.start), width)
                grown, leaf = grow_levels(s.cells, s.levels, tree, cell, (h.ravel(), g.ravel()), depth[group], choose, same, lambda h, g, owner, by=by: by[owner] * (g / (h + LAMBDA)), reg=LAMBDA)
                score[group] += grown.value.take(leaf).reshape(-1, width)
            made.append(grown)
    trees = [t for g, made in zip(groups, out, strict=True) for t in Trees.of(made).dealt(g.stop - g.start)]
    return [(t, v.ravel()[s.held] if s.grid else None) for t, v in zip(trees, score, strict=True)]


def imputed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the finite values of each column, and ``x`` with them for the others."""
    with np.errstate(all="ignore"):
        medians = np.array([np.median(c[np.isfinite(c)]) if np.isfinite(c).any() else 0.0 for c in x.T])
    return medians, np.where(np.isfinite(x), x, medians)


def fits(candidates: Sequence[models.Candidate], x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int, trees: int, rounds: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """For each candidate of one family, from training rows: what ``predict`` needs (medians for gaps, scaling for logistic, then the model), and chances of class 1 for ``held``."""
    medians, x = imputed(x)
    held = np.where(np.isfinite(held), held, medians)
    balanced = lambda c: balanced_weights(y, c.params["class_weight"] == "balanced")
    family = candidates[0].family
    if family == "logistic":
        mean, std = x.mean(0), x.std(0)
        std[std == 0] = 1.0
        scaled = (x - mean) / std
        for c in candidates:
            made = medians, (mean, std, fit_logistic(scaled, y, c.params["C"], balanced(c)))
            yield made, predict(family, made, held)
        return
    sample = Sample.of(x, y, held)
    if family == "random_forest":
        made = (fit_forest(sample, c.params["max_depth"], c.params["min_samples_leaf"], balanced(c), trees, seed) for c in candidates)
    else:
        ratio = lambda c: (len(y) - y.sum()) / y.sum() if c.params["class_weight_mode"] == "training_ratio" else 1.0
        made = fit_boosted(sample, [(c.params["max_depth"], c.params["learning_rate"], ratio(c)) for c in candidates], rounds, seed)
    cells = None if sample.grid or not len(held) else Cells.of(ranks(held))
    for model, total in made:
        yield (medians, model), predict(family, (medians, model), held, cells) if total is None else _chances(family, model, total)


def _chances(family: str, model: Trees, total: np.ndarray) -> np.ndarray:
    return total / model.count if family == "random_forest" else 1 / (1 + np.exp(-total))


def predict(family: str, fitted: tuple, held: np.ndarray, cells: Cells | None = None) -> np.ndarray:
    """Chances of class 1 for ``held``; its ``cells``, of imputed values, may be given."""
    medians, model = fitted
    held = np.where(np.isfinite(held), held, medians)
    if family == "logistic":
        mean, std, w = model
        return 1 / (1 + np.exp(-np.clip(((held - mean) / std) @ w[:-1] + w[-1], -500, 500)))
    if not len(held):
        return np.zeros(0)
    cells = cells or Cells.of(ranks(held))  # equal rows are predicted once
    total = model.totals(held[cells.first])
    return _chances(family, model, total)[cells.cell]


def fit_predict(candidate: models.Candidate, x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int, trees: int, rounds: int) -> np.ndarray:
    """Chances of class 1 for ``held`` from training rows."""
    return next(fits([candidate], x, y, held, seed, trees, rounds))[1]


def balanced_accuracy(y: np.ndarray, hard: np.ndarray) -> float | None:
    both = [np.mean(hard[y == v] == v) for v in (0, 1) if (y == v).any()]
    return float(np.mean(both)) if len(both) == 2 else None


SCORES = "outer string, family string, position int, fold int, scores array<double>"
PREDICTED = "participant_id string, window_id string, y int, outer_fold int, model_family string, prob_positive double, hard int, candidate_id string, candidate_params string, model_seed long"


def out_of_fold_predictions(
    rows: DataFrame, columns: list[str], families: list[str], seed: int = 42, n_inner: int = 4, grids: dict[str, tuple[models.Candidate, ...]] | None = None, trees: int = models.TREES, rounds: int = models.ROUNDS,
    skip_single_class: bool = False,
) -> DataFrame:
    """As ``models.out_of_fold_predictions``, with every fit a task.

    Two task tables: one row for each (outer participant, family, inner fold), giving the
    scores of all candidates, which share what is made of the fold's rows; then one for each
    (outer participant, family) of the chosen ones, giving models, by which the rows are
    predicted where they are. A validation participant with one class only is an error, or
    left out with ``skip_single_class``.
    """
    spark = rows.sparkSession
    grids = grids or models.GRIDS
    rows = rows.select("participant_id", "window_id", F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in columns])
    counts = {r["participant_id"]: (r["n0"], r["n1"]) for r in models.class_counts(rows).orderBy("participant_id").collect()}  # one row a participant
    people = list(counts)
    number = {p: i for i, p in enumerate(people)}
    known = rows.filter("y IS NOT NULL AND NOT isnan(y)").orderBy("participant_id", "window_id", "y", *columns)
    place = F.create_map(*[F.lit(v) for p in people for v in (p, number[p])])[F.col("participant_id")]
    table = known.select(place.cast("int").alias("at"), "y", *columns).toArrow()
    size = max(1, BROADCAST_CELLS // len(columns))
    pieces = []
    for start in range(0, table.num_rows, size):
        part = table.slice(start, size)
        x = np.column_stack([part.column(c).to_numpy().astype(float) for c in columns])
        pieces.append(spark.sparkContext.broadcast((part.column("at").to_numpy(), part.column("y").to_numpy(), x)))
    del table

    def training():
        """(participant's number, label, features) of all labelled rows, in order."""
        held = [p.value for p in pieces]
        return held[0] if len(held) == 1 else tuple(np.concatenate(v) for v in zip(*held, strict=True))

    learned = sorted((f for f in families if f != "majority"), key=["random_forest", "xgboost", "logistic"].index)  # those that take longest go first
    splits = {p: inner_split(counts, p, seed, n_inner) for p in counts} if any(len(grids[f]) > 1 for f in learned) else {}
    people_of = lambda who, ids: np.isin(np.arange(len(people)), [number[v] for v in ids])[who]

    def dealt(tasks: list[tuple], work, schema: str) -> DataFrame:
        """``work`` on each task, one a partition."""

        def run(frames):
            held = training()
            for i in (int(i) for frame in frames for i in frame["id"]):
                yield work(*held, *tasks[i])

        return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInPandas(run, schema)

    def scored(who, y, x, outer, family, fold):
        """Balanced accuracies of the fold's participants for every candidate."""
        fit_, for_ = (people_of(who, ids) for ids in (splits[outer].folds[fold].train, splits[outer].folds[fold].validation))
        held, truth = x[for_], y[for_]
        mine, out = [who[for_] == number[v] for v in splits[outer].folds[fold].validation], []
        for position, (_, p) in enumerate(fits(grids[family], x[fit_], y[fit_], held, child_seed(seed, f"model_fit:{family}:{outer}"), trees, rounds)):
            hard = (p >= models.THRESHOLD).astype(int)
            out.append((outer, family, position, fold, [balanced_accuracy(truth[rows], hard[rows]) for rows in mine]))
        return pd.DataFrame(out, columns=["outer", "family", "position", "fold", "scores"])

    chosen: dict[tuple[str, str], int] = {(p, f): 0 for p in counts for f in learned}
    if splits:
        tasks = [(p, f, fold.index) for f in learned for p in counts for fold in splits[p].folds]
        got: dict[tuple[str, str], dict[int, dict[int, list]]] = {}
        for r in dealt(tasks, scored, SCORES).collect():  # a row a candidate and fold
            if None in r["scores"] and not skip_single_class:
                raise ValueError(f"a validation participant of {r['outer']} has one class only")
            got.setdefault((r["outer"], r["family"]), {}).setdefault(r["position"], {})[r["fold"]] = [v for v in r["scores"] if v is not None]
        for key, scores in got.items():
            every = {i: [v for fold in sorted(of) for v in of[fold]] for i, of in scores.items()}
            chosen[key] = models.best_candidate([{"candidate": i, "score": float(np.mean(every[i])) if every[i] else None} for i in sorted(every)])

    def fitted(who, y, x, outer, family, position):
        use = who != number[outer]
        made = y[use].mean() if family == "majority" else next(fits([grids[family][position]], x[use], y[use], x[:0], child_seed(seed, f"model_fit:{family}:{outer}"), trees, rounds))[0]
        return pd.DataFrame({"outer": [outer], "family": [family], "model": [pickle.dumps(made)]})

    tasks = [(p, f, chosen.get((p, f), 0)) for f in [*learned, *(f for f in families if f == "majority")] for p in counts]
    found = dealt(tasks, fitted, "outer string, family string, model binary").collect()  # one row a participant and family
    shared = spark.sparkContext.broadcast({(r["outer"], r["family"]): bytes(r["model"]) for r in found})

    def predicted(frames):
        kept = {}
        for frame in frames:
            for (outer, family), held in ((k, h) for who, h in frame.groupby("participant_id", sort=False) for k in [(who, f) for f in families]):
                if (outer, family) not in kept:
                    kept[outer, family] = pickle.loads(shared.value[outer, family])
                made = own = None
                if family == "majority":
                    p = np.full(len(held), kept[outer, family])
                    hard = (p > 0.5).astype(int)
                else:
                    made, own = grids[family][chosen[outer, family]], child_seed(seed, f"model_fit:{family}:{outer}")
                    p = predict(family, kept[outer, family], held[columns].to_numpy(float))
                    hard = (p >= models.THRESHOLD).astype(int)
                yield pd.DataFrame(
                    {
                        "participant_id": outer, "window_id": held["window_id"].to_numpy(), "y": held["y"].astype("Int64").to_numpy(), "outer_fold": number[outer], "model_family": family,
                        "prob_positive": p, "hard": hard, "candidate_id": made.candidate_id if made else None, "candidate_params": made.params_json() if made else None, "model_seed": pd.array([own] * len(held), "Int64"),
                    }
                )

    made = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(predicted, PREDICTED)  # few large files would be few tasks
    return made.withColumn("hard", F.col("hard").cast("byte"))
