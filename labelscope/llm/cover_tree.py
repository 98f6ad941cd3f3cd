"""Cover trees over unit vectors and the dual traversal of two of them.

A tree has nested levels whose nodes cover balls of halving radii (chord distance):
every node's centre is a point, and is a node of each finer level too. Node pairs are
pruned when their centres are farther apart than the threshold plus both covering
radii, taken as a whole when they are nearer than the threshold less both, and else
replaced by the pairs of their children, down to points, whose cosine decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from labelscope.llm.components import smallest_reachable

RADII = (0.5, 0.25, 0.125, 0.0625)
ROWS = 512
PAIRS = 1 << 16
EDGES = 1 << 20
#: Slack for rounding: single precision where centres are first compared, double elsewhere.
COARSE, FINE = 1e-3, 1e-9


def net(x: np.ndarray, members: np.ndarray, radius: float) -> np.ndarray:
    """For each of ``members`` (rows of ``x``) the one that covers it; greedy, in the given order."""
    close = 1 - radius * radius / 2
    cover = np.full(len(members), -1, np.int64)
    centres: list[np.ndarray] = []
    ids: list[np.ndarray] = []
    for at in range(0, len(members), ROWS):
        mine = members[at : at + ROWS]
        block = x[mine]
        best, who = np.full(len(mine), -2.0, x.dtype), np.full(len(mine), -1, np.int64)
        for c, i in zip(centres, ids, strict=True):
            sims = block @ c.T
            arg = sims.argmax(1)
            top = sims[np.arange(len(mine)), arg]
            up = top > best
            best[up], who[up] = top[up], i[arg[up]]
        own = np.where(best >= close, who, -1)
        left = np.flatnonzero(own < 0)
        if len(left):
            near = block[left] @ block[left].T >= close
            free = np.ones(len(left), bool)
            new = []
            for k in range(len(left)):
                if free[k]:
                    take = near[k] & free
                    take[k] = True
                    own[left[take]] = mine[left[k]]
                    free &= ~take
                    new.append(k)
            fresh = mine[left[new]]
            if centres and len(centres[-1]) < 4096:
                centres[-1], ids[-1] = np.concatenate([centres[-1], x[fresh]]), np.concatenate([ids[-1], fresh])
            else:
                centres.append(x[fresh])
                ids.append(fresh)
        cover[at : at + ROWS] = own
    return cover


def paths(x: np.ndarray) -> np.ndarray:
    """Per point its node (a point) at every level, coarsest first."""
    single = x.astype(np.float32)
    out = np.empty((len(x), len(RADII)), np.int64)
    members, of_point = np.arange(len(x)), np.arange(len(x))
    for level in range(len(RADII) - 1, -1, -1):
        cover = np.empty(len(x), np.int64)
        cover[members] = net(single, members, RADII[level])
        of_point = cover[of_point]
        out[:, level] = of_point
        members = np.unique(of_point)
    return out


class Tree:
    """Levels of nodes over the points ``x``; the last level is the points themselves."""

    def __init__(self, x: np.ndarray, path: np.ndarray, copies: np.ndarray):
        self.x, self.copies = x, copies
        self.centre: list[np.ndarray] = []
        self.of_point: list[np.ndarray] = []
        self.radius: list[np.ndarray] = []
        self.many: list[np.ndarray] = []  # whether a node has more than one point
        self.weight: list[np.ndarray] = []
        self.children: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for level in range(path.shape[1] + 1):
            node = path[:, level] if level < path.shape[1] else np.arange(len(x))
            centre, of_point = np.unique(node, return_inverse=True)
            gap = _chord(np.einsum("ij,ij->i", x, x[node]))
            radius = np.zeros(len(centre))
            np.maximum.at(radius, of_point, gap)
            points = np.bincount(of_point, minlength=len(centre))
            radius[points == 1] = 0.0
            self.many.append(points > 1)
            self.centre.append(centre)
            self.of_point.append(of_point)
            self.radius.append(radius)
            self.weight.append(np.bincount(of_point, weights=copies, minlength=len(centre)))
        for level in range(path.shape[1]):
            parent = np.empty(len(self.centre[level + 1]), np.int64)
            parent[self.of_point[level + 1]] = self.of_point[level]
            order = np.argsort(parent, kind="stable")
            count = np.bincount(parent, minlength=len(self.centre[level]))
            self.children.append((order, np.cumsum(count) - count, count))
        self.links = [np.zeros(len(c), np.int64) for c in self.centre]
        self.inner = [np.zeros(len(c), bool) for c in self.centre]

    def totals(self) -> np.ndarray:
        """Links of each point (its own copies left out) from all that the traversals found."""
        total = np.zeros(len(self.x), np.int64)
        for level, of_point in enumerate(self.of_point):
            total += self.links[level][of_point]
            whole = self.inner[level][of_point]
            total[whole] += (self.weight[level][of_point[whole]] - self.copies[whole]).astype(np.int64)
        return total


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


class Edges:
    """Connections of points, kept small by reducing them to stars."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.rows += len(a)
        if self.rows > EDGES:
            self.parts = [self.stars()]
            self.rows = len(self.parts[0][0])

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in (0, 1))
        node, low = smallest_reachable(a, b)
        return node[node != low], low[node != low]


def join(a: Tree, b: Tree | None, threshold: float, ids_a: np.ndarray, ids_b: np.ndarray, edges: Edges) -> None:
    """Find all links between points of ``a`` and ``b`` (within ``a`` where ``b`` is None)."""
    own = b is None
    b = a if own else b
    limit = float(np.sqrt(2 - 2 * threshold))
    xa, xb = a.x[a.centre[0]].astype(np.float32), b.x[b.centre[0]].astype(np.float32)
    for at in range(0, len(xa), ROWS):
        cosine = xa[at : at + ROWS] @ xb.T
        reach = limit + a.radius[0][at : at + ROWS, None] + b.radius[0][None] + COARSE
        i, j = np.nonzero(cosine >= 1 - reach.astype(np.float32) ** 2 / 2)
        i = i + at
        if own:
            i, j = i[i <= j], j[i <= j]
        _descend(a, b, own, 0, i, j, limit, threshold, ids_a, ids_b, edges)


def _chunks(n: int, size: np.ndarray) -> Iterator[slice]:
    """Slices of pairs whose expansions sum to about PAIRS."""
    total = np.cumsum(size)
    at = 0
    while at < n:
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right"))
        end = max(end, at + 1)
        yield slice(at, end)
        at = end


def _descend(a: Tree, b: Tree, own: bool, level: int, i: np.ndarray, j: np.ndarray, limit: float, threshold: float, ids_a, ids_b, edges: Edges) -> None:
    for part in _chunks(len(i), np.ones(len(i), np.int64)):
        p, q = i[part], j[part]
        cosine = np.einsum("ij,ij->i", a.x[a.centre[level][p]], b.x[b.centre[level][q]])
        last = level == len(a.children)
        same = (p == q) if own else np.zeros(len(p), bool)
        if last:
            linked = (cosine >= threshold) & ~same
            whole, open_ = linked, np.zeros(len(p), bool)
        else:
            gap = _chord(cosine)
            both = a.radius[level][p] + b.radius[level][q]
            alone = same & ~a.many[level][p]
            whole = (gap + both <= limit - FINE) & ~alone
            open_ = ~whole & (gap <= limit + both + FINE) & ~alone
        alike = whole & same
        if alike.any():
            a.inner[level][p[alike]] = True
            member = np.flatnonzero(a.inner[level][a.of_point[level]] & np.isin(a.of_point[level], p[alike]))
            edges.add(ids_a[member], ids_a[a.centre[level][a.of_point[level][member]]])
        other = whole & ~same
        if other.any():
            r, s = p[other], q[other]
            np.add.at(a.links[level], r, b.weight[level][s].astype(np.int64))
            np.add.at(b.links[level], s, a.weight[level][r].astype(np.int64))
            edges.add(ids_a[a.centre[level][r]], ids_b[b.centre[level][s]])
            if not last:
                for tree, ids, nodes in ((a, ids_a, np.unique(r)), (b, ids_b, np.unique(s))):
                    member = np.flatnonzero(np.isin(tree.of_point[level], nodes))
                    edges.add(ids[member], ids[tree.centre[level][tree.of_point[level][member]]])
        if open_.any():
            r, s = p[open_], q[open_]
            order_a, start_a, count_a = a.children[level]
            order_b, start_b, count_b = b.children[level]
            for piece in _chunks(len(r), count_a[r] * count_b[s]):
                u, v = r[piece], s[piece]
                for rows in _split_large(count_a[u]):
                    u_, v_, low, high = u[rows[0]], v[rows[0]], rows[1], rows[2]
                    size = (high - low) * count_b[v_]
                    k = np.repeat(np.arange(len(u_)), size)
                    offset = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
                    c = order_a[start_a[u_[k]] + low[k] + offset // count_b[v_[k]]]
                    d = order_b[start_b[v_[k]] + offset % count_b[v_[k]]]
                    if own:
                        inside = (u_[k] != v_[k]) | (c <= d)
                        c, d = c[inside], d[inside]
                    _descend(a, b, own, level + 1, c, d, limit, threshold, ids_a, ids_b, edges)


def _split_large(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, first child, end child) so that a pair with very many children is opened a stretch at a time."""
    stretch = 1024
    for low in range(0, int(count.max()), stretch):
        rows = np.flatnonzero(count > low)
        yield rows, np.full(len(rows), low), np.minimum(count[rows], low + stretch)
