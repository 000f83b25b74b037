"""Hierarchical density clustering: the neighbour searches can be dealt out, the rest is linear in memory."""

from __future__ import annotations

import numpy as np

from . import ship

ship(__name__)

#: Points of one leaf of the tree by which far points are left out, and neighbours that are kept of each point.
LEAF, NEAREST = 256, 16


def tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Order of points by halves of the widest side, and the starts of the leaves (with the end)."""
    order, starts, todo = np.arange(len(x)), [], [(0, len(x))]
    while todo:
        s, e = todo.pop()
        if e - s <= leaf:
            starts.append(s)
            continue
        part = x[order[s:e]]
        side, half = int(np.argmax(part.max(0) - part.min(0))), (e - s) // 2
        order[s:e] = order[s:e][np.argpartition(part[:, side], half)]
        todo += [(s, s + half), (s + half, e)]
    return order, np.array([*sorted(starts), len(x)])


class Points:
    """Distinct points in the tree's order, with how often each occurs."""

    def __init__(self, x: np.ndarray, times: np.ndarray, leaf: int = LEAF):
        self.order, self.starts = tree(x, leaf)
        self.x, self.times = np.ascontiguousarray(x[self.order]), times[self.order]
        cuts = self.starts[:-1]
        self.low, self.high = np.minimum.reduceat(self.x, cuts), np.maximum.reduceat(self.x, cuts)
        self.square = (self.x**2).sum(1)

    def leaves(self) -> int:
        return len(self.starts) - 1

    def apart(self, leaf: int) -> np.ndarray:
        """Least distance of each leaf's box from this one's."""
        gap = np.maximum(np.maximum(self.low - self.high[leaf], self.low[leaf] - self.high), 0)
        return np.sqrt((gap**2).sum(1)) * (1 - 1e-9)

    def between(self, rows: np.ndarray, s: int, e: int) -> np.ndarray:
        """Distances of rows from the points of a leaf; small ones, which lose digits as differences of squares, are taken anew."""
        a, b = self.x[rows], self.x[s:e]
        base = self.square[rows][:, None] + self.square[s:e]
        d = base - 2 * (a @ b.T)
        i, j = np.nonzero(d < 1e-5 * base)
        d[i, j] = ((a[i] - b[j]) ** 2).sum(1)
        return np.sqrt(np.maximum(d, 0))


def points(state: dict) -> Points:
    """From the attributes of another: plain arrays, which a task needs no module to read."""
    p = Points.__new__(Points)
    p.__dict__.update(state)
    return p


def exact(p: Points, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((p.x[a] - p.x[b]) ** 2).sum(-1))


def nearest(p: Points, leaf: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and numbers of the k nearest other points of each point of a leaf, by distance."""
    rows = np.arange(p.starts[leaf], p.starts[leaf + 1])
    k = min(k, len(p.x) - 1)
    best, who = np.full((len(rows), k), np.inf), np.full((len(rows), k), -1)
    gap = p.apart(leaf)
    for other in np.argsort(gap, kind="stable"):
        if k == 0 or gap[other] > best[:, -1].max():
            break
        s, e = p.starts[other], p.starts[other + 1]
        d = p.between(rows, s, e)
        if other == leaf:
            d[np.arange(len(rows)), np.arange(len(rows))] = np.inf
        some = np.flatnonzero((d < best[:, -1:]).any(1))
        if not len(some):
            continue
        d = np.concatenate([best[some], d[some]], 1)
        ids = np.concatenate([who[some], np.broadcast_to(np.arange(s, e), (len(some), e - s))], 1)
        take = np.argpartition(d, k - 1, 1)[:, :k]
        take = np.take_along_axis(take, np.argsort(np.take_along_axis(d, take, 1), 1, kind="stable"), 1)
        best[some], who[some] = np.take_along_axis(d, take, 1), np.take_along_axis(ids, take, 1)
    best = exact(p, rows[:, None], who)
    by = np.argsort(best, 1, kind="stable")
    return np.take_along_axis(best, by, 1), np.take_along_axis(who, by, 1)


def outside(p: Points, core: np.ndarray, part: np.ndarray, rows: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of one leaf: least mutual reachability of a point of another part, if it is at most the bound; and that point or -1."""
    leaf = int(np.searchsorted(p.starts, rows[0], "right")) - 1
    gap = np.maximum(p.apart(leaf), np.minimum.reduceat(core, p.starts[:-1]))
    best, who = bound.copy(), np.full(len(rows), -1)
    low, high = np.minimum.reduceat(part, p.starts[:-1]), np.maximum.reduceat(part, p.starts[:-1])
    own = part[rows]
    for other in np.argsort(gap, kind="stable"):
        on = np.flatnonzero((best >= gap[other]) & (best >= core[rows]) & ((who < 0) | (best > core[rows])) & ((own != low[other]) | (own != high[other])))
        if not len(on):
            if gap[other] > best.max():
                break
            continue
        s, e = p.starts[other], p.starts[other + 1]
        d = np.maximum(np.maximum(p.between(rows[on], s, e), core[s:e]), core[rows[on], None])
        d[part[s:e] == own[on, None]] = np.inf
        j = np.argmin(d, 1)
        least = d[np.arange(len(on)), j]
        better = (least < best[on]) | ((who[on] < 0) & (least <= best[on] * (1 + 1e-12)))
        better &= np.isfinite(least)
        best[on[better]], who[on[better]] = least[better], s + j[better]
    return best, who


def spanning_tree(points, samples: int, all_leaves=None, all_outside=None) -> np.ndarray:
    """Minimum spanning tree of mutual reachability, rows ``a, b, distance`` by distance (ties by a and b).

    Copies of a point hang on its first one. The distinct points are joined part by part
    (Boruvka): each part but the largest takes its least edge to another part, from its points'
    nearest neighbours where these decide it, else by a search that leaves far leaves out. The two
    functions do this for many leaves, such as in Spark's tasks; left out, they run here.
    """
    x = np.asarray(points, float)
    distinct, first, inverse, times = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    p = Points(distinct, times)
    n, inverse = len(distinct), inverse.reshape(-1)
    first = first[p.order]
    k = max(NEAREST, samples)
    found = [nearest(p, leaf, k) for leaf in range(p.leaves())] if all_leaves is None else all_leaves(p, k)
    near, who = (np.concatenate([f[c] for f in found]) for c in (0, 1))
    # The distance to the samples-th neighbour, copies and the point itself included.
    counted = np.concatenate([p.times[:, None], p.times[:, None] + np.cumsum(p.times[who], 1)], 1)
    at = (counted < min(samples, len(x))).sum(1)
    core = np.concatenate([np.zeros((n, 1)), near], 1)[np.arange(n), at]
    place = np.empty(n, int)
    place[p.order] = np.arange(n)
    where = place[inverse]
    copies = np.flatnonzero(first[where] != np.arange(len(x)))
    edges = [(first[where[copies]], copies, core[where[copies]])]
    far = near[:, -1] if near.shape[1] else np.zeros(n)
    reach = np.maximum(np.maximum(near, core[:, None]), core[who])
    part, parts = np.arange(n), n
    while parts > 1:
        other = part[who] != part[:, None]
        reach = np.where(other, reach, np.inf)  # who is in one part stays there
        pick = np.argmin(reach, 1)
        least, to = reach[np.arange(n), pick], who[np.arange(n), pick]
        limit = np.full(n, np.inf)
        np.minimum.at(limit, part, least)
        largest = np.argmax(np.bincount(part, minlength=n))
        # Points outside a list are no nearer than its last one; where that leaves room below the part's least edge, all are searched.
        open_ = np.flatnonzero((part != largest) & (np.maximum(far, core) < np.minimum(limit[part], least))) if near.shape[1] < n - 1 else np.array([], int)
        if len(open_):
            leaf = np.searchsorted(p.starts, open_, "right") - 1
            groups = np.split(open_, np.flatnonzero(np.diff(leaf)) + 1)
            bounds = [limit[part[g]] for g in groups]
            got = [outside(p, core, part, g, b) for g, b in zip(groups, bounds, strict=True)] if all_outside is None else all_outside(p, core, part, groups, bounds)
            w = np.concatenate([g[1] for g in got])
            hit = w >= 0
            rows = open_[hit]
            d = np.maximum(np.maximum(exact(p, rows, w[hit]), core[rows]), core[w[hit]])
            nearer = d < least[rows]
            least[rows[nearer]], to[rows[nearer]] = d[nearer], w[hit][nearer]
        rows = np.flatnonzero((part != largest) & np.isfinite(least))
        a, b = np.minimum(first[rows], first[to[rows]]), np.maximum(first[rows], first[to[rows]])
        by = np.lexsort((b, a, least[rows], part[rows]))
        rows = rows[by]
        rows = rows[np.r_[True, part[rows][1:] != part[rows][:-1]]]
        top = np.arange(n)

        def find(v: int) -> int:
            while top[v] != v:  # noqa: B023
                top[v] = top[top[v]]  # noqa: B023
                v = top[v]  # noqa: B023
            return v

        kept = []
        for r in rows[np.lexsort((np.maximum(first[rows], first[to[rows]]), np.minimum(first[rows], first[to[rows]]), least[rows]))].tolist():
            i, j = find(int(part[r])), find(int(part[to[r]]))
            if i != j:
                top[max(i, j)] = min(i, j)
                kept.append(r)
        kept = np.array(kept)
        edges.append((first[kept], first[to[kept]], least[kept]))
        while (top[top] != top).any():
            top = top[top]
        part, parts = top[part], parts - len(kept)
    a, b, d = (np.concatenate([e[c] for e in edges]) for c in range(3))
    by = np.lexsort((np.maximum(a, b), np.minimum(a, b), d))
    return np.stack([a[by], b[by], d[by]], 1)


def cluster(points, least: int, samples: int, **searches) -> np.ndarray:
    """Labels from 0 in order of the first member, -1 for noise, by excess of mass.

    The tree's merges form a dendrogram. Splits into two sides of ``least`` or more are
    new clusters, others shed points; a cluster is kept if it is more stable than its
    children together. The root is never kept. Memory is linear in the points.
    """
    x = np.asarray(points, float)
    n = len(x)
    if n < max(least, 2):
        return np.full(n, -1)
    left, right, height, size = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1), np.ones(2 * n - 1, int)
    top = np.arange(2 * n - 1)

    def find(v: int) -> int:
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    for k, (a, b, d) in enumerate(spanning_tree(x, samples, **searches).tolist()):
        i, j = find(int(a)), find(int(b))
        left[k], right[k], height[k] = i, j, d
        size[n + k] = size[i] + size[j]
        top[i] = top[j] = n + k

    def leaves(v: int) -> list[int]:
        found, todo = [], [v]
        while todo:
            u = todo.pop()
            if u < n:
                found.append(u)
            else:
                todo += [left[u - n], right[u - n]]
        return found

    births, stability, parents, members = [0.0], [0.0], [-1], [[]]
    todo = [(2 * n - 2, 0)]
    while todo:
        v, c = todo.pop()
        while v >= n:
            i, j, d = left[v - n], right[v - n], height[v - n]
            density = 1 / d if d > 0 else np.inf
            lasting = (density - births[c]) if np.isfinite(density) else 1e12
            big = [u for u in (i, j) if size[u] >= least]
            if len(big) == 2:
                stability[c] += lasting * size[v]
                for u in big:
                    births.append(density if np.isfinite(density) else 1e12)
                    stability.append(0.0)
                    parents.append(c)
                    members.append([])
                    todo.append((u, len(births) - 1))
                break
            if not big:
                stability[c] += lasting * size[v]
                members[c] += leaves(v)
                break
            shed = j if big[0] == i else i
            stability[c] += lasting * size[shed]
            members[c] += leaves(shed)
            v = big[0]
        else:
            members[c].append(v)
    chosen = np.ones(len(births), bool)
    below = [0.0] * len(births)
    for c in range(len(births) - 1, 0, -1):
        if below[c] > stability[c]:
            chosen[c], stability[c] = False, below[c]
        below[parents[c]] += stability[c]
    chosen[0] = False
    labels = np.full(n, -1)
    owners = [-1] * len(births)
    for c in range(1, len(births)):  # parents come first
        owners[c] = owners[parents[c]] if owners[parents[c]] >= 0 else c if chosen[c] else -1
        labels[members[c]] = owners[c]
    order: dict[int, int] = {}
    for v in labels:
        if v >= 0:
            order.setdefault(int(v), len(order))
    return np.array([order.get(int(v), -1) for v in labels])


def searches(context) -> dict:
    """The two neighbour searches in tasks of a Spark context; points and parts are broadcast, each task takes some leaves."""
    sent = {}

    def dealt(items: list, use) -> list:
        slices = min(len(items), max(4 * context.defaultParallelism, 64))
        return context.parallelize(items, slices).map(use).collect()

    def all_leaves(p: Points, k: int) -> list:
        sent["p"] = at = context.broadcast(p.__dict__)
        return dealt(list(range(p.leaves())), lambda leaf: (lambda d, w: (d, w.astype("int32")))(*nearest(points(at.value), leaf, k)))

    def all_outside(p: Points, core: np.ndarray, part: np.ndarray, groups: list, bounds: list) -> list:
        at, state = sent["p"], context.broadcast((core, part))
        out = dealt(list(zip(groups, bounds, strict=True)), lambda g: outside(points(at.value), *state.value, *g))
        state.destroy()
        return out

    return {"all_leaves": all_leaves, "all_outside": all_outside}
