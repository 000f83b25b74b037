"""Deterministic Louvain communities of a weighted undirected graph."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pandas as pd

from . import ship

ship(__name__)


#: Communities of more members are not looked through for the nodes next to them: all nodes are checked instead.
MANY = 200


def _pass(near: list, degree: list, two_m: float) -> tuple[list, bool]:
    """Move nodes, in ascending order, to the neighbouring community with most gain until none moves.

    ``near`` has each node's neighbours and weights. A node that stayed is looked at again only when
    a neighbour has moved, or when a community next to it has changed and so much degree has moved
    anywhere that its lead could be gone. While few nodes move between small communities, a sweep
    goes through a queue of the nodes next to a change instead of through all nodes.
    """
    n = len(near)
    beside = [[u for u, _ in x] for x in near]
    community, weight, members = list(range(n)), list(degree), [{v} for v in range(n)]
    dirty, lead, seen = [True] * n, [0.0] * n, [0.0] * n
    changed, looked, moves = [0] * n, [0] * n, 0
    shifted, before, queue = 0.0, -1, None  # no queue: all nodes are gone through
    at_hand, at_next, queued, waiting = 0, [], bytearray(n), bytearray(n)

    def touched(v: int) -> bool:
        return dirty[v] or max(changed[community[v]], max(map(changed.__getitem__, map(community.__getitem__, beside[v])), default=0)) > looked[v]

    while moves != before:
        before, wide, at_hand = moves, False, 0
        while queue or (queue is None and at_hand < n):
            if queue is None:
                v = at_hand
                at_hand += 1
            else:
                v = heappop(queue)
                queued[v] = 0
            # A move changes the weights of two communities by its degree, so a gain and home's come nearer by twice that at most.
            share = degree[v] / two_m
            if not dirty[v] and lead[v] - 2 * (shifted - seen[v]) * share > 1e-9:
                if queue is not None and not waiting[v] and touched(v):
                    waiting[v] = 1
                    at_next.append(v)
                continue
            if not touched(v):
                continue
            links: dict = {}
            for u, w in near[v]:
                c = community[u]
                links[c] = links.get(c, 0.0) + w
            home = community[v]
            weight[home] -= degree[v]
            best = home
            most = stay = links.get(home, 0.0) - weight[home] * degree[v] / two_m
            other = float("-inf")
            for c in sorted(links):
                gain = links[c] - weight[c] * degree[v] / two_m
                if c != home and gain > other:
                    other = gain
                if gain > most + 1e-12:
                    best, most = c, gain
            weight[best] += degree[v]
            community[v] = best
            dirty[v], lead[v], seen[v], looked[v] = best != home, stay - other, shifted, moves
            if best == home:
                continue
            shifted += degree[v]
            moves += 1
            changed[home] = changed[best] = moves
            members[home].discard(v)
            members[best].add(v)
            for u in beside[v]:
                dirty[u] = True
            if len(members[home]) + len(members[best]) > MANY:
                wide = True
                if queue is not None:  # the rest of this sweep and the next one go through all nodes
                    queue, at_hand = None, v + 1
            elif queue is not None:
                for m in (v, *members[home], *members[best]):
                    for u in (m, *beside[m]):
                        if u > v:
                            if not queued[u]:
                                queued[u] = 1
                                heappush(queue, u)
                        elif not waiting[u]:
                            waiting[u] = 1
                            at_next.append(u)
        if queue is None:
            queue = None if wide or moves - before > n // 50 else [v for v in range(n) if touched(v)]
        else:
            queue = sorted(at_next)
        at_next, queued, waiting = [], bytearray(n), bytearray(n)
        for v in queue or ():
            queued[v] = 1
    return community, moves > 0


def _merged(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal ends in order, weights added up."""
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
    return a[first], b[first], np.add.reduceat(w, first) if len(first) else w


def louvain(edges) -> dict:
    """Community number of each node of ``(a, b, weight)`` edges, in order of the smallest member."""
    rows = list(edges)
    a, b, w = (np.array([r[k] for r in rows], t) for k, t in ((0, "int64"), (1, "int64"), (2, float)))
    return dict(zip(*(x.tolist() for x in labels(a, b, w)), strict=True))


def labels(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in order and their community numbers, from the ends and weights of edges."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    a, b, w = _merged(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]).astype(float))
    n, of = len(nodes), np.arange(len(nodes))
    loops = np.zeros(n)
    while n:
        degree = np.bincount(a, w, n) + 2 * loops
        cut = np.searchsorted(a, np.arange(n + 1)).tolist()
        both = list(zip(b.tolist(), w.tolist(), strict=True))
        found, moved = _pass([both[s:e] for s, e in zip(cut, cut[1:], strict=False)], degree.tolist(), float(degree.sum()))
        names, community = np.unique(found, return_inverse=True)
        of = community[of]
        if not moved:
            break
        n, ca, cb = len(names), community[a], community[b]
        loops = np.bincount(community, loops, n) + np.bincount(ca[ca == cb], w[ca == cb] / 2, n)
        a, b, w = _merged(ca[ca != cb], cb[ca != cb], w[ca != cb])
    _, first, of = np.unique(of, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return nodes, rank[of] if len(of) else of


def run_all(rows: pd.DataFrame) -> pd.DataFrame:
    nodes, community = labels(*(rows[c].to_numpy() for c in ("a", "b", "weight")))
    return pd.DataFrame({"node": nodes.astype("int64"), "community": community.astype("int32")})


def run_part(key, rows: pd.DataFrame) -> pd.DataFrame:
    out = run_all(rows)
    out.insert(0, "part", str(key[0]))
    return out
