"""Closed loops of directed edges, in whole arrays."""

from __future__ import annotations

import numpy as np


def successors(start: np.ndarray, end: np.ndarray, left: bool, group: np.ndarray | None = None) -> np.ndarray:
    """For each edge (rows of integer x, y) the edge of its group that goes on from its end.

    Where several do, the one furthest to the left (or right) as seen with y down; never straight back unless alone."""
    both = np.concatenate([start, end])
    columns = [both[:, 0], both[:, 1], *([] if group is None else [np.tile(group, 2)])]
    by, vertex = np.lexsort(columns), np.empty(len(both), np.int64)
    new = np.zeros(len(both), bool)
    for c in columns:
        new[1:] |= np.diff(c[by]) != 0
    vertex[by] = np.cumsum(new)
    begins, ends = np.split(vertex, 2)
    order = np.argsort(begins, kind="stable")
    first, last = (np.searchsorted(begins[order], ends, side=s) for s in ("left", "right"))
    if (first == last).any():
        raise ValueError("an edge ends where none begins")
    way = (end - start).astype(float)
    best, best_turn = order[first], np.full(len(order), np.inf)
    for k in range(int((last - first).max(initial=0))):
        at = np.minimum(first + k, last - 1)
        out = way[order[at]]
        turn = np.arctan2(way[:, 0] * out[:, 1] - way[:, 1] * out[:, 0], (way * out).sum(axis=1))  # right turns are positive
        cost = np.where(np.abs(turn) > np.pi - 1e-12, 10.0, turn if left else -turn)
        better = cost < best_turn
        best, best_turn = np.where(better, order[at], best), np.where(better, cost, best_turn)
    if len(np.unique(best)) != len(best):
        raise ValueError("two edges go on into one")
    return best


def loops(start: np.ndarray, end: np.ndarray, left: bool, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges in the order of their loops, and where each loop begins in it. Loops start at their first edge.

    Labels and places settle by doubling steps, in as many rounds as the logarithm of the longest loop."""
    n = len(start)
    if not n:
        return np.zeros(0, int), np.zeros(0, int)
    after = successors(start, end, left, group)
    label, jump = np.arange(n), after
    for _ in range(n.bit_length()):
        low = np.minimum(label, label[jump])
        if (low == label).all():
            break
        label, jump = low, jump[jump]
    before = np.empty(n, int)
    before[after] = np.arange(n)
    head = label == np.arange(n)
    place, jump = np.where(head, 0, 1), np.where(head, np.arange(n), before)
    while not head[jump].all():
        place, jump = place + place[jump], jump[jump]
    order = np.lexsort((place, label))
    return order, np.flatnonzero(np.diff(label[order], prepend=-1))


def corners(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of loops without those where the way does not turn, and where each loop then begins.

    Repeats of a point in a row count once; a loop that goes out and back keeps its ends."""
    ends = np.append(begins[1:], len(points))
    loop = np.repeat(np.arange(len(begins)), ends - begins)

    def neighbours(loop: np.ndarray, step: int) -> np.ndarray:
        first = np.searchsorted(loop, np.arange(len(begins)))
        size = np.bincount(loop, minlength=len(begins))
        return first[loop] + (np.arange(len(loop)) - first[loop] + step) % size[loop]

    new = (points != points[neighbours(loop, -1)]).any(axis=1)
    alone = np.bincount(loop[new], minlength=len(begins)) == 0
    new[begins[alone]] = True
    points, loop = points[new], loop[new]
    a, b = points - points[neighbours(loop, -1)], points[neighbours(loop, 1)] - points
    turns = (np.sign(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) != 0) | ((a * b).sum(axis=1) < 0) | ((a == 0).all(axis=1))
    kept = loop[turns]
    return points[turns], np.searchsorted(kept, np.arange(len(begins)))


def simplify(points: np.ndarray, epsilon: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring (first point not repeated): no point of it is further than epsilon from the result."""
    n = len(points)
    if n < 4 or epsilon <= 0:
        return points
    far = int(((points - points[0]) ** 2).sum(axis=1).argmax())
    closed, keep, open_ = np.vstack([points, points[:1]]), np.zeros(n + 1, bool), [(0, far), (far, n)]
    keep[[0, far, n]] = True
    while open_:
        s, e = open_.pop()
        if e - s < 2:
            continue
        way, inner = closed[e] - closed[s], closed[s + 1 : e] - closed[s]
        along = np.clip(inner @ way / max(way @ way, 1e-300), 0, 1)
        away = np.hypot(*(inner - along[:, None] * way).T)
        k = int(away.argmax())
        if away[k] > epsilon:
            keep[s + 1 + k] = True
            open_ += [(s, s + 1 + k), (s + 1 + k, e)]
    return points[keep[:n]]
