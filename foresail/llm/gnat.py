"""Geometric near-neighbour access tree: exact nearest entries in whole-number coordinates.

Every node keeps, for each split point and each other split's subtree, the range of their distances. A
query's distance to one split point rules out the subtrees whose range is farther away than the best entry
so far. Distances in ranges are square roots rounded outwards to whole numbers and a subtree goes only if
its bound is greater than the radius, so an entry as near as the best is never lost; entries are compared
by their exact squared distance, ties by index."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

#: Split points of a node.
DEGREE = 4


def is_wide(largest: int, width: int) -> bool:
    """Whether squared distances between vectors of such components may not fit 64 bits."""
    return 4 * largest * largest * max(width, 1) >= 1 << 62


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    gap = rows - point
    return (gap * gap).sum(axis=1)


def _outward_roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers at most and at least the roots; object arrays hold numbers of any size."""
    if squares.dtype == object:
        low = np.array([math.isqrt(int(s)) for s in squares], object)
        return low, low + 1
    root = np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64)
    return np.maximum(root - 1, 0), root + 2


@dataclass
class _Node:
    splits: list[int]
    children: list[_Node | None] = field(default_factory=list)
    #: low[i][j], high[i][j]: distances from split i to split j and what is below it (j = i: below it only).
    low: list[list] = field(default_factory=list)
    high: list[list] = field(default_factory=list)


class Gnat:
    """Index of the rows of ``entries``, an integer or object matrix."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._build(list(range(len(entries))))

    def _build(self, members: list[int]) -> _Node | None:
        if not members:
            return None
        splits = [members[0]]
        nearest = squared(self.entries[members], self.entries[splits[0]])
        reached = [0] * len(members)
        while len(splits) < min(DEGREE, len(members)):
            rest = [k for k, m in enumerate(members) if m not in splits]
            k = max(rest, key=lambda r: (nearest[r], -members[r]))  # the one farthest from the splits so far
            splits.append(members[k])
            gap = squared(self.entries[members], self.entries[members[k]])
            for r in range(len(members)):
                if gap[r] < nearest[r]:
                    nearest[r], reached[r] = gap[r], len(splits) - 1
        below = [[m for k, m in enumerate(members) if reached[k] == j and m not in splits] for j in range(len(splits))]
        node = _Node(splits, [self._build(b) for b in below])
        for i, s in enumerate(splits):
            node.low.append([None] * len(splits))
            node.high.append([None] * len(splits))
            for j, b in enumerate(below):
                near = b if i == j else [splits[j], *b]
                if near:
                    low, high = _outward_roots(squared(self.entries[near], self.entries[s]))
                    node.low[i][j], node.high[i][j] = low.min(), high.max()
        return node

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of every row's nearest entry; equal distances go to the smaller index."""
        best = np.full(len(rows), -1, np.int64)
        # An unset distance is replaced before it is compared: the root's first split is met by every row.
        distance = np.zeros(len(rows), rows.dtype)
        radius = np.zeros(len(rows), rows.dtype)
        self._visit(self.root, rows, np.arange(len(rows)), best, distance, radius)
        return best, distance

    def _visit(self, node: _Node, rows: np.ndarray, at: np.ndarray, best: np.ndarray, distance: np.ndarray, radius: np.ndarray) -> None:
        alive = np.ones((len(at), len(node.splits)), bool)
        for i, split in enumerate(node.splits):
            live = np.flatnonzero(alive[:, i])
            if not len(live):
                continue
            who = at[live]
            found = squared(rows[who], self.entries[split])
            low, high = _outward_roots(found)
            better = (best[who] < 0) | (found < distance[who]) | ((found == distance[who]) & (split < best[who]))
            moved = who[better.astype(bool)]
            best[moved] = split
            distance[moved] = found[better.astype(bool)]
            radius[moved] = high[better.astype(bool)]
            for j in range(len(node.splits)):
                if node.high[i][j] is not None:
                    far = (low - node.high[i][j] > radius[who]) | (node.low[i][j] - high > radius[who])
                    alive[live[far.astype(bool)], j] = False
        for j, child in enumerate(node.children):
            if child is not None:
                live = at[alive[:, j]]
                if len(live):
                    self._visit(child, rows, live, best, distance, radius)
