"""Dictionary of basic factors: names of all substrings whose length is a power of two.

Equal names stand for equal factors. A position whose factor occurs once carries a name of its own, and
only repeated factors are named at the next length, so the dictionary ends with the longest repeat."""

from __future__ import annotations

import numpy as np

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _name(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(names of all positions, the positions whose key occurs twice or more)."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = counts[inverse] > 1
    names = -1 - np.arange(size, dtype=np.int32)
    active = places[repeated]
    names[active] = inverse[repeated]
    return names, active


def basic_factors(symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length 1, 2, 4, ...: names of the factors that start at each position, positions of repeated ones.

    ``symbols`` are whole numbers from 0, the first and the last of which occur once: no equal factors
    then reach an end."""
    size = len(symbols)
    levels = [_name(symbols, np.arange(size), size)]
    while len(levels[-1][1]):
        names, active = levels[-1]
        half = 1 << (len(levels) - 1)
        inside = active[active < size - half]
        places = inside[names[inside + half] >= 0]
        keys = names[places].astype(np.int64) << 32 | names[places + half]
        levels.append(_name(keys, places, size))
    return levels[:-1]


def _proposals(names: np.ndarray, active: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) with equal factors of ``length`` at the position and a period further on.

    Occurrences of a factor at most half its length apart follow each other by its period: they are one
    arithmetic progression. A square of period p, length <= p < 2 * length, has the factor it starts with
    again p later, at most three progressions on. Either the stretches of the factor's own period end
    alike in both, so the progressions' last members are p apart, or the first stretch fills the whole
    period, and p leads from one of its members to the first member of the later progression."""
    order = np.argsort(names[active], kind="stable")
    at, name = active[order], names[active][order]
    chained = (name[1:] == name[:-1]) & (2 * (at[1:] - at[:-1]) <= length)
    first = np.flatnonzero(np.r_[True, ~chained])
    last = np.r_[first[1:], len(at)] - 1
    of = np.cumsum(np.r_[0, ~chained])
    found = []
    for step in (1, 2, 3):
        heads = np.r_[first[step:], np.full(min(step, len(first)), -1)]
        tails = np.r_[last[step:], np.full(min(step, len(last)), -1)]
        for source, target in ((np.arange(len(at)), heads[of]), (last, tails)):
            period = np.where((target >= 0) & (name[target] == name[source]), at[target] - at[source], 0)
            fits = (period >= length) & (period < 2 * length)
            found.append((at[source][fits], period[fits]))
    place, period = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    # Neighbours of one period lie in one stretch: the first of them stands for all.
    fresh = np.r_[True, (period[1:] != period[:-1]) | (place[1:] - place[:-1] > 1)][:len(place)]
    return place[fresh], period[fresh]


def _extend(levels: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the symbols before, and from, two positions agree."""
    start, a, b = left.copy(), left.copy(), right.copy()
    c = right.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k][0], 1 << k
        same = names[a] == names[b]
        a[same] += step
        b[same] += step
        back = (start >= step) & (names[start - step] == names[c - step])
        start[back] -= step
        c[back] -= step
    return left - start, a - left


def maximal_runs(symbols: np.ndarray, shortest: int = 2) -> Runs:
    """(start, length, smallest period) of every maximal run of two periods and ``shortest`` symbols or more.

    ``symbols`` as for ``basic_factors``; ascending by start, then period."""
    levels = basic_factors(symbols)
    parts = []
    for k, (names, active) in enumerate(levels):
        place, period = _proposals(names, active, 1 << k)
        before, after = _extend(levels, place, place + period)
        length = before + after + period
        long = length >= np.maximum(shortest, 2 * period)
        parts.append((place[long] - before[long], length[long], period[long]))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
    # A stretch is proposed with multiples of its period too: the smallest one is the run's.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(start)]
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]
