"""Probabilistic automata learned from labelled strings by merging prefix-tree states.

The strings' prefix tree counts how often each state is passed, left by a symbol and ended in. States
are visited breadth first; a state joins the accepted state it agrees with best if no pair of states
reached by equal continuations differs by more than a Hoeffding bound in its ending or in any symbol,
and is accepted as a new state otherwise."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field

#: Symbols of a credential: hexadecimal and other letters of both cases, digits; the rest stand for themselves.
_CLASSES = str.maketrans({**dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"), **dict.fromkeys("ABCDEF", "H"),
                          **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "L"), **dict.fromkeys("0123456789", "d")})
_UNSEEN = math.log(1e-4)


def symbols(value: str) -> str:
    return value.translate(_CLASSES)


@dataclass
class State:
    passed: int = 0
    ended: int = 0
    taken: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)


class Automaton:
    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.states = [State()]
        for value in strings:
            at = self.states[0]
            at.passed += 1
            for c in symbols(value):
                at.taken[c] = at.taken.get(c, 0) + 1
                if c not in at.to:
                    at.to[c] = len(self.states)
                    self.states.append(State())
                at = self.states[at.to[c]]
                at.passed += 1
            at.ended += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.accepted = self._merge()
        self._weigh()

    def _apart(self, a: int, n: int, b: int, m: int) -> float:
        """Difference of two frequencies over its bound; above 1 they are incompatible."""
        return abs(a / n - b / m) / (self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m)))

    def _distance(self, red: int, blue: int) -> float:
        """Largest relative difference of two states and of all states reached alike; infinite if incompatible."""
        worst, todo = 0.0, [(red, blue)]
        while todo:
            r, b = todo.pop()
            x, y = self.states[r], self.states[b]
            if not x.passed or not y.passed:
                continue
            found = self._apart(x.ended, x.passed, y.ended, y.passed)
            for c in x.taken.keys() | y.taken.keys():
                found = max(found, self._apart(x.taken.get(c, 0), x.passed, y.taken.get(c, 0), y.passed))
            if found > 1:
                return math.inf
            worst = max(worst, found)
            # The blue side is a tree, so this ends even where the red side has cycles.
            todo += [(x.to[c], t) for c, t in y.to.items() if c in x.to]
        return worst

    def _fold(self, red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            r, b = todo.pop()
            x, y = self.states[r], self.states[b]
            x.passed += y.passed
            x.ended += y.ended
            for c, n in y.taken.items():
                x.taken[c] = x.taken.get(c, 0) + n
            for c, t in y.to.items():
                if c in x.to:
                    todo.append((x.to[c], t))
                else:
                    x.to[c] = t

    def _merge(self) -> list[int]:
        red, seen = [0], {0}
        blue = deque(((0, c) for c in sorted(self.states[0].to)))
        while blue:
            parent, c = blue.popleft()
            at = self.states[parent].to[c]
            if at in seen:
                continue
            distance, best = min((self._distance(r, at), r) for r in red)
            if distance <= 1:
                self.states[parent].to[c] = best
                self._fold(best, at)
                blue.extend((r, s) for r in red for s in sorted(self.states[r].to) if self.states[r].to[s] not in seen and (r, s) not in blue)
            else:
                red.append(at)
                seen.add(at)
                blue.extend((at, s) for s in sorted(self.states[at].to))
        return red

    def _weigh(self) -> None:
        """Smoothed log probabilities of the accepted states, numbered from 0."""
        number = {s: k for k, s in enumerate(self.accepted)}
        self.step: list[dict[str, tuple[int, float]]] = []
        self.end: list[float] = []
        for s in self.accepted:
            state = self.states[s]
            total = state.passed + 0.5 * (len(state.taken) + 1)
            self.step.append({c: (number[t], math.log((state.taken.get(c, 0) + 0.5) / total)) for c, t in state.to.items()})
            self.end.append(math.log((state.ended + 0.5) / total))
        del self.states

    def log_likelihood(self, value: str) -> float:
        """Log probability of a string; a symbol never seen in a state costs a fixed amount and leads to the start."""
        at, total = 0, 0.0
        for c in symbols(value):
            at, cost = self.step[at].get(c, (0, _UNSEEN))
            total += cost
        return total + self.end[at]
