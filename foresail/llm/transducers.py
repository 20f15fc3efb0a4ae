"""Deterministic finite-state transducers with weights: composition and a table to run them by.

A rule is (state, symbol) -> (next state, output, weight). A symbol without a rule in a state passes
unchanged, at no weight, and the state stays. Weights add up along a path."""

from __future__ import annotations

from collections.abc import Hashable, Iterable
from dataclasses import dataclass

State = Hashable


@dataclass(frozen=True)
class Transducer:
    start: State
    rules: dict[tuple[State, str], tuple[State, str, float]]

    def step(self, state: State, symbol: str) -> tuple[State, str, float]:
        return self.rules.get((state, symbol), (state, symbol, 0.0))


def compose(first: Transducer, second: Transducer, symbols: Iterable[str]) -> Transducer:
    """The transducer that hands the output of ``first`` to ``second``, over the states reached by ``symbols``."""
    symbols = tuple(symbols)
    start = (first.start, second.start)
    rules, waiting, seen = {}, [start], {start}
    while waiting:
        a, b = state = waiting.pop()
        for symbol in symbols:
            a2, middle, u = first.step(a, symbol)
            b2, output, v = second.step(b, middle)
            target = (a2, b2)
            rules[state, symbol] = (target, output, u + v)
            if target not in seen:
                seen.add(target)
                waiting.append(target)
    return Transducer(start, rules)


def tabulate(machine: Transducer, symbols: list[str], outputs: list[str]) -> tuple[list[list[int]], list[list[int]]]:
    """(next, emitted): by state number and symbol number, the next state and the output's number, -1 for outputs not asked for."""
    numbers, states = {machine.start: 0}, [machine.start]
    following, emitted = [], []
    for state in states:
        steps = [machine.step(state, s) for s in symbols]
        for target, _, _ in steps:
            if target not in numbers:
                numbers[target] = len(states)
                states.append(target)
        following.append([numbers[t] for t, _, _ in steps])
        emitted.append([outputs.index(o) if o in outputs else -1 for _, o, _ in steps])
    return following, emitted
