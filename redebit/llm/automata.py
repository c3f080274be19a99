"""Probabilistic automata learned from example strings by merging prefix-tree states.

The prefix tree of the examples is folded state by state: an undecided state joins a settled
one when, by Hoeffding bounds, their stopping and branching frequencies agree and so do those
of all states behind them; otherwise it is settled itself. What remains is a deterministic
automaton whose transition frequencies give every string a likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

#: Character classes with their sizes; a symbol outside them stands for itself.
CLASSES = (("0123456789", "d"), ("abcdef", "x"), ("ghijklmnopqrstuvwxyz", "l"), ("ABCDEF", "X"), ("GHIJKLMNOPQRSTUVWXYZ", "L"))
CLASS_OF = {c: name for chars, name in CLASSES for c in chars}
SIZE = {name: len(chars) for chars, name in CLASSES}
#: Symbols that a state can emit besides the classes: `+/_.=-`.
SYMBOLS = len(CLASSES) + 6


class Automaton:
    """States as dicts of [count, next state] by symbol; ``arrivals`` and ``stops`` per state."""

    def __init__(self) -> None:
        self.moves: list[dict[str, list[int]]] = [{}]
        self.arrivals: list[int] = [0]
        self.stops: list[int] = [0]

    def add(self, text: str) -> None:
        state = 0
        self.arrivals[0] += 1
        for c in text:
            symbol = CLASS_OF.get(c, c)
            move = self.moves[state].get(symbol)
            if move is None:
                self.moves.append({})
                self.arrivals.append(0)
                self.stops.append(0)
                move = self.moves[state][symbol] = [0, len(self.moves) - 1]
            move[0] += 1
            state = move[1]
            self.arrivals[state] += 1
        self.stops[state] += 1

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether the frequencies of two states, and of all behind them, may be the same."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n, m = self.arrivals[a], self.arrivals[b]
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.stops[a] / n - self.stops[b] / m) > bound:
                return False
            for symbol in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(symbol), self.moves[b].get(symbol)
                if abs((x[0] if x else 0) / n - (y[0] if y else 0) / m) > bound:
                    return False
                if x and y:
                    waiting.append((x[1], y[1]))
        return True

    def fold(self, into: int, gone: int) -> None:
        """Add the subtree at ``gone`` to the automaton at ``into``."""
        waiting = [(into, gone)]
        while waiting:
            into, gone = waiting.pop()
            self.arrivals[into] += self.arrivals[gone]
            self.stops[into] += self.stops[gone]
            for symbol, (count, there) in self.moves[gone].items():
                move = self.moves[into].get(symbol)
                if move is None:
                    self.moves[into][symbol] = [count, there]
                else:
                    move[0] += count
                    waiting.append((move[1], there))

    def scorer(self, floor: float = 0.5) -> Scorer:
        """Smoothed log probabilities of the settled states."""
        number: dict[int, int] = {0: 0}
        order = [0]
        for state in order:
            for _, there in self.moves[state].values():
                if there not in number:
                    number[there] = len(order)
                    order.append(there)
        table = []
        for state in order:
            total = self.arrivals[state] + floor * (SYMBOLS + 1)
            row = {
                s: (math.log((count + floor) / total) - math.log(SIZE.get(s, 1)), number[there])
                for s, (count, there) in self.moves[state].items()
            }
            table.append((row, math.log(floor / total), math.log((self.stops[state] + floor) / total)))
        return Scorer(table)


class Scorer:
    """Log likelihood of strings under an automaton; small enough to travel with a task."""

    def __init__(self, table: list):
        self.table = table

    def __call__(self, text: str) -> float:
        """Mean log likelihood per character, the stop included."""
        state, total = 0, 0.0
        for c in text:
            symbol = CLASS_OF.get(c, c)
            row, unseen, _ = self.table[state]
            known = row.get(symbol)
            if known is None:  # the state stays; the symbol has the smoothing mass
                total += unseen - math.log(SIZE.get(symbol, 1))
            else:
                total += known[0]
                state = known[1]
        return (total + self.table[state][2]) / (len(text) + 1)


def learn(examples: Iterable[str], alpha: float = 0.05) -> Automaton:
    """Fold the prefix tree of ``examples``; undecided states are tried nearest to the root first."""
    own = Automaton()
    for text in sorted(examples):
        own.add(text)
    settled, known = [0], {0}
    while True:
        move = next(
            (m for state in settled for _, m in sorted(own.moves[state].items()) if m[1] not in known), None
        )
        if move is None:
            return own
        there = move[1]
        like = next((s for s in settled if own.alike(s, there, alpha)), None)
        if like is None:
            settled.append(there)
            known.add(there)
        else:
            move[1] = like
            own.fold(like, there)
