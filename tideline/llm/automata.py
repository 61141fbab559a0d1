"""Probabilistic automata inferred from examples by merging statistically compatible states of their prefix tree."""

from __future__ import annotations

import math
from collections import defaultdict

END = "$"


def symbol(c: str) -> str:
    """Letters and digits by class, so that an automaton tells formats and not examples; other characters stay."""
    if "0" <= c <= "9":
        return "9"
    if "a" <= c <= "f":
        return "f"
    if "a" <= c <= "z":
        return "z"
    if "A" <= c <= "Z":
        return "A"
    return c


class Automaton:
    """A probabilistic automaton: states with counts of their symbols and ends."""

    def __init__(self, examples: list[str], alpha: float = 0.05, least: int = 8):
        self.alpha, self.least = alpha, least
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        for example in sorted(examples):
            at = 0
            for s in [*map(symbol, example), END]:
                self.count[at][s] += 1
                if s == END:
                    break
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                at = self.next[at][s]
        self._infer()

    def _total(self, q: int) -> int:
        return sum(self.count[q].values())

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        """Whether two shares differ by more than the Hoeffding bound lets chance explain."""
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _compatible(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            n, m = self._total(p), self._total(q)
            if not n or not m or p == q:
                continue
            for s in self.count[p].keys() | self.count[q].keys():
                if self._differ(self.count[p].get(s, 0), n, self.count[q].get(s, 0), m):
                    return False
            if min(n, m) >= self.least:
                stack.extend((self.next[p][s], self.next[q][s]) for s in self.next[p].keys() & self.next[q].keys())
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the subtree of b to a; b is the root of a tree that nothing else leads into."""
        stack = [(a, b)]
        while stack:
            p, q = stack.pop()
            for s, c in self.count[q].items():
                self.count[p][s] += c
            for s, r in self.next[q].items():
                if s in self.next[p]:
                    stack.append((self.next[p][s], r))
                else:
                    self.next[p][s] = r

    def _infer(self) -> None:
        red = [0]
        while True:
            edges = [(q, s, r) for q in red for s, r in sorted(self.next[q].items()) if r not in red]
            if not edges:
                break
            q, s, blue = max(edges, key=lambda e: (self._total(e[2]), -e[0], e[1]))
            for other in red:
                if self._compatible(other, blue):
                    self.next[q][s] = other
                    self._fold(other, blue)
                    break
            else:
                red.append(blue)
        self.states = red

    def score(self, text: str) -> float:
        """Mean log likelihood of a symbol; what no example showed counts a half of one in each state's total and one."""
        total, at = 0.0, 0
        parts = [*map(symbol, text), END]
        for s in parts:
            n = self._total(at) if at is not None else 0
            total += math.log((self.count[at].get(s, 0) or 0.5) / (n + 1)) if at is not None else math.log(1e-3)
            at = self.next[at].get(s) if at is not None and s != END else at
        return total / len(parts)
