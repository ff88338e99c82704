"""A generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations


class SuffixAutomaton:
    """States hold classes of substrings with equal end positions; at most two states a symbol.

    ``edges[v]`` maps a symbol to the next state, ``link[v]`` is the state of the longest suffix in another class
    (-1 at the root) and ``length[v]`` is the length of the longest string of the class.
    """

    def __init__(self):
        self.edges: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _copy(self, v: int, length: int) -> int:
        self.edges.append(self.edges[v].copy())
        self.link.append(self.link[v])
        self.length.append(length)
        return len(self.link) - 1

    def _redirect(self, v: int, symbol, old: int, new: int) -> None:
        while v >= 0 and self.edges[v].get(symbol) == old:
            self.edges[v][symbol] = new
            v = self.link[v]

    def extend(self, last: int, symbol) -> int:
        """Appends a symbol after the string that ends in state ``last`` (0 at the start of a sequence)."""
        edges, link, length = self.edges, self.link, self.length
        there = edges[last].get(symbol)
        if there is not None:
            if length[there] == length[last] + 1:
                return there
            clone = self._copy(there, length[last] + 1)
            link[there] = clone
            self._redirect(last, symbol, there, clone)
            return clone
        edges.append({})
        link.append(0)
        length.append(length[last] + 1)
        new, v = len(link) - 1, last
        while v >= 0 and symbol not in edges[v]:
            edges[v][symbol] = new
            v = link[v]
        if v >= 0:
            there = edges[v][symbol]
            if length[there] == length[v] + 1:
                link[new] = there
            else:
                clone = self._copy(there, length[v] + 1)
                link[there] = link[new] = clone
                self._redirect(v, symbol, there, clone)
        return new

    def add(self, symbols) -> None:
        last = 0
        for symbol in symbols:
            last = self.extend(last, symbol)

    def step(self, v: int, matched: int, symbol) -> tuple[int, int]:
        """The matching statistic after one more symbol: state and length of the longest suffix that occurs."""
        edges = self.edges
        while v and symbol not in edges[v]:
            v = self.link[v]
            matched = self.length[v]
        there = edges[v].get(symbol)
        return (0, 0) if there is None else (there, matched + 1)

    def at_length(self, v: int, n: int) -> int:
        """The state of the suffix of length n of the strings in state v."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v
