"""Minimised acyclic acceptors, and their composition with a one-edit transducer."""

from __future__ import annotations

from collections.abc import Iterator


class Acceptor:
    """Minimal acceptors of several sorted word lists over one set of states, so equal right languages are one state.

    ``arcs[s]`` maps a symbol to the next state; ``final[s]``: a word may end there. State 0 has no arcs and is final.
    """

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final: list[bool] = [True]
        self._known: dict[tuple, int] = {(True,): 0}

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return found

    def add(self, words: list[str], skip: int = 0) -> int:
        """The start state of an acceptor of ``words`` (sorted, distinct) without their first ``skip`` symbols.

        Words come in order, so only the states on the last word's path are open; a state is looked up among the known ones
        once no later word can reach it.
        """
        path: list[tuple[dict[str, int], bool]] = [({}, False)]  # open states by depth
        last = ""
        for whole in words:
            word = whole[skip:]
            shared, most = 0, min(len(last), len(word))
            while shared < most and last[shared] == word[shared]:
                shared += 1
            self._close(path, last, shared)
            path.extend(({}, False) for _ in range(len(word) - shared))
            path[-1] = (path[-1][0], True)
            last = word
        self._close(path, last, 0)
        return self._state(path[0][1], path[0][0])

    def _close(self, path: list, last: str, depth: int) -> None:
        for at in range(len(path) - 1, depth, -1):
            arcs, final = path.pop()
            path[at - 1][0][last[at - 1]] = self._state(final, arcs)


def spelled(cell) -> str:
    """The string of a chain of (chain before, symbol)."""
    out = []
    while cell is not None:
        cell, symbol = cell
        out.append(symbol)
    return "".join(reversed(out))


class OneEdit:
    """Pairs that a composition acceptor, one edit, acceptor accepts.

    The transducer has two states: before the edit it copies, or takes the edit's arc (another symbol, or one symbol more on
    the right); after it, it only copies and accepts. A state of the composition is (left state, before or after, right state). What
    can follow an edit depends on the two acceptor states alone and is looked up where it comes again.
    """

    def __init__(self, acceptor: Acceptor) -> None:
        self.a = acceptor
        self._common: dict[tuple[int, int], list[str]] = {}

    def common(self, left: int, right: int) -> list[str]:
        """What both states accept: the composition after the edit."""
        found = self._common.get((left, right))
        if found is not None:
            return found
        arcs, final, found, stack = self.a.arcs, self.a.final, [], [(left, right, None)]
        while stack:
            p, q, y = stack.pop()
            if final[p] and final[q]:
                found.append(spelled(y))
            other = arcs[q]
            for c, s in arcs[p].items():
                t = other.get(c)
                if t is not None:
                    stack.append((s, t, (y, c)))
        self._common[(left, right)] = found
        return found

    def replaced(self, start: int) -> Iterator[tuple[str, str]]:
        """Pairs of words from ``start`` that differ in one symbol, the smaller first."""
        arcs, stack = self.a.arcs, [(start, None)]
        while stack:
            p, x = stack.pop()
            here = list(arcs[p].items())
            for i, (c, s) in enumerate(here):
                stack.append((s, (x, c)))
                for d, t in here[i + 1 :]:
                    for y in self.common(s, t):
                        head = spelled(x)
                        yield (head + c + y, head + d + y) if c < d else (head + d + y, head + c + y)

    def inserted(self, short: int, long: int) -> Iterator[tuple[str, str]]:
        """Pairs (u, v): u from ``short``, v from ``long`` with one symbol more. The edit is at the end of their longest common beginning, so each pair comes once."""
        arcs, stack = self.a.arcs, [(short, long, None)]
        while stack:
            p, q, x = stack.pop()
            other = arcs[q]
            for c, s in arcs[p].items():
                t = other.get(c)
                if t is not None:
                    stack.append((s, t, (x, c)))
            for d, t in other.items():
                for y in self.common(p, t):
                    if not y.startswith(d):
                        head = spelled(x)
                        yield head + y, head + d + y
