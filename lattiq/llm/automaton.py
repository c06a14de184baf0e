"""Suffix automata over sequences of words, with the place of each substring's first occurrence."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Generalised automaton of texts that are added in order; ``first`` of a state is the end
    of the first occurrence, so the earliest added text wins."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last = 0

    def add(self, words: Sequence, at: int) -> None:
        """Add a text whose word ``i`` is at position ``at + i`` of the reference."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for i, w in enumerate(words):
            q = nxt[last].get(w)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._split(last, q, w)
                continue
            cur = len(nxt)
            nxt.append({}), length.append(length[last] + 1), first.append(at + i), link.append(0)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
            last = cur

    def _split(self, p: int, q: int, w) -> int:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        clone = len(nxt)
        nxt.append(dict(nxt[q])), length.append(length[p] + 1), first.append(first[q]), link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def matching(self, words: Sequence, least: int) -> list[int]:
        """Matching statistics of a text: for each word, where the first occurrence of the
        ``least`` words up to it ends in the reference, or -1 if they do not occur there."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            if n >= least:
                while length[link[state]] >= least:  # the state of the last ``least`` words
                    state = link[state]
                    n = length[state]
                out.append(first[state])
            else:
                out.append(-1)
        return out
