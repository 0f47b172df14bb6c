"""Generalised suffix automaton over token sequences, with the smallest document of each state."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Sequence


class SuffixAutomaton:
    """Every state stands for the token sequences that end at one set of places; ``owner`` is the smallest document there.

    Add the reference sequences with ``add``, call ``finish`` once, then stream sequences through ``owners``.
    """

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, edges: dict, link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(None)
        return len(self.next) - 1

    def _split(self, p: int, token: Hashable, q: int) -> int:
        """The state for the sequences of q that are no longer than those of p with the token."""
        c = self._state(self.next[q].copy(), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, tokens: Iterable[Hashable], document: int) -> None:
        nxt, link, length, owner = self.next, self.link, self.length, self.owner
        last = 0
        for t in tokens:
            q = nxt[last].get(t)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, t, q)
            else:
                p, cur = last, self._state({}, 0, length[last] + 1)
                while p >= 0 and t not in nxt[p]:
                    nxt[p][t] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][t]
                    link[cur] = q if length[q] == length[p] + 1 else self._split(p, t, q)
                last = cur
            if owner[last] is None or document < owner[last]:
                owner[last] = document

    def finish(self) -> SuffixAutomaton:
        """Give each state the smallest document of all places where its sequences end."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[s], self.owner[s]
            if up > 0 and own is not None and (self.owner[up] is None or own < self.owner[up]):
                self.owner[up] = own
        return self

    def matching(self, tokens: Iterable[Hashable]) -> list[int]:
        """Matching statistics: at each place, the length of the longest reference substring that ends there."""
        out, s, n = [], 0, 0
        for t in tokens:
            while s and t not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if t in self.next[s]:
                s, n = self.next[s][t], n + 1
            else:
                s, n = 0, 0
            out.append(n)
        return out

    def owners(self, tokens: Sequence[Hashable], span: int) -> list[int | None]:
        """For each window of ``span`` tokens, the smallest document with that window, None if there is none.

        The matching statistics are followed with their length held at ``span``: a window occurs in the reference where the
        matched length reaches it, and the state then stands for the window itself.
        """
        nxt, link, length, owner = self.next, self.link, self.length, self.owner
        out: list[int | None] = []
        s = n = 0
        for i, t in enumerate(tokens):
            while s and t not in nxt[s]:
                s = link[s]
                n = length[s]
            if t in nxt[s]:
                s, n = nxt[s][t], n + 1
            else:
                s, n = 0, 0
            if n >= span:
                while length[link[s]] >= span:
                    s = link[s]
                n = span
            if i >= span - 1:
                out.append(owner[s] if n >= span else None)
        return out
