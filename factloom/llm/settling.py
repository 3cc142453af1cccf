"""Merge-and-rematch over the profiles of one block, in a task.

A block is closed: no spelling of its profiles may be of one with a spelling of
another block. So what happens in it depends on no other block, and the steps that
``resolution.Matching`` takes over all profiles at once give the same result when
each block takes them by itself. A few plans then serve any number of rounds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd

from factloom.llm import spelling

#: Spelling pairs whose judgement a task keeps.
KEPT = 200_000


def judge(kind: str, lists: spelling.Lists) -> Callable[[list[str], list[str]], int]:
    """What two profiles' spellings say together: as the rule for two spellings, where one that says no decides."""
    same = (lambda f, g: spelling.same_person(f, g, lists)) if kind == "person" else spelling.same_body
    known: dict[tuple[str, str], int] = {}

    def run(fa: list[str], fb: list[str]) -> int:
        best = 0
        for x in fa:
            for y in fb:
                k = known.get((x, y))
                if k is None:
                    if len(known) > KEPT:
                        known.clear()
                    k = known[x, y] = same(x, y)
                if k < 0:
                    return -1
                best = max(best, k)
        return best

    return run


def full(forms: list[str]) -> bool:
    """Whether a person's spellings have a full given name."""
    return any(len(x.split("|")[1].split(" ")[0]) > 1 for x in forms)


class Block:
    """Profiles {cid: (scopes, forms)} of a block while they are merged; ``into`` has where each ended."""

    def __init__(self, profiles: dict[str, tuple[set[str], list[str]]], kind: str, said: Callable[[list[str], list[str]], int], most_rounds: int):
        self.profiles, self.person, self.said, self.most_rounds = profiles, kind == "person", said, most_rounds
        self.into = {c: c for c in profiles}
        self.fresh = set(profiles)
        self.judged: dict[tuple[str, str], int] = {}
        self.full = {c: full(forms) for c, (_, forms) in profiles.items()} if self.person else {}

    def _judge(self, pairs: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        return {(a, b): k for a, b in pairs if (k := self.said(self.profiles[a][1], self.profiles[b][1])) > 0}

    def compare(self) -> None:
        by = defaultdict(list)
        for c, (scopes, _) in self.profiles.items():
            for s in scopes:
                by[s].append(c)
        pairs = {(min(c, d), max(c, d)) for c in self.fresh for s in self.profiles[c][0] for d in by[s] if c != d}
        self.judged = {(a, b): k for (a, b), k in self.judged.items() if a in self.profiles and b in self.profiles and a not in self.fresh and b not in self.fresh} | self._judge(pairs)

    def merge(self, edges: list[tuple[str, str]]) -> None:
        up: dict[str, str] = {}

        def top(c: str) -> str:
            while up.setdefault(c, c) != c:
                up[c] = c = up[up[c]]
            return c

        for a, b in edges:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
        groups = defaultdict(list)
        for c in list(up):
            groups[top(c)].append(c)
        self.fresh = set(groups)
        for first, members in groups.items():
            parts = [self.profiles.pop(c) for c in members]
            self.profiles[first] = set().union(*(s for s, _ in parts)), sorted({x for _, forms in parts for x in forms})
            if self.person:
                self.full[first] = any(self.full[c] for c in members)
        self.into = {c: top(t) if t in up else t for c, t in self.into.items()}

    def _weak(self, judged: dict[tuple[str, str], int]) -> list[tuple[str, str]]:
        """Edges of profiles with initials only: to the one full profile that fits, or among themselves where none does."""
        ends = defaultdict(list)
        for (a, b), k in judged.items():
            if k == 1:
                for x, y in ((a, b), (b, a)):
                    if not self.full[x]:
                        ends[x].append(y)
        fits = {x: [y for y in ys if self.full[y]] for x, ys in ends.items()}
        return [(x, ys[0]) for x, ys in fits.items() if len(ys) == 1] + [(x, y) for x, ys in ends.items() if not fits[x] for y in ys if y in fits and not fits[y]]

    def within_scopes(self) -> None:
        for _ in range(self.most_rounds):
            self.compare()
            edges = [ab for ab, k in self.judged.items() if k == 2]
            if not edges and self.person:
                edges = self._weak(self.judged)
            if not edges:
                self.fresh = set()
                return
            self.merge(edges)
        raise RuntimeError("resolution: still merging after the last round")

    def across_scopes(self) -> bool:
        """Join profiles without a scope to the one profile of any scope that fits them best, and to one another; whether any joined."""
        loose = {c for c, (scopes, _) in self.profiles.items() if not scopes}
        judged = self._judge({(min(c, d), max(c, d)) for c in loose for d in self.profiles if c != d})
        scoped = defaultdict(list)
        for (a, b), k in judged.items():
            for x, y in ((a, b), (b, a)):
                if x in loose and y not in loose:
                    scoped[x].append((k, y))
        edges = []
        for x, ends in scoped.items():
            best = max(k for k, _ in ends)
            fit = [y for k, y in ends if k == best]
            edges += [(x, fit[0])] * (len(fit) == 1)
        alone = {(a, b): k for (a, b), k in judged.items() if a in loose and b in loose and a not in scoped and b not in scoped}
        edges += [ab for ab, k in alone.items() if k == 2] + self._weak(alone)
        if edges:
            self.merge(edges)
        return bool(edges)

    def run(self) -> dict[str, str]:
        """{cid: the cid it ends in}."""
        self.within_scopes()
        if self.person:
            for _ in range(self.most_rounds):
                if not self.across_scopes():
                    return self.into
                self.within_scopes()
            raise RuntimeError("resolution: still merging after the last round")
        return self.into


def settled(kind: str, lists: spelling.Lists, most_rounds: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(block, cid, scopes, forms), the rows of a block one after another -> (cid, into) of the profiles that are merged into another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said = judge(kind, lists)
        at, held = None, {}

        def moved() -> list[tuple[str, str]]:
            return [(c, t) for c, t in Block(held, kind, said, most_rounds).run().items() if c != t] if len(held) > 1 else []

        for f in frames:
            out = []
            for block, cid, scopes, forms in zip(f["block"], f["cid"], f["scopes"], f["forms"]):
                if block != at:
                    out += moved()
                    at, held = block, {}
                held[cid] = set(scopes), list(forms)
            yield pd.DataFrame(out, columns=["cid", "into"], dtype="object")
        yield pd.DataFrame(moved(), columns=["cid", "into"], dtype="object")

    return run
