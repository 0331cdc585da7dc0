"""One candidate pedigree of a family: parents by person, and the ways to relate two people in it.

Names of people without data begin with ``?``.  Every step gives new states and
leaves its own as it was.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Degree of each class; a pair that is neither related nor said to be may be distant.
DEGREE = {"PC": 1, "FS": 1, "HAG": 2, "CGH": 3, "DR": 4, "UN": 5}
FAR = frozenset(("DR", "UN"))


class State:
    def __init__(self, parents: dict[str, tuple], sex: dict[str, int]):
        self.parents, self.sex = parents, sex

    def copy(self) -> "State":
        return State(dict(self.parents), dict(self.sex))

    def children(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for child, both in self.parents.items():
            for p in both:
                out.setdefault(p, []).append(child)
        return out

    def ancestors(self, person: str) -> dict[str, int]:
        """Fewest generations to each ancestor."""
        out: dict[str, int] = {}
        layer, depth = [person], 0
        while layer:
            depth += 1
            above = [p for x in layer for p in self.parents.get(x, ()) if p not in out]
            for p in above:
                out[p] = depth
            layer = list(dict.fromkeys(above))
        return out

    # -------------------------------------------------------------- changes
    def with_couple(self, child: str) -> "State":
        """The state in which both of the child's parents have a name."""
        have = self.parents.get(child, ())
        if len(have) == 2:
            return self
        out, k = self.copy(), len(self.sex)
        names = list(have)
        while len(names) < 2:
            while f"?{k}" in out.sex:
                k += 1
            out.sex[f"?{k}"] = 0
            names.append(f"?{k}")
        out.parents[child] = tuple(sorted(names))
        return out

    def choices(self, child: str) -> list[str]:
        """The child's parents; one of two that nothing tells apart."""
        p, q = self.parents[child]
        if p[0] == q[0] == "?" and self.sex[p] == self.sex[q] and p not in self.parents and q not in self.parents:
            kids = self.children()
            if kids[p] == kids[q]:
                return [p]
        return [p, q]

    def merged(self, a: str, b: str) -> list["State"]:
        """Every state in which two names are one person: none, or more where their parents pair up in two ways."""
        if a == b:
            return [self]
        if a[0] != "?":
            a, b = b, a
        if a not in self.sex or b not in self.sex or a[0] != "?" or {self.sex[a], self.sex[b]} == {1, 2}:
            return []
        if a in self.ancestors(b) or b in self.ancestors(a):
            return []
        out = self.copy()
        out.sex[b] = out.sex[b] or out.sex.pop(a)
        out.sex.pop(a, None)
        mine, theirs = out.parents.pop(a, None), out.parents.get(b)
        for child, both in list(out.parents.items()):
            if a in both:
                if b in both:
                    return []
                out.parents[child] = tuple(sorted(b if p == a else p for p in both))
        if not mine:
            return [out]
        if not theirs:
            out.parents[b] = mine
            return [out]
        found = []
        for first, second in ((theirs[0], theirs[1]), (theirs[1], theirs[0])):
            for half in out.merged(mine[0], first):
                found += half.merged(mine[1], second)
        return found

    def with_parent(self, child: str, parent: str) -> list["State"]:
        """Every way to make one person a parent of another (R2)."""
        if parent in self.parents.get(child, ()):
            return [self]
        if parent == child or child in self.ancestors(parent):
            return []
        state = self.with_couple(child)
        return [s for p in state.choices(child) if p[0] == "?" or parent[0] == "?" for s in state.merged(p, parent)]

    def as_sibs(self, a: str, b: str) -> list["State"]:
        """Every way to give two people the same parents."""
        if a == b:
            return []
        state = self.with_couple(a).with_couple(b)
        (p, q), (x, y) = state.parents[a], state.parents[b]
        found = []
        for one, two in ((x, y), (y, x))[: 1 if len(state.choices(a)) == 1 or len(state.choices(b)) == 1 else 2]:
            for half in state.merged(p, one):
                if half.parents[a] == half.parents[b]:
                    found.append(half)
                else:
                    found += half.merged(*(next(iter(set(half.parents[c]) - set(half.parents[d])), "") for c, d in ((a, b), (b, a))))
        return [s for s in found if s.parents[a] == s.parents[b]]

    def as_half_sibs(self, a: str, b: str) -> list["State"]:
        """Every way to let two people share one parent."""
        if a == b:
            return []
        state = self.with_couple(a).with_couple(b)
        return [s for p in state.choices(a) for q in state.choices(b) for s in state.merged(p, q)]

    def related(self, a: str, b: str, rel: str) -> Iterator["State"]:
        """Every way to relate two people as the class says."""
        if rel == "PC":
            yield from self.with_parent(a, b)
            yield from self.with_parent(b, a)
        elif rel == "FS":
            yield from self.as_sibs(a, b)
        elif rel == "HAG":
            yield from self.as_half_sibs(a, b)
            for x, y in ((a, b), (b, a)):
                state = self.with_couple(x)
                for p in state.choices(x):
                    yield from state.with_parent(p, y)  # grandparent
                    yield from state.as_sibs(p, y)  # aunt or uncle
        elif rel == "CGH":
            for x, y in ((a, b), (b, a)):
                state = self.with_couple(x)
                for p in state.choices(x):
                    yield from state.as_half_sibs(p, y)  # half aunt or uncle
                    above = state.with_couple(p)
                    for g in above.choices(p):
                        yield from above.with_parent(g, y)  # great-grandparent
                        yield from above.as_sibs(g, y)  # great-aunt or great-uncle
                    if x == a:
                        wide = state.with_couple(y)
                        for q in wide.choices(y):
                            yield from wide.as_sibs(p, q)  # first cousin

    # ---------------------------------------------------------------- reading
    def relations(self, people: list[str]) -> dict[tuple[str, str], str]:
        """The class of every two of the people that this pedigree relates at all."""
        up = {p: self.ancestors(p) | {p: 0} for p in people}
        out = {}
        for i, a in enumerate(people):
            mine = up[a]
            for b in people[i + 1 :]:
                theirs = up[b]
                common = mine.keys() & theirs.keys()
                if common:
                    ways = [mine[x] + theirs[x] for x in common]
                    least = min(ways)
                    degree = least - (ways.count(least) > 1)
                    out[a, b] = "PC" if least == 1 else {1: "FS", 2: "HAG", 3: "CGH"}.get(degree, "DR")
        return out

    def generations(self) -> int:
        """How many generations the people joined by parents and children span."""
        kids, level = self.children(), {}
        most = 1
        for start in self.sex:
            if start in level:
                continue
            level[start], queue, seen = 0, [start], [start]
            while queue:
                at = queue.pop()
                for step, near in ((-1, self.parents.get(at, ())), (1, kids.get(at, ()))):
                    for x in near:
                        if x not in level:
                            level[x] = level[at] + step
                            queue.append(x)
                            seen.append(x)
            spans = [level[x] for x in seen]
            most = max(most, max(spans) - min(spans) + 1)
        return most

    def possible(self, ages: dict[str, float]) -> bool:
        """Whether sexes, ages and couples can be so; takes over the sexes that follow."""
        couples = [c for c in self.parents.values() if len(c) == 2]
        changed = True
        while changed:
            changed = False
            for p, q in couples:
                if self.sex[p] and self.sex[p] == self.sex[q]:
                    return False
                for x, y in ((p, q), (q, p)):
                    if self.sex[x] and not self.sex[y]:
                        self.sex[y], changed = 3 - self.sex[x], True
        for p, q in couples:
            if p in self.parents.get(q, ()) or q in self.parents.get(p, ()) or (self.parents.get(p) and self.parents.get(p) == self.parents.get(q)):
                return False
        if ages:
            for child in self.parents:
                up = self.ancestors(child)
                if child in up:
                    return False
                if child in ages and any(p in ages and ages[p] <= ages[child] for p in up):
                    return False
        return True

    def line(self, person: str, sex: int) -> str:
        """The topmost of a person's mothers' mothers (sex 2) or fathers' fathers (sex 1) that are sure."""
        while True:
            above = [p for p in self.parents.get(person, ()) if self.sex[p] == sex]
            if not above:
                return person
            person = above[0]

    # ------------------------------------------------------------------- form
    def pruned(self) -> "State":
        """Without people who tell nothing: missing ones without children, and missing founders with one child in common."""
        out, changed = self.copy(), True
        while changed:
            changed, kids = False, self.children() if out is self else out.children()
            for name in [n for n in out.sex if n[0] == "?"]:
                if name not in kids and name in out.sex:
                    out.sex.pop(name)
                    out.parents.pop(name, None)
                    changed = True
            for child, both in list(out.parents.items()):
                if all(p[0] == "?" and p not in out.parents and kids.get(p) == [child] for p in both):
                    for p in out.parents.pop(child):
                        out.sex.pop(p)
                    changed = True
        return out

    def canonical(self) -> "State":
        """The same pedigree with placeholders named by their place in it.

        Marks are refined by those of parents and children until no more people
        are told apart; of placeholders that are alike one is then marked, and
        so on.
        """
        kids = self.children()
        marks = self._ranked({n: (0, n) if n[0] != "?" else (1, str(self.sex[n])) for n in self.sex})
        while True:
            count = len(set(marks.values()))
            marks = self._ranked({n: (marks[n], sorted(marks[p] for p in self.parents.get(n, ())), sorted((marks[c], sorted(marks[p] for p in self.parents[c])) for c in kids.get(n, ()))) for n in self.sex})
            if len(set(marks.values())) > count:
                continue
            if count == len(self.sex):
                break
            groups: dict[int, list[str]] = {}
            for n, m in marks.items():
                groups.setdefault(m, []).append(n)
            chosen = groups[min(m for m, g in groups.items() if len(g) > 1)][0]
            marks = self._ranked({n: (m, n != chosen) for n, m in marks.items()})
        order = sorted((n for n in self.sex if n[0] == "?"), key=marks.get)
        names = {n: n for n in self.sex if n[0] != "?"} | {n: f"?{k}" for k, n in enumerate(order, 1)}
        return State({names[c]: tuple(sorted(names[p] for p in both)) for c, both in self.parents.items()}, {names[n]: s for n, s in self.sex.items()})

    @staticmethod
    def _ranked(signs: dict) -> dict[str, int]:
        place = {s: k for k, s in enumerate(sorted({repr(s) for s in signs.values()}))}
        return {n: place[repr(s)] for n, s in signs.items()}

    def text(self) -> str:
        """A line of text; equal for states that differ in the names of placeholders only, once they are canonical."""
        return ";".join(f"{n}|{s}|{'|'.join(self.parents.get(n, ()))}" for n, s in sorted(self.sex.items()))

    @staticmethod
    def read(text: str) -> "State":
        rows = [row.split("|") for row in text.split(";")]
        return State({r[0]: tuple(r[2:]) for r in rows if r[2]}, {r[0]: int(r[1]) for r in rows})
