"""Rules compiled to one minimal automaton over bytes.

A rule is written as a regular expression of literals, sets, groups, ``|``, ``?``,
``*``, ``+`` and ``{m,n}``. All rules go into one nondeterministic automaton, subset
construction makes it deterministic, and partition refinement makes it minimal. The
result is a transition array of states by byte classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ANY = (1 << 256) - 1
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}


def _bits(chars: str) -> int:
    mask = 0
    for b in chars.encode("latin-1"):
        mask |= 1 << b
    return mask


class _Reader:
    """Pattern to tree: ("set", mask), ("cat", parts), ("alt", parts), ("rep", part, low, high)."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def char(self) -> str:
        c = self.take()
        if c != "\\":
            return c
        c = self.take()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        return _ESCAPES.get(c, c)

    def folded(self, mask: int) -> int:
        if self.fold:
            for lower, upper in zip(range(97, 123), range(65, 91)):
                if mask >> lower & 1 or mask >> upper & 1:
                    mask |= 1 << lower | 1 << upper
        return mask

    def choice(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.single()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, _, high = self.text[self.at : end].partition(",")
                limits = int(low), (int(high) if high else None) if "," in self.text[self.at : end] else int(low)
                self.at = end + 1
            else:
                limits = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            part = ("rep", part, *limits)
        return part

    def single(self):
        if self.peek() == "(":
            self.take()
            inside = self.choice()
            if self.take() != ")":
                raise ValueError(f"a group is not closed in {self.text!r}")
            return inside
        if self.peek() == "[":
            return ("set", self.folded(self.set()))
        if self.peek() == ".":
            self.take()
            return ("set", ANY & ~_bits("\n"))
        return ("set", self.folded(_bits(self.char())))

    def set(self) -> int:
        self.take()
        negated = self.peek() == "^"
        if negated:
            self.take()
        mask = 0
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.char()
                mask |= sum(1 << b for b in range(ord(low), ord(high) + 1))
            else:
                mask |= _bits(low)
        self.take()
        return ANY & ~mask if negated else mask


def parse(pattern: str, fold: bool = False):
    reader = _Reader(pattern, fold)
    tree = reader.choice()
    if reader.peek():
        raise ValueError(f"{pattern!r} ends at {reader.at}")
    return tree


def reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(p) for p in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(p) for p in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Parts:
    """A nondeterministic automaton: empty moves and moves on sets of bytes."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[int, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Build ``tree`` from ``start`` on; the state where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.empty[self.add(part, self.branch(start))].append(end)
            return end
        _, part, low, high = tree
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.branch(start)
            self.empty[self.add(part, loop)].append(loop)
            return self.branch(loop)
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end

    def branch(self, start: int) -> int:
        new = self.state()
        self.empty[start].append(new)
        return new

    def closed(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Automaton:
    """``table[state, byte class]`` is the next state, ``accepts[state]`` a bit per rule.

    State 0 is the start. ``dead`` is the state that leads nowhere, or -1.
    """

    table: np.ndarray
    accepts: np.ndarray
    classes: bytes
    dead: int

    def rows(self) -> list[list]:
        """Each state as a list of the next states' lists by class, its accept bits, and whether it is dead."""
        made: list[list] = [[] for _ in self.accepts]
        for i, row in enumerate(made):
            row.extend(made[t] for t in self.table[i])
            row.extend((int(self.accepts[i]), i == self.dead))
        return made


def compile_trees(trees: list, anywhere: bool) -> Automaton:
    """One minimal automaton for all ``trees``; ``anywhere`` lets a match start at any byte."""
    parts = _Parts()
    start, ends = parts.state(), {}
    for rule, tree in enumerate(trees):
        ends[parts.add(tree, parts.branch(start))] = 1 << rule
    masks = sorted({mask for moves in parts.moves for mask, _ in moves})
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256))
    sample = [classes.index(k) for k in range(len(kinds))]
    # states as bits of a number: what each part reaches by a byte of each class, empty moves included
    closures = [sum(1 << s for s in parts.closed([t])) for t in range(len(parts.empty))]
    reach = []
    for moves in parts.moves:
        by_class = [0] * len(sample)
        for mask, target in moves:
            for k, byte in enumerate(sample):
                if mask >> byte & 1:
                    by_class[k] |= closures[target]
        reach.append([(k, bits) for k, bits in enumerate(by_class) if bits])
    first = closures[start]
    number, todo, table, accepts = {first: 0}, [first], [], []
    for now in todo:
        row, rest, rules = [first if anywhere else 0] * len(sample), now, 0
        while rest:
            s = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            rules |= ends.get(s, 0)
            for k, bits in reach[s]:
                row[k] |= bits
        for after in row:
            if after not in number:
                number[after] = len(number)
                todo.append(after)
        table.append([number[after] for after in row])
        accepts.append(rules)
    return _minimal(np.array(table, np.int32), np.array(accepts, np.int64), classes)


def _minimal(table: np.ndarray, accepts: np.ndarray, classes: bytes) -> Automaton:
    """Split states by accept bits, then by where they go, until nothing splits."""
    group = np.unique(accepts, return_inverse=True)[1].reshape(-1)
    while True:
        views = np.column_stack([group, group[table]])
        finer = np.unique(views, axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    order = np.full(group.max() + 1, -1)
    seen = 0
    for g in group:  # the start keeps number 0
        if order[g] < 0:
            order[g], seen = seen, seen + 1
    group = order[group]
    members = np.unique(group, return_index=True)[1]
    table, accepts = group[table[members]].astype(np.int32), accepts[members]
    still = np.flatnonzero((table == np.arange(len(table))[:, None]).all(axis=1) & (accepts == 0))
    return Automaton(table, accepts, classes, int(still[0]) if len(still) else -1)
