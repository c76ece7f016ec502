"""Regular expressions to one deterministic automaton, run over many texts at a time.

compile_rules parses rules (literals, classes, groups, | ? * + {m} {m,}, (?i:...)),
builds Thompson automata that may start at any byte, joins them by subset construction
and merges equal states by partition refinement. The result is one array of
transitions over byte classes; its states tell which rules have just matched.

compile_reversed does the same for one rule read from its end, tied to the byte at which
it begins; first_byte runs that from the last byte of a match to where the match starts.

scan runs the automaton of all rules in one pass over the bytes of a batch. Texts are cut into lanes at places
where the state is known whatever came before (found from the transition array), and
all lanes advance together, one byte a step, by array look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ALL = (1 << 256) - 1


def _bit(byte: int) -> int:
    return 1 << byte


class _Parser:
    """Regex text to a tree: ('set', mask), ('cat', [...]), ('or', [...]), ('rep', node, least, most or None)."""

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def parse(self):
        node = self.either()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i}")
        return node

    def either(self):
        options = [self.sequence()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", parts)

    def repeated(self, node):
        while self.i < len(self.s) and self.s[self.i] in "?*+{":
            c = self.s[self.i]
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self):
        c = self.s[self.i]
        if c == "(":
            before, self.i = self.fold, self.i + 1
            if self.s.startswith("?i:", self.i):
                self.fold, self.i = True, self.i + 3
            elif self.s.startswith("?:", self.i):
                self.i += 2
            node = self.either()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError("a group is not closed")
            self.i += 1
            self.fold = before
            return node
        if c == "[":
            self.i += 1
            mask = 0
            while self.s[self.i] != "]":
                low = self.byte()
                if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    for b in range(low, self.byte() + 1):
                        mask |= self.cased(b)
                else:
                    mask |= self.cased(low)
            self.i += 1
            return ("set", mask)
        if c == ".":
            self.i += 1
            return ("set", _ALL & ~_bit(10))
        return ("set", self.cased(self.byte()))

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c == "\\":
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2 : self.i], 16)
        if ord(c) > 127:
            raise ValueError("rules are ASCII")
        return ord(c)

    def cased(self, byte: int) -> int:
        c = chr(byte)
        return _bit(ord(c.lower())) | _bit(ord(c.upper())) if self.fold and c.isalpha() else _bit(byte)


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []
        self.on: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.on.append(None)
        return len(self.free) - 1

    def add(self, node, at: int) -> int:
        """Puts node behind state `at`; returns the state where it ends."""
        if node[0] == "set":
            end = self.state()
            here = self.state()
            self.free[at].append(here)
            self.on[here] = (node[1], end)
            return end
        if node[0] == "cat":
            for part in node[1]:
                at = self.add(part, at)
            return at
        if node[0] == "or":
            end = self.state()
            for part in node[1]:
                self.free[self.add(part, at)].append(end)
            return end
        _, inner, least, most = node
        for _ in range(least):
            at = self.add(inner, at)
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[at].append(end)
        for _ in range(most - least):
            at = self.add(inner, at)
            self.free[at].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """step[state * n_classes + byte_class[byte]] is the next state; found[state] has bit r if rule r ends here."""

    step: np.ndarray
    found: np.ndarray
    byte_class: np.ndarray
    n_classes: int
    start: int
    #: sync[a, b]: the state after bytes of class a and b, if it is the same from every state, else -1.
    sync: np.ndarray
    #: The state that nothing leaves and in which no rule ends, or -1.
    dead: int

    @property
    def n_states(self) -> int:
        return len(self.found)


def compile_rules(patterns: list[str]) -> Automaton:
    return _compiled([_Parser(p).parse() for p in patterns], True)


def compile_reversed(pattern: str) -> Automaton:
    return _compiled([_reversed(_Parser(pattern).parse())], False)


def _reversed(node):
    kind = node[0]
    if kind == "set":
        return node
    if kind == "rep":
        return ("rep", _reversed(node[1]), node[2], node[3])
    parts = [_reversed(x) for x in node[1]]
    return (kind, parts[::-1] if kind == "cat" else parts)


def first_byte(a: Automaton, raw: np.ndarray, low: int, last: int) -> int:
    """The smallest i >= low such that bytes i to last, read backwards, are a match of a; -1 if there is none."""
    state, out = a.start, -1
    for i in range(last, low - 1, -1):
        state = int(a.step[state * a.n_classes + int(a.byte_class[raw[i]])])
        if a.found[state]:
            out = i
        if state == a.dead:
            break
    return out


def _compiled(trees: list, anywhere: bool) -> Automaton:
    """anywhere: a match may begin at any byte; else only at the first."""
    nfa = _Nfa()
    root = nfa.state()
    ends = [nfa.add(t, root) for t in trees]
    masks = {on[0] for on in nfa.on if on}
    groups: dict[tuple[bool, ...], int] = {}
    ordered = sorted(masks)
    byte_class = np.array([groups.setdefault(tuple(bool(m >> b & 1) for m in ordered), len(groups)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(groups))]

    def closed(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    first = closed([root])
    index, rows, found, todo = {first: 0}, [], [], [first]
    while todo:
        now = todo.pop(0)
        found.append(sum(1 << r for r, e in enumerate(ends) if e in now))
        row = []
        for b in sample:
            after = closed([*[root] * anywhere, *(nfa.on[s][1] for s in now if nfa.on[s] and nfa.on[s][0] >> b & 1)])
            if after not in index:
                index[after] = len(index)
                todo.append(after)
            row.append(index[after])
        rows.append(row)
    table, marks = np.array(rows, np.int32), np.array(found, np.int64)

    part = np.unique(marks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    chosen = np.unique(part, return_index=True)[1]
    small = part[table[chosen]].astype(np.int32)
    twice = small[small]  # [state, a, b]
    sync = np.where((twice == twice[:1]).all(axis=0), twice[0], -1)
    stuck = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (marks[chosen] == 0))
    return Automaton(small.reshape(-1), marks[chosen], byte_class, len(groups), int(part[0]), sync, int(stuck[0]) if len(stuck) else -1)


#: Lanes are cut about so many bytes apart, where the bytes allow.
LANE = 256


def scan(a: Automaton, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, rule bits) of all bytes at which a rule ends, in texts raw[offsets[i]:offsets[i + 1]]."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls = a.byte_class[raw]
    known = a.sync[cls[:-1], cls[1:]]
    cut = np.flatnonzero(known >= 0) + 2  # a lane may begin here
    if len(cut):
        cut = cut[np.flatnonzero(np.diff(cut // LANE, prepend=-1))]
        cut = cut[cut < n]
    inner = np.full(n + 1, -1, np.int32)
    inner[cut] = known[cut - 2]
    begins = offsets[:-1][np.diff(offsets) > 0]
    inner[begins] = a.start
    # a pair of bytes across two texts tells nothing about the second text
    second = begins + 1
    second = second[(second < n) & ~np.isin(second, begins)]
    inner[second] = -1
    lane = np.flatnonzero(inner[:n] >= 0)
    state = inner[lane].astype(np.int64)
    length = np.diff(np.append(lane, n))
    order = np.argsort(-length, kind="stable")
    lane, state, length = lane[order], state[order], length[order]
    width = np.int64(a.n_classes)
    active = np.searchsorted(-length, -np.arange(int(length[0]) + 1), side="left")
    hit = a.found != 0
    at, what = [], []
    for i in range(int(length[0])):
        m = active[i]
        state = a.step[state[:m] * width + cls[lane[:m] + i]]
        found = hit[state]
        if found.any():
            w = np.flatnonzero(found)
            at.append(lane[w] + i)
            what.append(a.found[state[w]])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(at), np.concatenate(what)
