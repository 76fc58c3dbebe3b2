"""One automaton for several byte patterns: subset construction, minimisation, transition arrays, parallel scan.

Patterns know literals, classes, groups with alternatives, and the counts ``?``, ``*``, ``+``, ``{n}``, ``{m,n}``;
``(?i)`` at the start ignores the case of ASCII letters. A pattern is looked for at every position. The automaton
reports, per pattern, where a match may end; it stays in its start state across bytes that no pattern uses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

REPEATS = "?*+{"


class _Nfa:
    """States with empty moves and byte-class moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, node, start: int) -> int:
        """Adds ``node`` from ``start`` and returns its end state."""
        kind = node[0]
        if kind == "bytes":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "all":
            for part in node[1]:
                start = self.build(part, start)
            return start
        if kind == "any":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.build(part, first)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.build(inner, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.build(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.build(inner, start)
            self.empty[start].append(end)
        return end


class _Pattern:
    """Reads a pattern into nested tuples."""

    def __init__(self, text: str) -> None:
        self.fold = text.startswith("(?i)")
        self.text = text[4:] if self.fold else text
        self.at = 0

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def read(self):
        parts = [self.row()]
        while self.peek() == "|":
            self.take()
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else ("any", parts)

    def row(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.counted(self.atom()))
        return ("all", parts)

    def counted(self, node):
        while self.peek() and self.peek() in REPEATS:
            sign = self.take()
            if sign == "{":
                stop = self.text.index("}", self.at)
                low, _, high = self.text[self.at:stop].partition(",")
                limits = (int(low), int(high or low) if "," not in self.text[self.at:stop] or high else None)
                self.at = stop + 1
            else:
                limits = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            node = ("times", node, *limits)
        return node

    def one(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2:self.at], 16)
            c = {"n": "\n", "r": "\r", "t": "\t"}.get(c, c)
        return ord(c)

    def bytes(self, values: set[int]):
        if self.fold:
            values = {b for v in values for b in ((v, v ^ 32) if chr(v).isalpha() and v < 128 else (v,))}
        return ("bytes", frozenset(values))

    def atom(self):
        if self.peek() == "(":
            self.take()
            inner = self.read()
            self.take()
            return inner
        if self.peek() != "[":
            return self.bytes({self.one()})
        self.take()
        negated = self.peek() == "^"
        if negated:
            self.take()
        values: set[int] = set()
        while self.peek() != "]":
            low = self.one()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                values |= set(range(low, self.one() + 1))
            else:
                values.add(low)
        self.take()
        return self.bytes(set(range(256)) - values if negated else values)


@dataclass
class Automaton:
    classes: np.ndarray     # class of each byte
    moves: np.ndarray       # [state * n_classes + class] -> state
    ends: np.ndarray        # bit mask of patterns that may end in a state
    n_classes: int

    def scan(self, data: np.ndarray, lane: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Positions after which patterns may end, and their masks, for bytes read from the start state.

        The bytes are cut into lanes that advance together, one byte a step, all from the start state. A lane whose
        predecessor does not end in the start state is read again from there until both readings agree.
        """
        n = len(data)
        lanes = max(1, -(-n // lane))
        width = min(lane, n) if lanes == 1 else lane
        padded = np.zeros(lanes * width, np.uint8)
        padded[:n] = data
        by_step = np.ascontiguousarray(self.classes[padded].reshape(lanes, width).T)
        state = np.zeros(lanes, np.int32)
        where, masks = [], []
        begin = np.arange(lanes, dtype=np.int64) * width
        for step in range(width):
            state = self.moves[state * self.n_classes + by_step[step]]
            hit = np.flatnonzero(self.ends[state])
            if len(hit):
                where.append(begin[hit] + step)
                masks.append(self.ends[state[hit]])
        # Lanes that did not really begin in the start state.
        last = state
        entry = np.r_[np.int32(0), last[:-1]]
        todo = np.flatnonzero(entry)
        true_entry = entry.copy()
        while len(todo):
            again = {}
            for i in todo.tolist():
                real, assumed = int(true_entry[i]), 0
                for step in range(width):
                    c = int(by_step[step, i])
                    real = int(self.moves[real * self.n_classes + c])
                    assumed = int(self.moves[assumed * self.n_classes + c])
                    if real == assumed:
                        break
                    if self.ends[real]:
                        where.append(np.array([begin[i] + step]))
                        masks.append(self.ends[real:real + 1])
                else:
                    if i + 1 < lanes and real != true_entry[i + 1]:
                        again[i + 1] = real
            for i, s in again.items():
                true_entry[i] = s
            todo = np.array(sorted(again), np.int64)
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        positions, found = np.concatenate(where), np.concatenate(masks)
        keep = positions < n
        return positions[keep], found[keep]


def compiled(patterns: list[str]) -> Automaton:
    """The minimal automaton that looks for all ``patterns`` at every position."""
    nfa = _Nfa()
    root = nfa.state()
    finals = {}
    for k, text in enumerate(patterns):
        pattern = _Pattern(text)
        first = nfa.state()
        nfa.empty[root].append(first)
        finals[nfa.build(pattern.read(), first)] = k

    # Bytes that every move treats alike form one class.
    sets = sorted({s for moves in nfa.moves for s, _ in moves}, key=sorted)
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    names = {v: i for i, v in enumerate(dict.fromkeys(signature[b] for b in range(256)))}
    classes = np.array([names[signature[b]] for b in range(256)], np.uint8)
    example = {int(c): b for b, c in reversed(list(enumerate(classes)))}
    n_classes = len(names)

    def closed(states) -> frozenset:
        out, stack = set(states), list(states)
        while stack:
            for t in nfa.empty[stack.pop()]:
                if t not in out:
                    out.add(t)
                    stack.append(t)
        return frozenset(out)

    # Subset construction; the root stays in every subset, so that a match may begin anywhere.
    start = closed({root})
    index, order, moves = {start: 0}, [start], []
    for subset in order:
        row = []
        for c in range(n_classes):
            b = example[c]
            target = closed({root} | {t for s in subset for accepted, t in nfa.moves[s] if b in accepted})
            if target not in index:
                index[target] = len(order)
                order.append(target)
            row.append(index[target])
        moves.append(row)
    table = np.array(moves, np.int64)
    ends = np.array([sum(1 << finals[s] for s in subset if s in finals) for subset in order], np.int64)

    # Minimisation: states stay together while their ends and their targets' blocks agree.
    _, block = np.unique(ends, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    _, first = np.unique(block, return_index=True)
    rename = np.empty(len(first), np.int64)
    rename[np.argsort(first)] = np.arange(len(first))  # the start state's block becomes 0
    keep = np.sort(first)
    return Automaton(classes, rename[block[table[keep]]].astype(np.int32).ravel(), ends[keep], n_classes)
