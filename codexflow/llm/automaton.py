"""Regular expressions to minimal deterministic automata over bytes.

Covers what secret rules need: literals, escapes, classes, groups, alternation and the repeats
``? * + {n} {n,}``. Groups do not capture.
"""

from __future__ import annotations

import re

import numpy as np

from codexflow.llm.common import by_value

by_value(__name__)

ESCAPES = {"n": 10, "t": 9, "r": 13}


def parse(pattern: str, any_case: bool = False):
    """Tree of ('set', bytes) | ('cat', parts) | ('or', parts) | ('loop', tree) | ('maybe', tree)."""
    at = 0

    def both_cases(members):
        return frozenset(members) | {b ^ 32 for b in members if chr(b).isalpha() and b < 128} if any_case else frozenset(members)

    def one_char():
        nonlocal at
        c = pattern[at]
        at += 1
        if c != "\\":
            return ord(c)
        c = pattern[at]
        at += 1
        if c == "x":
            at += 2
            return int(pattern[at - 2:at], 16)
        return ESCAPES.get(c, ord(c))

    def char_class():
        nonlocal at
        negated = pattern[at] == "^"
        at += negated
        members = set()
        while pattern[at] != "]":
            low = high = one_char()
            if pattern[at] == "-" and pattern[at + 1] != "]":
                at += 1
                high = one_char()
            members |= set(range(low, high + 1))
        at += 1
        members = both_cases(members)
        return ("set", frozenset(range(256)) - members if negated else members)

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 3 if pattern.startswith("(?:", at) else 1
            inner = either()
            at += 1
            return inner
        if pattern[at] == "[":
            at += 1
            return char_class()
        return ("set", both_cases({one_char()}))

    def repeated():
        nonlocal at
        tree = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            if c == "{":
                low, comma, high = re.match(r"\{(\d+)(,?)(\d*)\}", pattern[at:]).groups()
                at = pattern.index("}", at) + 1
                rest = [("loop", tree)] if comma and not high else [("maybe", tree)] * (int(high or low) - int(low))
                tree = ("cat", [tree] * int(low) + rest)
            else:
                at += 1
                tree = {"?": ("maybe", tree), "*": ("loop", tree), "+": ("cat", [tree, ("loop", tree)])}[c]
        return tree

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated())
        return ("cat", parts)

    def either():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return ("or", parts)

    return either()


def mirrored(tree):
    kind, what = tree
    if kind == "set":
        return tree
    if kind in ("loop", "maybe"):
        return kind, mirrored(what)
    parts = [mirrored(p) for p in what]
    return kind, parts[::-1] if kind == "cat" else parts


class Automaton:
    """Minimal automaton of several trees at once.

    ``step[state * classes + byte_class[byte]]`` is the next state, already multiplied by ``classes``;
    ``accepts[state]`` is a bit mask of the trees that end there. State 0 is the start; accepting states
    come last, from ``first_accepting`` on. ``search`` lets a match begin at any byte.
    """

    def __init__(self, trees: list, search: bool):
        moves, empty = [], []  # per NFA state: (set, target) or None; list of empty moves

        def new():
            moves.append(None)
            empty.append([])
            return len(moves) - 1

        def build(tree, start):
            kind, what = tree
            if kind == "set":
                end = new()
                moves[start] = (what, end)
                return end
            if kind == "cat":
                for part in what:
                    start = build(part, link(start))
                return start
            if kind == "or":
                end = new()
                for part in what:
                    empty[build(part, link(start))].append(end)
                return end
            inner, end = link(start), new()
            last = build(what, inner)
            empty[last].append(end)
            empty[start].append(end)
            if kind == "loop":
                empty[last].append(inner)
            return end

        def link(start):
            state = new()
            empty[start].append(state)
            return state

        root = new()
        ends = {}
        for i, tree in enumerate(trees):
            end = build(tree, link(root))
            ends[end] = ends.get(end, 0) | 1 << i

        def closure(states):
            seen, todo = set(states), list(states)
            while todo:
                for s in empty[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            return frozenset(seen)

        # bytes that no set tells apart form one class
        sets = sorted({m[0] for m in moves if m}, key=sorted)
        signature = [tuple(b in s for s in sets) for b in range(256)]
        kinds = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
        self.byte_class = np.array([kinds[sig] for sig in signature], dtype=np.uint8)
        self.classes = len(kinds)
        example = {k: signature.index(sig) for sig, k in kinds.items()}

        # subset construction
        start = closure({root})
        number, todo, rows, accepts = {start: 0}, [start], [], []
        while todo:
            subset = todo.pop(0)
            accepts.append(sum({1 << i for i in range(len(trees)) for s in subset if ends.get(s, 0) >> i & 1}))
            live = [moves[s] for s in subset if moves[s]]
            row = []
            for k in range(self.classes):
                target = closure({t for allowed, t in live if example[k] in allowed} | ({root} if search else set()))
                if target not in number:
                    number[target] = len(number)
                    todo.append(target)
                row.append(number[target])
            rows.append(row)

        # minimisation by refinement: states stay together while they accept alike and move alike
        table, accepts = np.array(rows), np.array(accepts)
        _, block = np.unique(accepts, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        _, first = np.unique(block, return_index=True)
        order = sorted(first, key=lambda s: (accepts[s] != 0, block[s] != block[0], s))
        place = np.empty(len(first), dtype=np.int64)
        place[block[order]] = np.arange(len(order))
        self.accepts = accepts[order].tolist()
        self.first_accepting = next((i for i, a in enumerate(self.accepts) if a), len(order))
        step = place[block[table[order]]]
        self.start = int(place[block[0]])
        self.step = (step * self.classes).astype(np.int32).reshape(-1)
        self.dead = next((i for i in range(len(order)) if not self.accepts[i] and (step[i] == i).all()), -1)
        self._plain = None

    def run(self, data: bytes, positions) -> int:
        """Last of ``positions`` after whose byte the automaton accepts; -1 if none does."""
        if self._plain is None:
            self._plain = (self.step.tolist(), self.byte_class.tolist())
        step, kind = self._plain
        state, last, dead, final = self.start * self.classes, -1, self.dead * self.classes, self.accepts
        for i in positions:
            state = step[state + kind[data[i]]]
            if state == dead:
                break
            if final[state // self.classes]:
                last = i
        return last
