"""Rule expressions compiled into one minimal deterministic automaton over bytes.

Supported: literals, escapes, classes, groups (no captures), alternation, ``* + ? {m} {m,} {m,n}``.
Expressions are ASCII; a match is the leftmost one and of these the longest.

All rules are scanned in one pass over the bytes, from the last to the first: the combined
automaton accepts their reversals after any text, so its state tells at which places a match
of which rule begins. From such a place the rule's own automaton runs forward to the
longest end, and the next match of that rule begins at or after it.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass

# A syntax tree: ("set", frozenset of bytes) | ("cat", parts) | ("or", parts) | ("repeat", part, least, most or None)


class Parser:
    """Recursive descent over one expression."""

    def __init__(self, text: str, either_case: bool = False) -> None:
        self.text, self.at, self.either_case = text, 0, either_case

    def parse(self):
        tree = self.alternatives()
        if self.at < len(self.text):
            raise ValueError(f"unexpected {self.text[self.at]!r} in {self.text!r}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        char = self.peek()
        if not char:
            raise ValueError(f"unexpected end of {self.text!r}")
        self.at += 1
        return char

    def alternatives(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        part = self.atom()
        while self.peek() and self.peek() in "*+?{":
            sign = self.take()
            if sign == "{":
                end = self.text.index("}", self.at)
                least, comma, most = self.text[self.at : end].partition(",")
                self.at = end + 1
                part = ("repeat", part, int(least), int(most) if most else None if comma else int(least))
            else:
                part = ("repeat", part, int(sign == "+"), 1 if sign == "?" else None)
        return part

    def atom(self):
        char = self.take()
        if char == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"missing ) in {self.text!r}")
            return tree
        if char == "[":
            return ("set", self.members())
        if char == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.cased({self.escaped() if char == "\\" else ord(char)}))

    def escaped(self) -> int:
        char = self.take()
        if char == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(char, char))

    def members(self) -> frozenset[int]:
        refused = self.peek() == "^"
        if refused:
            self.take()
        found: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            char = self.take()
            low = high = self.escaped() if char == "\\" else ord(char)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] != "]":
                self.take()
                char = self.take()
                high = self.escaped() if char == "\\" else ord(char)
            found.update(range(low, high + 1))
        self.take()
        found = self.cased(found)
        return frozenset(range(256)) - found if refused else frozenset(found)

    def cased(self, found: set[int]) -> frozenset[int]:
        if self.either_case:
            text = bytes(sorted(found))
            found = {*found, *text.lower(), *text.upper()}
        return frozenset(found)


def reverse(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "or":
        return ("or", [reverse(x) for x in tree[1]])
    return ("repeat", reverse(tree[1]), *tree[2:]) if kind == "repeat" else tree


class Nfa:
    """Thompson automaton; ``moves[s]`` is (set of bytes, next), ``free[s]`` the states reached without a byte."""

    def __init__(self) -> None:
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """The state after ``tree`` from ``start``."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            inner = self.state()
            self.free[start].append(inner)
            self.moves[inner] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(part, loop)].append(loop)
            end = self.state()
            self.free[loop].append(end)
            return end
        end = self.state()
        self.free[start].append(end)
        for _ in range(most - least):
            start = self.add(part, start)
            self.free[start].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """``classes`` maps a byte to its class; ``table[state * width + class]`` is the next state.

    ``accepts[state]`` is the set of rules that accept there, as bits; state 0 is the start.
    """

    classes: bytes
    width: int
    table: list[int]
    accepts: list[int]


def byte_classes(sets: list[frozenset[int]]) -> tuple[bytes, list[int]]:
    """Bytes that no set tells apart share a class; returns the map and one byte of each class."""
    codes: dict[tuple, int] = {}
    classes = bytes(codes.setdefault(tuple(b in s for s in sets), len(codes)) for b in range(256))
    return classes, [classes.index(c) for c in range(len(codes))]


def subset_construction(trees: list, anywhere: bool) -> Dfa:
    """The automaton of all ``trees`` side by side; ``anywhere``: after any bytes."""
    nfa = Nfa()
    start = nfa.state()
    ends = {}
    for rule, tree in enumerate(trees):
        own = nfa.state()
        nfa.free[start].append(own)
        ends[nfa.add(tree, own)] = rule
    if anywhere:
        inner = nfa.state()
        nfa.moves[inner] = (frozenset(range(256)), start)
        nfa.free[start].append(inner)
    classes, samples = byte_classes(list({m[0] for m in nfa.moves if m}))

    def closed(states) -> frozenset[int]:
        found, waiting = set(states), list(states)
        while waiting:
            for after in nfa.free[waiting.pop()]:
                if after not in found:
                    found.add(after)
                    waiting.append(after)
        return frozenset(s for s in found if nfa.moves[s] or s in ends)

    first = closed([start])
    numbers, waiting, table, accepts = {first: 0}, deque([first]), [], []
    while waiting:
        states = waiting.popleft()
        accepts.append(sum(1 << ends[s] for s in states if s in ends))
        for byte in samples:
            after = closed([nfa.moves[s][1] for s in states if nfa.moves[s] and byte in nfa.moves[s][0]])
            if after not in numbers:
                numbers[after] = len(numbers)
                waiting.append(after)
            table.append(numbers[after])
    return Dfa(classes, len(samples), table, accepts)


def minimised(dfa: Dfa) -> Dfa:
    """Moore's refinement: states that accept alike and move alike become one."""
    width, count = dfa.width, len(dfa.accepts)
    group = list(dfa.accepts)
    groups = 0
    while True:
        names: dict[tuple, int] = {}
        refined = [
            names.setdefault((group[s], *[group[t] for t in dfa.table[s * width : (s + 1) * width]]), len(names))
            for s in range(count)
        ]
        if len(names) == groups:
            break
        group, groups = refined, len(names)
    sample = {}
    for state in range(count):
        sample.setdefault(group[state], state)
    table = [group[t] for g in range(groups) for t in dfa.table[sample[g] * width : (sample[g] + 1) * width]]
    return Dfa(dfa.classes, width, table, [dfa.accepts[sample[g]] for g in range(groups)])


@dataclass(frozen=True)
class Rule:
    """``least`` is the length from which a match counts; a shorter one still takes its place.

    ``opening`` is a leading part of the expression after which the rest may be empty: a match begins
    where it does, so the backward automaton needs no more of the rule.
    """

    kind: str
    expression: str
    either_case: str = ""
    least: int = 1
    opening: str = ""

    def tree(self):
        """``either_case`` is the leading part of the expression whose letters match in either case."""
        if not self.expression.startswith(self.either_case):
            raise ValueError("either_case must be the beginning of the expression")
        head = Parser(self.either_case, True).parse()
        return ("cat", [head, Parser(self.expression[len(self.either_case) :]).parse()])

    def opening_tree(self):
        if not self.expression.startswith(self.opening):
            raise ValueError("opening must be the beginning of the expression")
        return Parser(self.opening).parse() if self.opening else self.tree()


class Scanner:
    """All rules in one automaton; ``scan`` gives (rule, start, end) in bytes."""

    def __init__(self, rules: list[Rule]) -> None:
        trees = [rule.tree() for rule in rules]
        self.least = [rule.least for rule in rules]
        back = minimised(subset_construction([reverse(rule.opening_tree()) for rule in rules], anywhere=True))
        # States that begin a match get the highest numbers: the inner loop makes one comparison.
        order = sorted(range(len(back.accepts)), key=lambda s: back.accepts[s] > 0)
        place = {s: i for i, s in enumerate(order)}
        self.width, self.classes = back.width, back.classes
        self.table = [place[t] * back.width for s in order for t in back.table[s * back.width : (s + 1) * back.width]]
        self.accepts = [back.accepts[s] for s in order]
        self.first_accepting = sum(a == 0 for a in self.accepts) * back.width
        self.start = place[0] * back.width
        self.forward = [minimised(subset_construction([t], anywhere=False)) for t in trees]
        self.dead = [_dead_state(dfa) for dfa in self.forward]

    def scan(self, text: bytes) -> list[tuple[int, int, int]]:
        begins = self.begins(text)
        if not begins:
            return []
        found = []
        free = [0] * len(self.forward)
        for place, rules in begins:
            for rule in range(len(free)):
                if rules >> rule & 1 and place >= free[rule]:
                    end = self.longest(rule, text, place)
                    if end > place:
                        free[rule] = end
                        if end - place >= self.least[rule]:
                            found.append((rule, place, end))
        return found

    def begins(self, text: bytes) -> list[tuple[int, int]]:
        """Places at which a match begins, first to last, with the rules as bits."""
        table, state, least = self.table, self.start, self.first_accepting
        found = []
        for i, code in enumerate(text.translate(self.classes)[::-1]):
            state = table[state + code]
            if state >= least:
                found.append((len(text) - 1 - i, self.accepts[state // self.width]))
        return found[::-1]

    def longest(self, rule: int, text: bytes, start: int) -> int:
        """The end of the longest match of ``rule`` from ``start``, or ``start``."""
        dfa, dead = self.forward[rule], self.dead[rule]
        state, end = 0, start
        for i in range(start, len(text)):
            state = dfa.table[state * dfa.width + dfa.classes[text[i]]]
            if state == dead:
                break
            if dfa.accepts[state]:
                end = i + 1
        return end


def _dead_state(dfa: Dfa) -> int:
    """The state that accepts nothing and is never left, or -1."""
    for state, accepted in enumerate(dfa.accepts):
        if not accepted and set(dfa.table[state * dfa.width : (state + 1) * dfa.width]) == {state}:
            return state
    return -1


def matches_by_re(rule: Rule, text: str) -> list[tuple[int, int]]:
    """The same by Python's regular expressions, for tests."""
    head = f"(?i:{rule.either_case})" if rule.either_case else ""
    found = re.finditer(head + rule.expression[len(rule.either_case) :], text, re.A)
    return [m.span() for m in found if m.end() - m.start() >= rule.least]
