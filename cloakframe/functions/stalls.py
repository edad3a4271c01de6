"""Patterns that may take exponential time: their automaton can read some text in a loop in two ways.

A backtracking matcher tries every way before it gives up, so two ways around a loop mean 2**n tries for n rounds.
The atoms of a pattern are the states; a state leads to those that may follow it, with the number of ways (more
than one counts as two). Two readings that start and end in one state and part in between are a way through pairs
of states, from an equal pair to an unequal one and back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from cloakframe.functions.groups import _FLAGS, _REPEAT, _Node, _Reader

#: Characters that classes are compared on, besides those of the pattern.
_ALPHABET = [chr(c) for c in range(1, 128)] + list(" éЖж№٣中ß ")
#: Copies of a counted repetition; more make it a loop.
_COPIES = 8
_ASSERTIONS = ("^", "$", "\\b", "\\B", "\\A", "\\z", "\\Z", "\\G")


class _Unknown(Exception):
    """Something the automaton cannot say, such as a reference."""


@dataclass
class _Part:
    """A piece of a pattern: what it may begin and end with, and in how many ways it may be empty."""

    first: dict[int, int] = field(default_factory=dict)
    last: dict[int, int] = field(default_factory=dict)
    empty: int = 0


def _plus(into: dict[int, int], more: dict[int, int], ways: int = 1) -> None:
    for state, n in more.items():
        into[state] = min(2, into.get(state, 0) + n * ways)


class _Automaton:
    def __init__(self, members: Callable[[str, str, str], str], alphabet: str):
        self.members, self.alphabet = members, alphabet
        self.sets: list[frozenset[str]] = []
        self.follow: list[dict[int, int]] = []
        self.asserts = False
        self.known: dict[tuple[str, str], frozenset[str]] = {}

    def _join(self, last: dict[int, int], first: dict[int, int]) -> None:
        for state, n in last.items():
            _plus(self.follow[state], first, n)

    def atom(self, text: str, flags: str) -> _Part:
        if text in _ASSERTIONS:
            self.asserts = True
            return _Part(empty=1)
        if text.startswith("\\k") or (text[0] == "\\" and text[1:2].isdigit() and text[1] != "0"):
            raise _Unknown
        if (text, flags) not in self.known:
            self.known[text, flags] = frozenset(self.members(text, flags, self.alphabet))
        state = len(self.sets)
        self.sets.append(self.known[text, flags])
        self.follow.append({})
        return _Part({state: 1}, {state: 1}, 0)

    def literal(self, text: str, flags: str) -> _Part:
        out = _Part(empty=1)
        for c in text.removeprefix("\\Q").removesuffix("\\E"):
            out = self.sequence(out, self.atom(f"\\Q{c}\\E", flags))
        return out

    def sequence(self, a: _Part, b: _Part) -> _Part:
        self._join(a.last, b.first)
        first, last = dict(a.first), dict(b.last)
        if a.empty:
            _plus(first, b.first, a.empty)
        if b.empty:
            _plus(last, a.last, b.empty)
        return _Part(first, last, min(2, a.empty * b.empty))

    def choices(self, rows: tuple[tuple[_Node, ...], ...], flags: str) -> _Part:
        out = _Part()
        for row in rows:
            part, own = _Part(empty=1), flags
            for node in row:
                if _FLAGS.fullmatch(node.text):
                    own += node.text
                else:
                    part = self.sequence(part, self.repeated(node, own))
            _plus(out.first, part.first)
            _plus(out.last, part.last)
            out.empty = min(2, out.empty + part.empty)
        return out

    def once(self, node: _Node, flags: str) -> _Part:
        if node.head.startswith(("(?=", "(?!", "(?<=", "(?<!")):
            self.asserts = True
            self.choices(node.choices, flags)  # a loop inside counts, but leads nowhere
            return _Part(empty=1)
        if node.head:
            inline = node.head[1:-1] if node.head.endswith(":") and node.head != "(?:" else ""
            return self.choices(node.choices, flags + (f"({inline})" if inline else ""))
        if node.text.startswith("\\Q"):
            return self.literal(node.text, flags)
        return self.atom(node.text, flags)

    def repeated(self, node: _Node, flags: str) -> _Part:
        found = _REPEAT.fullmatch(node.repeat) if node.repeat else None
        if not found:
            return self.once(node, flags)
        kind = node.repeat[0]
        if kind == "{":
            low, high = int(found[1]), (int(found[3]) if found[3] else None) if found[2] else int(found[1])
        else:
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[kind]
        if node.repeat.endswith("+") and len(node.repeat) > 1:
            # Possessive: it takes all it can and never gives back, as if it were one round.
            part = self.once(node, flags)
            return _Part(part.first, part.last, max(part.empty, int(low == 0)))
        if high is None or high > _COPIES:
            part = self.once(node, flags)
            self._join(part.last, part.first)
            return _Part(part.first, part.last, 1 if low == 0 or part.empty else 0)
        out = _Part(empty=1)
        for i in range(high):
            part = self.once(node, flags)
            out = self.sequence(out, _Part(part.first, part.last, 1 if i >= low or part.empty else 0))
        return out

    def loops(self) -> Iterator[set[int]]:
        """Sets of states that a text leads around in two ways."""
        for group in _components(range(len(self.sets)), lambda s: self.follow[s]):
            inside = {s for s in group if any(t in group for t in self.follow[s])}
            if not inside:
                continue
            if any(n > 1 and t in group for s in inside for t, n in self.follow[s].items()):
                yield inside
                continue

            def pairs(pair: tuple[int, int], inside: set[int] = inside) -> Iterator[tuple[int, int]]:
                for a in self.follow[pair[0]]:
                    for b in self.follow[pair[1]]:
                        if a in inside and b in inside and not self.sets[a].isdisjoint(self.sets[b]):
                            yield a, b

            for both in _components([(s, s) for s in inside], pairs):
                if any(a == b for a, b in both) and any(a != b for a, b in both):
                    yield inside
                    break


def _components(roots, follow) -> Iterator[set]:
    """Strongly connected sets of what can be reached from the roots."""
    order: dict = {}
    low: dict = {}
    stack: list = []
    held: set = set()
    for root in roots:
        if root in order:
            continue
        work = [(root, iter(follow(root)))]
        order[root] = low[root] = len(order)
        stack.append(root)
        held.add(root)
        while work:
            node, rest = work[-1]
            new = next((n for n in rest if n not in order or n in held), None)
            if new is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    group = set()
                    while node not in group:
                        group.add(stack.pop())
                    held -= group
                    yield group
            elif new not in order:
                order[new] = low[new] = len(order)
                stack.append(new)
                held.add(new)
                work.append((new, iter(follow(new))))
            else:
                low[node] = min(low[node], order[new])


def may_stall(pattern: str, members: Callable[[str, str, str], str]) -> bool:
    """Can matching the Java pattern take exponential time.

    ``members(atom, flags, alphabet)`` gives the characters of the alphabet that an atom matches. A pattern with a
    reference to a group is not judged. A loop that may be left for the end of the pattern at any time does no harm.
    """
    alphabet = "".join(dict.fromkeys([*_ALPHABET, *pattern]))
    automaton = _Automaton(members, alphabet)
    try:
        whole = automaton.choices(_Reader(pattern).choices(), "")
    except _Unknown:
        return False
    return any(automaton.asserts or not loop <= whole.last.keys() for loop in automaton.loops())
