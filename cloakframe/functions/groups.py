"""Where a group of a Java pattern begins: the pattern with what stands before the group captured as well.

Spark's functions return the text of a group but not its offsets. A pattern is rewritten so that everything
before the group, at each level of nesting, is a group of its own; their lengths add up to the group's offset
within the match.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import cache

_FLAGS = re.compile(r"\(\?[a-zA-Z]*(?:-[a-zA-Z]+)?\)")
_OPEN = re.compile(r"\((?:\?(?:[:=!>]|<[=!]|<[a-zA-Z][a-zA-Z0-9]*>|[a-zA-Z]*(?:-[a-zA-Z]+)?:))?")
_REPEAT = re.compile(r"(?:[*+?]|\{(\d+)(,)?(\d*)\})[+?]?")
_REFERENCE = re.compile(r"\\([1-9]\d*)")


@dataclass(frozen=True)
class _Node:
    """A piece of a pattern: raw text, or ``head`` and alternatives of a group; with what repeats it."""

    text: str = ""
    head: str = ""
    choices: tuple[tuple[_Node, ...], ...] = field(default=())
    repeat: str = ""
    number: int = 0
    mark: bool = False


def _captures(head: str) -> bool:
    return head == "(" or (head.startswith("(?<") and head[3] not in "=!")


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.groups = pattern, 0, 0

    def choices(self) -> tuple[tuple[_Node, ...], ...]:
        out, row = [], []
        while self.at < len(self.pattern) and self.pattern[self.at] != ")":
            if self.pattern[self.at] == "|":
                out.append(tuple(row))
                row, self.at = [], self.at + 1
            else:
                row.append(self.piece())
        return (*out, tuple(row))

    def piece(self) -> _Node:
        if flags := _FLAGS.match(self.pattern, self.at):
            self.at = flags.end()
            return _Node(text=flags[0])
        if self.pattern[self.at] == "(":
            head = _OPEN.match(self.pattern, self.at)[0]
            self.at += len(head)
            number = 0
            if _captures(head):
                self.groups += 1
                number = self.groups
            choices = self.choices()
            if self.at >= len(self.pattern):
                raise ValueError("the pattern has an open group")
            self.at += 1
            return _Node(head=head, choices=choices, repeat=self.repeat(), number=number)
        start = self.at
        self.at = self.end_of_atom()
        return _Node(text=self.pattern[start : self.at], repeat=self.repeat())

    def repeat(self) -> str:
        found = _REPEAT.match(self.pattern, self.at)
        if not found:
            return ""
        self.at = found.end()
        return found[0]

    def end_of_atom(self) -> int:
        at = self.at
        if self.pattern.startswith("\\Q", at):
            end = self.pattern.find("\\E", at)
            return len(self.pattern) if end < 0 else end + 2
        if self.pattern[at] == "[":
            return self.end_of_class(at)
        if self.pattern[at] != "\\":
            return at + 1
        long = re.compile(r"\\(?:[pPxN]\{[^}]*\}|[pP].|k<[^>]*>|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|0[0-3]?[0-7]{1,2}|c.|[1-9]\d*|.)", re.DOTALL)
        found = long.match(self.pattern, at)
        return found.end() if found else len(self.pattern)

    def end_of_class(self, at: int) -> int:
        depth, at = 1, at + 1
        while at < len(self.pattern) and depth:
            if self.pattern.startswith("\\Q", at):
                end = self.pattern.find("\\E", at)
                at = len(self.pattern) if end < 0 else end + 2
                continue
            c = self.pattern[at]
            at += 2 if c == "\\" else 1
            depth += (c == "[") - (c == "]")
        return at


def _holds(node: _Node, number: int) -> bool:
    return node.number == number or any(_holds(n, number) for row in node.choices for n in row)


def _uncaptured(node: _Node) -> _Node:
    head = "(?:" if _captures(node.head) else node.head
    return replace(node, head=head, number=0, choices=tuple(tuple(map(_uncaptured, row)) for row in node.choices))


def _always(node: _Node, number: int) -> bool:
    """Does the group take part whenever the piece matches once."""
    if node.number == number:
        return True
    inner = [n for row in node.choices for n in row if _holds(n, number)]
    return len(node.choices) == 1 and all(n.repeat[:1] in ("", "+") and _always(n, number) for n in inner)


def _refers(node: _Node) -> bool:
    own = _REFERENCE.fullmatch(node.text) or node.text.startswith("\\k<")
    return bool(own) or any(_refers(n) for row in node.choices for n in row)


def _marked(pieces: tuple[_Node, ...]) -> list[_Node]:
    """The pieces in capturing groups; flags stay outside, as a group would end what they hold for."""
    out, run = [], []
    for piece in (*pieces, None):
        if piece is None or _FLAGS.fullmatch(piece.text):
            if run:
                out.append(_Node(head="(", choices=(tuple(run),), mark=True))
            out += [piece] if piece else []
            run = []
        else:
            run.append(piece)
    return out


def _unrolled(node: _Node, number: int) -> tuple[list[_Node], str]:
    """What stands for a repeated piece so that its last repetition stands alone, and what repeats all of it."""
    found = _REPEAT.fullmatch(node.repeat)
    kind = node.repeat[0]
    if kind == "{":
        low, high = int(found[1]), (int(found[3]) if found[3] else None) if found[2] else int(found[1])
    else:
        low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[kind]
    how = node.repeat[-1] if len(node.repeat) > 1 and node.repeat[-1] in "+?" else ""
    if high is not None and high <= 1:
        return [replace(node, repeat="")], node.repeat
    if not _always(node, number) or _refers(node):
        raise ValueError("a group that not every repetition around it has, or that is referred to there, has no place of its own")
    before = replace(_uncaptured(node), repeat=f"{{{max(low - 1, 0)},{'' if high is None else high - 1}}}{'?' if how == '?' else ''}")
    rows = [*_marked((before,)), replace(node, repeat="")]
    if how == "+":
        rows = [_Node(head="(?>", choices=(tuple(rows),))]
    return rows, "" if low else "?" + how


def _rewritten(choices: tuple[tuple[_Node, ...], ...], number: int) -> tuple[tuple[_Node, ...], ...]:
    out = []
    for row in choices:
        place = next((i for i, n in enumerate(row) if _holds(n, number)), None)
        if place is None:
            out.append(row)
            continue
        node = row[place]
        if node.head.startswith(("(?<=", "(?<!", "(?!")):
            raise ValueError("a group inside a look-behind or a negative look-ahead has no place in the match")
        pieces, repeat = _unrolled(node, number) if node.repeat else ([node], "")

        def inside(piece: _Node) -> _Node:
            if piece.number == number or not _holds(piece, number):
                return piece
            if piece.head == "(?>" and piece.number == 0 and piece is not node and any(n.number or n.mark for n in piece.choices[0]):
                return replace(piece, choices=(tuple(map(inside, piece.choices[0])),))
            return replace(piece, choices=_rewritten(piece.choices, number))

        new = [inside(p) for p in pieces]
        if repeat:
            new = [_Node(head="(?:", choices=(tuple(new),), repeat=repeat)]
        out.append((*_marked(row[:place]), *new, *row[place + 1 :]))
    return tuple(out)


@cache
def located(pattern: str, group: int) -> tuple[str, int, tuple[int, ...]]:
    """An equal pattern, the number of the group in it, and the groups whose lengths add up to its offset."""
    if not group:
        return pattern, 0, ()
    reader = _Reader(pattern)
    choices = reader.choices()
    if group > reader.groups:
        raise ValueError(f"the pattern has no group {group}")
    choices = _rewritten(choices, group)
    numbers: dict[int, int] = {}
    marks: list[int] = []
    count = 0

    def text(rows: tuple[tuple[_Node, ...], ...]) -> str:
        return "|".join("".join(map(piece, row)) for row in rows)

    def piece(node: _Node) -> str:
        nonlocal count, marks
        if not node.head:
            return node.text + node.repeat
        if _captures(node.head):
            count += 1
            if node.mark:
                marks += [count]
            elif node.number:
                numbers[node.number] = count
        return f"{node.head}{text(node.choices)}){node.repeat}"

    text(choices)  # numbers first: a reference may stand before its group

    def referring(node: _Node) -> _Node:
        if node.head:
            return replace(node, choices=tuple(tuple(map(referring, row)) for row in node.choices))
        found = _REFERENCE.fullmatch(node.text)
        if not found:
            return node
        # A class of the digits that follow keeps them apart from the new number.
        return replace(node, text=f"(?:\\{numbers[int(found[1])]})")

    choices = tuple(tuple(map(referring, row)) for row in choices)
    count, marks = 0, []
    return text(choices), numbers[group], tuple(marks)
