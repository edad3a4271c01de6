"""License scans by patience alignment of notices with texts.

A notice and a window of words are aligned at the words that are unique in both, thinned to their
longest increasing run; the gaps between anchors are aligned the same way. A gap without anchors gives
its longest common subsequence. Coverage is the share of the notice's words that are matched. The words that tell
a notice from its relatives have to stand in the match as they are, and a short notice has to match whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame

from cloakframe.llm.common import map_rows
from cloakframe.llm.decontaminate import words_of

COVERAGE = 0.8

#: Notices of no more words are short: all their words but fillers have to match.
SHORT = 20
_FILLERS = frozenset(words_of("the a this work is"))
# Words that say the same in a short notice.
_SAME = dict.fromkeys(words_of("released distributed available published provided offered"), b"licensed") | {b"licence": b"license"}

_GNU_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the "
    "Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD = (
    _GRANT + "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_GNU = {"gpl": "GNU General Public License", "lgpl": "GNU Lesser General Public License", "agpl": "GNU Affero General Public License"}


class Template(NamedTuple):
    """A notice and the phrases that have to stand word by word within a match."""

    text: str
    phrases: tuple[str, ...] = ()


# Public license notices as they stand in texts.
_TEMPLATES = {
    "apache-2.0": Template("Licensed under the Apache License, Version 2.0.", ("Apache License Version 2.0",)),
    "apache-2.0-header": Template(
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("Apache License Version 2.0",),
    ),
    "apache-2.0-name": Template("Licensed under the Apache 2.0 License.", ("Apache 2.0 License",)),
    "bsd": Template("Licensed under the BSD License.", ("BSD License",)),
    "bsd-2-clause": Template("Licensed under the BSD 2-Clause License.", ("BSD 2 Clause License",)),
    "bsd-2-clause-grant": Template(_BSD, ("Redistribution and use in source and binary forms",)),
    "bsd-3-clause": Template("Licensed under the BSD 3-Clause License.", ("BSD 3 Clause License",)),
    "bsd-3-clause-grant": Template(_BSD + _NAMES, ("Redistribution and use in source and binary forms", "may be used to endorse or promote products")),
    "bsl-1.0": Template("Distributed under the Boost Software License, Version 1.0.", ("Boost Software License Version 1.0",)),
    **{
        f"cc-{kind}-{version}": Template(f"Licensed under CC {kind.upper()} {version}.", (f"CC {kind} {version}",))
        for kind in ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
        for version in ("2.0", "2.5", "3.0", "4.0")
    },
    **{
        f"cc-{kind}-{version}-name": Template(
            f"Licensed under a Creative Commons {name} {version} International License.", (f"Creative Commons {name} {version} International",)
        )
        for kind, name in {
            "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives",
            "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
            "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
        }.items()
        for version in ("4.0",)
    },
    "cc0-1.0": Template("Released under CC0 1.0.", ("CC0 1.0",)),
    "cc0-1.0-name": Template("Released under the Creative Commons CC0 License.", ("Creative Commons CC0",)),
    "epl-2.0": Template("Licensed under the Eclipse Public License 2.0.", ("Eclipse Public License 2.0",)),
    "isc": Template("Released under the ISC License.", ("ISC License",)),
    "isc-grant": Template(
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        ("with or without fee",),
    ),
    "mit": Template("Released under the MIT License.", ("MIT License",)),
    "mit-grant": Template(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        ("to deal in the Software without restriction",),
    ),
    "mpl-2.0": Template("Licensed under the Mozilla Public License, version 2.0.", ("Mozilla Public License version 2.0",)),
    "mpl-2.0-header": Template(
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        ("Mozilla Public License v 2.0",),
    ),
    "unlicense": Template("This is free and unencumbered software released into the public domain.", ("free and unencumbered software",)),
    "zlib": Template("Released under the zlib License.", ("zlib License",)),
    "zlib-grant": Template(
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable "
        "for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
        "purpose, including commercial applications, and to alter it and redistribute it freely.",
        ("including commercial applications",),
    ),
    **{
        f"{kind}-{version}": Template(f"This work is licensed under the {_GNU[kind]}, version {short}.", (f"{_GNU[kind]} version {short}",))
        for kind, version, short in (("gpl", "2.0", "2"), ("gpl", "3.0", "3"), ("lgpl", "2.1", "2.1"), ("lgpl", "3.0", "3"), ("agpl", "3.0", "3"))
    },
    **{
        f"{kind}-{version}-header": Template(_GNU_HEADER.format(_GNU[kind], short), (_GNU[kind], f"version {short} of the License"))
        for kind, version, short in (("gpl", "2.0", "2"), ("gpl", "3.0", "3"), ("lgpl", "2.1", "2.1"), ("lgpl", "3.0", "3"), ("agpl", "3.0", "3"))
    },
}
NOTICES = {name: template.text for name, template in sorted(_TEMPLATES.items())}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, whose second numbers increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, second) in enumerate(pairs):
        place = bisect_left(tails, second)
        tails[place : place + 1] = [second]
        at[place : place + 1] = [i]
        back.append(at[place - 1] if place else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _subsequence(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """One longest common subsequence, as pairs of places."""
    table = [[0] * (len(b) + 1)]
    for word in reversed(a):
        row, below = [0] * (len(b) + 1), table[-1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if word == b[j] else max(below[j], row[j + 1])
        table.append(row)
    table.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def patience(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Matched places of two word lists, in order."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        left, right = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if right[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if left[w] == 1 and w in place])
        if not anchors:
            shared = left.keys() & right.keys()
            some_a = [i for i in range(a0, a1) if a[i] in shared]
            some_b = [j for j in range(b0, b1) if b[j] in shared]
            pairs = _subsequence([a[i] for i in some_a], [b[j] for j in some_b])
            out += [(some_a[i], some_b[j]) for i, j in pairs]
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _holds(words: list[bytes], phrase: list[bytes]) -> bool:
    """Do the words of a phrase stand in a row?"""
    return any(words[i : i + len(phrase)] == phrase for i, w in enumerate(words) if w == phrase[0])


@dataclass
class Notice:
    name: str
    words: list[bytes]
    need: int
    counts: Counter
    phrases: list[list[bytes]]
    short: bool

    @classmethod
    def of(cls, name: str, text: str, coverage: float) -> Notice:
        words = words_of(text)
        short = len(words) <= SHORT
        if short:
            words = [_SAME.get(w, w) for w in words]
        known = _TEMPLATES.get(name)
        phrases = [words_of(p) for p in known.phrases] if known and known.text == text else []
        return cls(name, words, max(1, -int(-coverage * len(words) // 1)), Counter(words), phrases, short)

    @property
    def told(self) -> set[bytes]:
        """Words without which there is no match."""
        return {w for p in self.phrases for w in p} | ({w for w in self.words if w not in _FILLERS} if self.short else set())

    def may_match(self, words: Iterable[bytes]) -> bool:
        """No alignment matches more than the words that both have, each as often as both have it."""
        found = Counter(w for w in words if w in self.counts)
        return sum(min(n, self.counts[w]) for w, n in found.items()) >= self.need

    def whole(self, window: list[bytes], pairs: list[tuple[int, int]]) -> bool:
        """Are the phrases within the match, and of a short notice all words but fillers matched?"""
        inside = window[pairs[0][0] : pairs[-1][0] + 1]
        if not all(_holds(inside, p) for p in self.phrases):
            return False
        matched = {j for _, j in pairs}
        return not self.short or all(j in matched or w in _FILLERS for j, w in enumerate(self.words))

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """``matched, first, end`` of the best occurrences that do not overlap.

        Windows of three lengths start at every length: an occurrence of up to twice the notice's length
        lies whole in one of them. The words are all looked at, and a window holds a bounded number.
        """
        size, found = len(self.words), []
        if self.phrases:  # no match without it
            phrase = self.phrases[0]
            spots = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
        else:
            spots = [i for i, w in enumerate(words) if w in self.counts]
        for start in sorted({s for i in spots for s in range(i // size - 2, i // size + 1) if s >= 0}):
            low, high = start * size, (start + 3) * size
            window = words[low:high]
            if self.may_match(window):
                pairs = patience(window, self.words)
                if len(pairs) >= self.need and self.whole(window, pairs):
                    found.append((len(pairs), low + pairs[0][0], low + pairs[-1][0] + 1))
        taken: list[tuple[int, int, int]] = []
        for hit in sorted(set(found), key=lambda h: (-h[0], h[2] - h[1], h[1])):
            if all(hit[2] <= first or hit[1] >= end for _, first, end in taken):
                taken.append(hit)
        yield from sorted(taken, key=lambda h: h[1])


def scan_licenses(
    docs: DataFrame,
    notices: dict[str, str] | None = None,
    coverage: float = COVERAGE,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``key, license, coverage, n_hits, hits`` of each document, its whole text looked at.

    ``hits`` lists notice, coverage and word range of each occurrence that covers at least ``coverage`` of its
    notice, by place and name, holds its distinguishing words and, if the notice is short, all but fillers; ``license`` is the one of most matched words, then the first by name. Documents
    without any, null and empty texts included, have a null license and coverage 0. Rows are independent:
    repeats give repeats, null keys stay, and an empty table gives no rows.
    """
    known = [n for n in (Notice.of(k, v, coverage) for k, v in sorted((notices or NOTICES).items())) if n.words]
    told = {n.name: n.told for n in known}

    def rows(part: Iterable[tuple]) -> Iterator[tuple]:
        for name, content in part:
            words = words_of(content)
            same = [_SAME.get(w, w) for w in words]
            present = set(words) | set(same)
            found = []
            for notice in known:
                if not told[notice.name] <= present:
                    continue
                shared = notice.counts.keys() & present
                if sum(map(notice.counts.__getitem__, shared)) >= notice.need:
                    found += [(notice, *hit) for hit in notice.hits(same if notice.short else words)]
            best = min(found, key=lambda h: (-h[1], h[0].name), default=None)
            hits = [
                {"license": n.name, "coverage": m / len(n.words), "first": a, "end": b}
                for n, m, a, b in sorted(found, key=lambda h: (h[2], h[0].name))
            ]
            yield (name, best[0].name, best[1] / len(best[0].words), len(hits), hits) if best else (name, None, 0.0, 0, [])

    kind = docs.schema[key].dataType.simpleString()
    hit = "array<struct<license: string, coverage: double, first: long, end: long>>"
    out = map_rows(docs.select(key, text), rows, f"name {kind}, license string, coverage double, n_hits long, hits {hit}")
    return out.withColumnRenamed("name", key)
