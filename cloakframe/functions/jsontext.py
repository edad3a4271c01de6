"""JSON kept as compact text: its strings as a list, field rules, and the text put together again.

The text is what ``to_json`` writes of a variant: no blanks, quotes inside strings escaped, so a quoted text
before a colon is a key, and NUL occurs nowhere.
"""

from __future__ import annotations

import json as jsonlib
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.binding import extract_all, let

STRING = r'"(?:[^"\\]|\\.)*+"'
#: Arrays of arrays that ``remove`` and ``replace`` reach into.
ARRAY_LEVELS = 4


def _array(levels: int) -> str:
    inner = f"{_array(levels - 1)}|" if levels > 1 else ""
    return rf'\[(?:{STRING}|{inner}[^\[\]{{}}"])*+\]'


_TOKEN = STRING + ":?"


def tokens(text: Column) -> Column:
    """All quoted texts, keys with their colon."""
    return extract_all(text, _TOKEN)


def _is_key(token: Column) -> Column:
    return F.endswith(token, F.lit('":'))


def body(token: Column) -> Column:
    """The string a token stands for; null for a key."""
    plain = token.substr(F.lit(2), F.length(token) - 2)
    parsed = F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(~_is_key(token), F.when(F.contains(token, F.lit("\\")), parsed).otherwise(plain))


def _quoted(text: Column) -> Column:
    return let(F.to_json(F.array(text)), lambda t: t.substr(F.lit(2), F.length(t) - 2))


def with_strings(text: Column, masked: Callable[[Column, Column], Column]) -> Column:
    """The text with ``masked(token, place)`` for each string, where that is not the string itself."""

    def renewed(token: Column, place: Column) -> Column:
        new = let(masked(token, place), lambda m: F.when(m.isNull() | (m == body(token)), token).otherwise(_quoted(m)))
        return F.when(_is_key(token), token).otherwise(new)

    def joined(found: Column) -> Column:
        pieces = F.zip_with(
            F.split(text, _TOKEN, -1),
            F.transform(found, renewed),
            lambda gap, token: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(token, F.lit(""))),
        )
        return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)

    return let(tokens(text), joined)


def _in_arrays(text: Column, key: str, width: int, new: str) -> Column:
    """The strings in the arrays behind a key, also in arrays of arrays, replaced; numbers and nulls stay."""
    pattern = key + _array(ARRAY_LEVELS)

    def renewed(found: Column) -> Column:
        rest = F.regexp_replace(found.substr(F.lit(width + 1), F.length(found)), F.lit(STRING), F.lit(new))
        return F.concat(found.substr(F.lit(1), F.lit(width)), rest)

    def joined(found: Column) -> Column:
        pieces = F.zip_with(
            F.split(text, pattern, -1),
            F.transform(found, renewed),
            lambda gap, token: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(token, F.lit(""))),
        )
        return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)

    return let(extract_all(text, pattern), joined)


def ruled(text: Column, actions: dict) -> Column:
    """The text with the ``remove`` and ``replace`` rules applied to strings and to the items of arrays.

    NUL marks what goes until its commas are known. An array that also holds an object is left alone.
    """
    for field, rule in actions.items():
        if rule.action == "mask":
            continue
        name = jsonlib.dumps(field, ensure_ascii=False) + ":"
        key = f"(?i:{re.escape(name)})"
        new = "\0"
        if rule.action == "replace":
            new = jsonlib.dumps(rule.replacement or "", ensure_ascii=False).replace("\\", "\\\\").replace("$", "\\$")
        text = _in_arrays(text, key, len(name), new)
        whole = new if rule.action == "remove" else f"$1{new}"
        text = F.regexp_replace(text, F.lit(f"({key}){STRING}"), F.lit(whole))
    return F.regexp_replace(F.regexp_replace(text, "\0,", ""), ",?\0", "")
