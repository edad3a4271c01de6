"""Small Column helpers shared by every function module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A Column used several times inside one expression is evaluated several times. Binding it to
    the variable of a one-element ``transform`` computes it once per row, also where a staged
    ``withColumn`` is impossible (inside arrays, maps and structs).
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Regular-expression search with a literal pattern."""
    return F.regexp_like(text, F.lit(pattern))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: Numbers of a block in ``running``, and how many numbers are simply folded anew for each place.
_BLOCK = 64
_FEW = 8


def running(numbers: Column, step: Callable[[Column, Column], Column], zero: int) -> Column:
    """``step`` (an associative one, such as a sum) folded over the array up to and with each place.

    ``aggregate`` copies its state at every item, so no list is built in one. Blocks are folded first, then
    the blocks before each block, and each place goes on from there within its block.
    """

    def fold(items: Column) -> Column:
        return F.aggregate(items, F.lit(zero), step)

    def of_block(i: Column) -> Column:
        return F.floor(i / _BLOCK).cast("int")

    def scanned(items: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), of_block(F.size(items))), lambda b: fold(F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))
        )
        before = let(blocks, lambda folded: F.transform(folded, lambda _, b: fold(F.slice(folded, F.lit(1), b))))

        def at(starts: Column, i: Column) -> Column:
            own = fold(F.slice(items, of_block(i) * _BLOCK + 1, i % _BLOCK + 1))
            return step(F.get(starts, of_block(i)), own)

        return let(before, lambda starts: F.transform(items, lambda _, i: at(starts, i)))

    def folded_anew(items: Column) -> Column:
        return F.transform(items, lambda _, i: fold(F.slice(items, F.lit(1), i + 1)))

    return let(numbers, lambda items: F.when(F.size(items) <= _FEW, folded_anew(items)).otherwise(scanned(items)))
