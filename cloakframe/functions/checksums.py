"""Checksum validation of Russian identifiers and IPv4 octets, as boolean Columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.binding import let, matches

# --- fixed values: official weight vectors ------------------------------------------------
INN_10_WEIGHTS = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12_FIRST_WEIGHTS = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN_12_SECOND_WEIGHTS = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
SNILS_WEIGHTS = (9, 8, 7, 6, 5, 4, 3, 2, 1)
# --- end of fixed values ------------------------------------------------------------------


@cache
def _decimal_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and, in the same order, their ASCII values."""
    chars = [
        chr(code)
        for code in range(0x80, sys.maxunicode + 1)
        if unicodedata.category(chr(code)) == "Nd"
    ]
    return "".join(chars), "".join(str(unicodedata.decimal(char)) for char in chars)


def ascii_digits(value: Column) -> Column:
    """Replace decimal digits of other scripts by ASCII digits; plain ASCII passes untouched."""
    source, target = _decimal_digits()
    return F.when(matches(value, r"[^\x00-\x7F]"), F.translate(value, source, target)).otherwise(value)


def digits_only(value: Column) -> Column:
    return F.regexp_replace(ascii_digits(value), r"[^0-9]", "")


def _digit(value: Column, place: int) -> Column:
    return F.substring(value, place, 1).try_cast("int")


def _weighted(value: Column, weights: Sequence[int]) -> Column:
    """Sum of the leading digits, each times its weight."""
    table = F.from_json(F.lit(str(list(weights))), "array<int>")
    products = F.zip_with(table, F.split(value, ""), lambda w, c: w * c.try_cast("int"))
    return F.aggregate(F.slice(products, 1, len(weights)), F.lit(0), lambda total, p: total + p)


def is_valid_inn(value: Column) -> Column:
    """10 digits with one control digit, or 12 digits with two."""

    def check(v: Column) -> Column:
        def control(weights: Sequence[int], place: int) -> Column:
            return _weighted(v, weights) % 11 % 10 == _digit(v, place)

        return (
            F.when(matches(v, r"\A[0-9]{10}\z"), control(INN_10_WEIGHTS, 10))
            .when(
                matches(v, r"\A[0-9]{12}\z"),
                control(INN_12_FIRST_WEIGHTS, 11) & control(INN_12_SECOND_WEIGHTS, 12),
            )
            .otherwise(F.lit(False))
        )

    return let(ascii_digits(value), check)


def is_valid_ogrn(value: Column) -> Column:
    """13 digits (modulo 11) or 15 digits (modulo 13); the last digit is the control digit."""

    def check(v: Column) -> Column:
        head = v.substr(F.lit(1), F.length(v) - 1).try_cast("bigint")
        modulus = F.length(v) - 2
        return F.when(
            matches(v, r"\A(?:[0-9]{13}|[0-9]{15})\z"), head % modulus % 10 == F.right(v, F.lit(1)).try_cast("int")
        ).otherwise(F.lit(False))

    return let(ascii_digits(value), check)


def is_valid_snils(value: Column) -> Column:
    """11 digits, separators ignored, not starting with 00; weighted sum modulo 101, where 100 is 0."""

    def check(v: Column) -> Column:
        expected = _weighted(v, SNILS_WEIGHTS) % 101 % 100
        return F.when(
            matches(v, r"\A(?!00)[0-9]{11}\z"), expected == F.right(v, F.lit(2)).try_cast("int")
        ).otherwise(F.lit(False))

    return let(digits_only(value), check)


def is_valid_ipv4(value: Column) -> Column:
    """Every dotted part is a number from 0 to 255."""
    octets = F.split(ascii_digits(value), r"\.")
    return F.forall(octets, lambda part: F.coalesce(part.try_cast("int").between(0, 255), F.lit(False)))
