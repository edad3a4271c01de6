"""Built-in detectors: fixed patterns, priorities and cheap pre-checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import ascii_letters, digits

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.binding import extract_all, matches
from cloakframe.functions.checksums import is_valid_inn, is_valid_ipv4, is_valid_ogrn, is_valid_snils

# --- fixed values -------------------------------------------------------------------------
# Priorities and patterns decide which spans are found, so they are constants of the product.
# ``(?U)`` makes \d, \w, \s and \b Unicode-aware.
#
# Repeated parts that can match in one way only are possessive, an e-mail starts at the start of its
# run of local characters (or right after the e-mail before it), and its domain goes up to the last
# dot that two letters follow. So no pattern backtracks or recurses over a long text: a hostile row
# costs time linear in its length and cannot overflow an executor's stack.

DETECTOR_PRIORITIES = {
    "bank_account": 100,
    "document_code": 96,
    "inn": 95,
    "bik": 94,
    "kpp": 90,
    "ogrn": 88,
    "snils": 86,
    "email": 85,
    "phone": 80,
    "guid": 80,
    "ip_address": 75,
    "url": 75,
}
DEFAULT_PRIORITY = 10

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
# Listed one by one, as Java looks single characters up in a table and tries ranges one after the other.
_LOCAL = f"{ascii_letters}{digits}._%+\\-"
_LABEL = r"[a-zA-Z0-9\p{L}]++(?:-++[a-zA-Z0-9\p{L}]++)*+"
_HEX4 = r"[0-9A-Fa-f]{1,4}"

PATTERNS = {
    "bank_account": r"(?U)(?<!\d)\d{20}(?!\d)",
    "document_code": (
        r"(?Ui)(?:\b(?:код|номер|document|doc|id)\b|[№#])\s*+(?:[:=]\s*+)?"
        r"((?=[\p{L}\d_./-]{6,}\b)(?=[\p{L}\d_./-]*\p{L})(?=[\p{L}\d_./-]*\d)"
        r"[\p{L}\d][\p{L}\d_./-]{5,})"
    ),
    "inn": r"(?U)(?<!\d)(?:\d{10}|\d{12})(?!\d)",
    "bik": r"(?U)(?<!\d)0[0-9]{8}(?!\d)",
    "kpp": r"(?U)(?<!\d)\d{4}[0-9A-Z]{2}\d{3}(?!\d)",
    "ogrn": r"(?U)(?<!\d)(?:\d{13}|\d{15})(?!\d)",
    "snils": r"(?U)(?<!\d)\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}(?!\d)",
    "email": (
        rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@"
        r"(?:[a-zA-Z0-9\p{L}][a-zA-Z0-9\p{L}\-]*+\."
        r"(?:(?![a-zA-Z\p{L}]{2})[a-zA-Z0-9\p{L}][a-zA-Z0-9\p{L}\-]*+\.)*+(?=[a-zA-Z\p{L}]{2}))++"
        r"[a-zA-Z\p{L}]{2,}"
    ),
    "phone": (
        r"(?U)(?<!\d)(?:\+7|8)(?:[\s\-]?\(\d{3}\)[\s\-]?|[\s\-]?\d{3}[\s\-]?)"
        r"\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?!\d)"
    ),
    "guid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "ip_address": rf"(?U)(?<![.\d]){_OCTET}(?:\.{_OCTET}){{3}}(?![.\d])",
    "url": (
        r"(?U)(?:https?|ftps?)://(?:[a-zA-Z0-9._~%+\-]++(?::[a-zA-Z0-9._~%+\-]*+)?@)?"
        rf"(?:(?:\d{{1,3}}\.){{3}}\d{{1,3}}|{_LABEL}(?:\.{_LABEL})++)"
        r"""(?::\d{1,5})?(?:/[^\s<>"')\]]*)?"""
    ),
    "ipv6": (
        rf"(?U)(?<![:\w])(?:(?:{_HEX4}:){{1,7}}{_HEX4}|(?:{_HEX4}:){{1,7}}:|:(?::{_HEX4}){{1,7}}"
        rf"|(?:{_HEX4}:){{1,6}}:{_HEX4}|::(?:{_HEX4}:){{0,5}}{_HEX4}|::)(?![:\w])"
    ),
}
# --- end of fixed values ------------------------------------------------------------------

# Every match of a numeric detector, minus a leading "+", lies inside one of these runs: they
# start at a digit and go on through every character such a match may contain. Seven characters
# is the shortest numeric match ("1.1.1.1").
_NUMERIC_RUN = r"(?U)\d[\dA-Z()\s.\-]{6,}"
_RUN_BREAK = "\n|\n"


def numeric_runs(text: Column) -> Column:
    """Joined digit-led runs of ``text``: one scan that lets all numeric detectors be skipped."""
    return F.array_join(extract_all(text, _NUMERIC_RUN), _RUN_BREAK)


@dataclass(frozen=True)
class Detector:
    """A span detector.

    ``group`` selects the part of a match that is the span, wherever it stands. ``may_match(text, runs)`` is a cheap condition that is true whenever the
    pattern can match; ``validator(value)`` is a checksum. ``spans``, when given, replaces the
    pattern: a function from a text Column to ``array<struct<start,end,value>>``. ``scan`` finds the same
    matches, as ``match``, in one go from the match before: what stands between them is ``gap``.
    """

    name: str
    pattern: str = ""
    group: int = 0
    priority: int = DEFAULT_PRIORITY
    validator: Callable[[Column], Column] | None = None
    may_match: Callable[[Column, Column], Column] | None = None
    spans: Callable[[Column], Column] | None = None
    scan: str = ""


def _in_runs(pattern: str) -> Callable[[Column, Column], Column]:
    return lambda text, runs: matches(runs, pattern)


def _has(literal: str) -> Callable[[Column, Column], Column]:
    return lambda text, runs: F.contains(text, F.lit(literal))


def _has_match(pattern: str) -> Callable[[Column, Column], Column]:
    return lambda text, runs: matches(text, pattern)


def _has_digit_and_match(pattern: str) -> Callable[[Column, Column], Column]:
    return lambda text, runs: matches(text, r"\p{Nd}") & matches(text, pattern)


# A marker begins with one of the first; beyond ASCII any character is looked at.
_CODE_STARTS = r"dDiI#\x{80}-\x{10FFFF}"
_CODE = (
    r"(?U:(?:[кК][оО][дД]|[нН][оО][мМ][еЕ][рР]|[dD][oO][cC](?:[uU][mM][eE][nN][tT])?|[iI][dD]|[№#])"
    r"[\s:=]*+(?=[\p{L}\d_./-]*\d))"
)
_MAY_MATCH = {
    "bank_account": _in_runs(r"(?U)\d{20}"),
    "document_code": _has_digit_and_match(rf"\A(?:[^{_CODE_STARTS}]+|(?!{_CODE})(?s:.))*+{_CODE}"),
    "inn": _in_runs(r"(?U)\d{10}"),
    "bik": _in_runs(r"0[0-9]{8}"),
    "kpp": _in_runs(r"(?U)\d{4}[0-9A-Z]{2}\d{3}"),
    "ogrn": _in_runs(r"(?U)\d{13}"),
    "snils": _in_runs(r"(?U)\d{3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{2}"),
    "email": _has("@"),
    "phone": _in_runs(r"(?U)[78][\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"),
    "guid": _has_match(r"-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-"),
    "ip_address": _in_runs(r"(?U)\d\.\d{1,3}\.\d{1,3}\.\d"),
    "url": _has("://"),
    "ipv6": _has_match(r":[0-9A-Fa-f]{0,4}:|[0-9A-Fa-f]:[0-9A-Fa-f]"),
}
_VALIDATORS = {
    "inn": is_valid_inn,
    "ogrn": is_valid_ogrn,
    "snils": is_valid_snils,
    "ip_address": is_valid_ipv4,
}


def _skipping(gap: str, pattern: str) -> str:
    """A pattern that goes on from the match before: ``gap`` takes places where no match begins, many at a time."""
    return rf"\G(?<gap>(?:{gap})*+)(?<match>{pattern})"


# No match of these begins within a run of digits, or at anything else but these characters.
_AT_DIGITS = ("bank_account", "inn", "bik", "kpp", "ogrn", "snils", "ip_address")
_AT = {"phone": "+8", "url": "hf", "document_code": _CODE_STARTS}
_SCANS = {name: _skipping(rf"(?U:\D+)|(?!{PATTERNS[name]})(?U:\d++)", PATTERNS[name]) for name in _AT_DIGITS}
_SCANS |= {name: _skipping(rf"[^{first}]+|(?!{PATTERNS[name]})(?s:.)", PATTERNS[name]) for name, first in _AT.items()}
# Runs of what a local part may hold are gone through as wholes.
_DOMAIN = PATTERNS["email"].partition("++@")[2]
_SCANS["email"] = _skipping(rf"[{_LOCAL}]++(?!@{_DOMAIN})|[^{_LOCAL}]+", rf"[{_LOCAL}]++@{_DOMAIN}")

BUILTIN_DETECTORS = {
    name: Detector(
        name=name,
        pattern=pattern,
        group=1 if name == "document_code" else 0,
        priority=DETECTOR_PRIORITIES.get(name, DEFAULT_PRIORITY),
        validator=_VALIDATORS.get(name),
        may_match=_MAY_MATCH[name],
        scan=_SCANS.get(name, ""),
    )
    for name, pattern in PATTERNS.items()
}
