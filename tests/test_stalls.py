"""Patterns that may take exponential time, by their automaton and by Java's own matcher."""

import time

import pytest

from cloakframe import Policy
from cloakframe.functions.patterns import PATTERNS
from cloakframe.functions.stalls import may_stall
from cloakframe.plans.extend import _members, register_detector

STALL = [
    (r"(a+)+b", "a" * 40), (r"(?:a|a)+b", "a" * 40), (r"(?:\w+\s?)+:", "a" * 40), (r"([a-c]+|b)*x", "b" * 40), (r"(?:a|aa)+$", "a" * 60 + "!"),
    (r"(?i)(?:A+|a)*z", "a" * 40), (r"(x?a?)*b" if False else r"(?:a?a)+b", "a" * 60), (r"(?:a++|a)+b", "a" * 34), (r"(a*)*b", "a" * 40),
    (r"\d+(?:(?:\d|[0-5])+)-", "1" * 40), (r"^(?:.*,)*.*;$" if False else r"(?:(?:ab?)+|a)+c", "a" * 40), (r"(?=(a+)+b)a", "a" * 34),
]
SAFE = [
    r"a+b", r"(?:a++)+b", r"(?:\w+\s)+:", r"(\w+\s?)+", r"(?:ab)+c", r"Customer#(\d{9})", r"<([^>]+@[^>]+)(?=>)", r"(\d+)-(\d+)x", r"(?:a|b)+c",
    r"(?>a+)b", r"[\w.]+@\w+\.ru", r"\Qa+b\E+c", r"(?:\d{1,3}\.){3}\d{1,3}", r"(?U)\b\d+\b", r"(a)\1+b", r"x{2,3}y", r"(?:[^,]*,)+;",
]


@pytest.mark.parametrize("pattern, text", STALL)
def test_stalling_patterns_are_refused(spark, pattern, text):
    assert may_stall(pattern, _members)
    with pytest.raises(ValueError, match="two ways"):
        register_detector(Policy(secret="s"), "d", pattern)


@pytest.mark.parametrize("pattern", SAFE)
def test_safe_patterns_are_taken(spark, pattern):
    assert not may_stall(pattern, _members)


def test_safe_patterns_do_not_stall(spark):
    """Java's matcher is done at once with hostile texts of each pattern's own characters."""
    compiled = spark._jvm.java.util.regex.Pattern
    for pattern in SAFE:
        for c in {c for c in pattern if c.isalnum()} | {" ", ",", ">"}:
            for text in (c * 600, (c + "a") * 300, "1." * 300):
                started = time.perf_counter()
                compiled.compile(pattern).matcher(text + "!").find()
                assert time.perf_counter() - started < 5


def test_the_library_has_no_stalling_pattern(spark):
    assert not [name for name, pattern in PATTERNS.items() if may_stall(pattern, _members)]
