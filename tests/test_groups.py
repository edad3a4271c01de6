"""Places of groups inside their matches."""

import random
import re

import pytest

from cloakframe import Policy
from cloakframe.functions.groups import located
from cloakframe.plans.extend import register_detector
from cloakframe.plans.masking import findings, mask_with_stats

CASES = [
    (r"(\d+)-(\d+)x", 2), (r"a(b)?", 1), (r"(?i)x(?:y(?:([ab]+)w)?)?u|q", 1), (r"<(\w+)>", 1), (r"(a|b(c))?d", 2), (r"(a|b(c))d", 2), (r"(?:(\d+)-)+x", 1),
    (r"(?:k(\d)){2,3}", 1), (r"(?:k(\d))*z", 1), (r"[(\]]([ab])\((b)", 2), (r"(a)(b)\2(\d)", 3), (r"(?<=a)b(\d)", 1), (r"a(?=(b+))b", 1),
    (r"(?P<n>a)-(\d)".replace("?P", "?"), 2), (r"a(b|)(\d)", 2), (r"(a{2})+?(b)", 2), (r"x{2,}(y)", 1), (r"(?:a|(b))(\d)", 1), ("\\Q(a\\E(b)", 1),
]


def python_pattern(pattern):
    return re.sub(r"\(\?<([a-z])", r"(?P<\1", pattern).replace("\\Q(a\\E", r"\(a")


@pytest.mark.parametrize("pattern, group", CASES)
def test_lengths_before_a_group_are_its_offset(pattern, group):
    rnd = random.Random(7)
    new, number, before = located(pattern, group)
    old, new = re.compile(python_pattern(pattern)), re.compile(python_pattern(new))
    seen = 0
    letters = [*(c for c in pattern if c.isalnum() or c in "-<>(]"), "1", "2", "xyawu"]
    for _ in range(20000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14)))
        theirs = [(m.span(), m.start(group), m[group]) for m in old.finditer(text)]
        mine = [(m.span(), m.start() + sum(len(m[b] or "") for b in before) if m[number] is not None else -1, m[number]) for m in new.finditer(text)]
        assert mine == theirs
        seen += sum(start >= 0 for _, start, _ in theirs)
    assert seen


def test_groups_without_a_place_are_refused():
    for pattern in (r"(?<=(a))b", r"x(?!(a))b", r"(?:(a)\1)+b", r"(?:(a)|b)+c", r"(?:(a)?b)*c"):
        with pytest.raises(ValueError):
            located(pattern, 1)
    with pytest.raises(ValueError):
        register_detector(Policy(secret="s"), "d", r"a(b)", group=2)


def test_equal_strings_before_the_group_stay(spark):
    policy = register_detector(Policy(secret="s"), "second", r"(\d+)-(\d+)x", group=2)
    rows = [(1, "12-2x and 7-7x"), (2, "é 12-12x=1, 3-3x"), (3, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    masked = {r.id: r.text for r in mask_with_stats(df, policy).collect()}
    assert re.fullmatch(r"12-SECOND_[0-9a-f]{24}x and 7-SECOND_[0-9a-f]{24}x", masked[1]) and masked[3] is None
    found = {(r.id, r.start, r.end) for r in findings(df, policy, keys=["id"]).collect()}
    assert found == {(1, 3, 4), (1, 12, 13), (2, 5, 7), (2, 14, 15)}
