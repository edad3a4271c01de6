"""Registry of detectors: the built-in ones and those a user adds."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.sql import Column

from cloakframe.functions.groups import located
from cloakframe.functions.patterns import DEFAULT_PRIORITY, Detector
from cloakframe.functions.stalls import may_stall

CAPABILITIES = frozenset({"detector", "masker", "field_rules"})


@dataclass(frozen=True)
class Extension:
    """A named addition: its detector and, if wanted, describing metadata."""

    name: str
    detector: Detector
    masker: Callable[[Column], Column] | None = None
    version: str | None = None
    title: str | None = None
    capabilities: Sequence[str] = ()


class DetectorRegistry:
    """Name to detector; a copy is made on every addition, so a policy's registry never changes."""

    def __init__(self, detectors: Mapping[str, Detector] | None = None) -> None:
        self._detectors = dict(detectors or {})

    def __contains__(self, name: object) -> bool:
        return name in self._detectors

    def __iter__(self) -> Iterator[str]:
        return iter(self._detectors)

    def get(self, name: str) -> Detector:
        if name not in self._detectors:
            raise ValueError(f"no detector named {name!r}")
        return self._detectors[name]

    def with_extension(self, extension: Extension) -> DetectorRegistry:
        _check(extension)
        if extension.name in self._detectors:
            raise ValueError(f"a detector named {extension.name!r} exists already")
        return DetectorRegistry({**self._detectors, extension.name: extension.detector})


def _check(extension: Extension) -> None:
    if not extension.name:
        raise ValueError("an extension needs a name")
    if extension.detector.name != extension.name:
        raise ValueError(f"extension {extension.name!r} carries the detector {extension.detector.name!r}")
    if extension.title is None and extension.version is None and not extension.capabilities:
        return
    if not extension.title or not extension.version:
        raise ValueError("extension metadata needs a title and a version")
    unknown = sorted(set(extension.capabilities) - CAPABILITIES)
    if unknown:
        raise ValueError(f"unknown extension capabilities: {', '.join(unknown)}")


def _matches_nothing(pattern: str) -> bool:
    """Does the pattern match the empty string, by Java's rules where a session runs."""
    context = SparkContext._active_spark_context
    if context is None:
        return re.search(r"\A(?:\w?[*?])\Z", pattern) is not None
    return context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").find()


def _members(atom: str, flags: str, alphabet: str) -> str:
    """The characters that an atom of a pattern matches, by Java's rules where a session runs."""
    context = SparkContext._active_spark_context
    if context is None:
        known = re.compile(f"{flags.replace('(?U)', '')}(?:{atom.replace(chr(92) + 'Q', chr(92)).replace(chr(92) + 'E', '')})")
        return "".join(c for c in alphabet if known.fullmatch(c))
    rest = context._jvm.java.util.regex.Pattern.compile(f"{flags}(?:{atom})").matcher(alphabet).replaceAll("")
    return "".join(c for c in alphabet if c not in set(rest))


def register_detector(
    policy,
    name: str,
    pattern: str = "",
    *,
    group: int = 0,
    priority: int = DEFAULT_PRIORITY,
    validator: Callable[[Column], Column] | None = None,
    may_match: Callable[[Column, Column], Column] | None = None,
    spans: Callable[[Column], Column] | None = None,
    rule=None,
):
    """A policy that also runs a user's detector.

    ``pattern`` is a Java regular expression that does not match the empty string. A ``group`` is masked alone, in
    its own place, the last one if it is repeated; in a look-behind it has none. A pattern that may stall on a hostile
    text, such as ``(a+)+b``, is refused (see ``functions.stalls``). ``spans`` takes the text Column and
    returns ``array<struct<start,end,value>>`` instead; a ``pandas_udf`` of that type fits.
    """
    from dataclasses import replace

    from cloakframe.plans.policy import Rule

    if bool(pattern) == (spans is not None):
        raise ValueError("give either a pattern or a spans function")
    if pattern and _matches_nothing(pattern):
        raise ValueError("the pattern matches the empty string")
    located(pattern, group)  # refuses a group that has no place
    if pattern and may_stall(pattern, _members):
        raise ValueError("the pattern can read some text in two ways around a loop, which may take exponential time; make the inner part possessive")
    detector = Detector(
        name=name,
        pattern=pattern,
        group=group,
        priority=priority,
        validator=validator,
        may_match=may_match,
        spans=spans,
    )
    registry = policy.registry.with_extension(Extension(name=name, detector=detector))
    return replace(policy, registry=registry, rules={**policy.rules, name: rule or Rule()})


def register_masker(policy, name: str, masker: Callable[[Column], Column]):
    """A policy that masks the spans of detector ``name`` with a user's Column function."""
    from dataclasses import replace

    if name not in policy.masked_rules():
        raise ValueError(f"no enabled rule named {name!r}")
    return replace(policy, maskers={**policy.maskers, name: masker})


