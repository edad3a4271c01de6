"""Masking policy: which detectors run, how their spans are masked, what named fields do."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.maskers import hmac_sha256, mask_partial, mask_preserve_format, mask_redact, token_of
from cloakframe.functions.patterns import BUILTIN_DETECTORS, Detector
from cloakframe.plans.extend import DetectorRegistry

# --- fixed values -------------------------------------------------------------------------
MODES = ("hmac", "partial", "preserve_format", "redact")
FIELD_ACTIONS = ("mask", "remove", "replace")
DEFAULT_PREFIXES = {
    "email": "EMAIL",
    "phone": "PHONE",
    "bank_account": "ACCOUNT",
    "bik": "BIK",
    "document_code": "CODE",
    "inn": "INN",
    "guid": "GUID",
    "snils": "SNILS",
    "kpp": "KPP",
    "ogrn": "OGRN",
    "ip_address": "IP",
    "url": "URL",
}
NER_PREFIXES = {
    "person": "PERSON",
    "organization": "ORG",
    "location": "LOC",
    "address": "ADDRESS",
}
PLACEHOLDER_SECRETS = ("", "CHANGE_ME", "change_me", "changeme")
# --- end of fixed values ------------------------------------------------------------------

SECRET_ENV = "CLOAKFRAME_SECRET"


@dataclass(frozen=True)
class Rule:
    enabled: bool = True
    mode: str = "hmac"
    prefix: str = ""

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown masking mode {self.mode!r}; known: {', '.join(MODES)}")


@dataclass(frozen=True)
class FieldRule:
    enabled: bool = True
    action: str = "mask"
    replacement: str | None = None

    def __post_init__(self) -> None:
        if self.action not in FIELD_ACTIONS:
            raise ValueError(f"unknown field action {self.action!r}; known: {', '.join(FIELD_ACTIONS)}")


@dataclass(frozen=True)
class Policy:
    """Immutable description of one masking run, kept on the driver."""

    secret: str = field(repr=False)
    rules: Mapping[str, Rule] = field(default_factory=dict)
    field_rules: Mapping[str, FieldRule] = field(default_factory=dict)
    ner: bool = False
    min_confidence: float = 0.5
    registry: DetectorRegistry = field(default_factory=lambda: DetectorRegistry(BUILTIN_DETECTORS), repr=False)
    maskers: Mapping[str, Callable[[Column], Column]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        if not self.secret:
            raise ValueError("the masking secret must not be empty")
        if not 0.0 <= self.min_confidence <= 1.0:
            raise ValueError("min_confidence must lie between 0 and 1")
        for name, rule in self.rules.items():
            if not rule.enabled:
                continue
            if name in NER_PREFIXES:
                if not self.ner:
                    raise ValueError(f"rule {name!r} needs ner to be enabled")
            elif name not in self.registry:
                raise ValueError(f"unknown rule {name!r}")

    # -- construction ----------------------------------------------------------------------

    @classmethod
    def default(cls, secret: str, **changes: Any) -> Policy:
        """All built-in detectors, each with keyed tokens."""
        rules = {name: Rule(prefix=prefix) for name, prefix in DEFAULT_PREFIXES.items()}
        return cls(secret=secret, rules=rules, **changes)

    @classmethod
    def only(cls, secret: str, *names: str, mode: str = "hmac", **changes: Any) -> Policy:
        rules = {n: Rule(mode=mode, prefix=DEFAULT_PREFIXES.get(n, "")) for n in names}
        return cls(secret=secret, rules=rules, **changes)

    @classmethod
    def from_dict(cls, data: Mapping[str, Any], **changes: Any) -> Policy:
        """Strict reading of a configuration mapping: an unknown key is an error."""
        _only_keys("policy", data, {"secret", "rules", "field_rules", "ner"})
        ner = data.get("ner") or {}
        _only_keys("ner", ner, {"enabled", "min_confidence"})
        secret = os.environ.get(SECRET_ENV) or data.get("secret") or ""
        if secret in PLACEHOLDER_SECRETS:
            raise ValueError(f"no masking secret: set 'secret' in the policy or {SECRET_ENV}")
        return cls(
            secret=secret,
            rules={name: _build(Rule, name, value) for name, value in (data.get("rules") or {}).items()},
            field_rules={
                name: _build(FieldRule, name, value) for name, value in (data.get("field_rules") or {}).items()
            },
            ner=bool(ner.get("enabled", False)),
            min_confidence=float(ner.get("min_confidence", 0.5)),
            **changes,
        )

    @classmethod
    def load(cls, path: str | Path, **changes: Any) -> Policy:
        """Read a JSON policy, or a YAML one where PyYAML is installed."""
        source = Path(path)
        if not source.is_file():
            raise FileNotFoundError(f"no policy file at {source}")
        text = source.read_text(encoding="utf-8")
        if source.suffix.lower() == ".json":
            data = json.loads(text)
        else:
            try:
                import yaml
            except ImportError as error:
                raise ValueError("YAML policies need PyYAML; use a .json policy instead") from error
            data = yaml.safe_load(text)
        if not isinstance(data, dict):
            raise ValueError("a policy file has to hold one object")
        return cls.from_dict(data, **changes)

    def with_field_rules(self, **rules: FieldRule) -> Policy:
        return replace(self, field_rules={**self.field_rules, **rules})

    # -- use -------------------------------------------------------------------------------

    def detectors(self) -> list[Detector]:
        """Detectors of the enabled rules, in rule order."""
        return [
            self.registry.get(name)
            for name, rule in self.rules.items()
            if rule.enabled and name not in NER_PREFIXES
        ]

    def masked_rules(self) -> dict[str, Rule]:
        """Detector name to rule, with the default entity rules when ner is on."""
        active = {name: rule for name, rule in self.rules.items() if rule.enabled}
        if self.ner:
            for name, prefix in NER_PREFIXES.items():
                if name not in self.rules:
                    active[name] = Rule(prefix=prefix)
        return active

    def detector_names(self) -> list[str]:
        names = [d.name for d in self.detectors()]
        return names + ([n for n in NER_PREFIXES if n not in names] if self.ner else [])

    def prefix_of(self, name: str) -> str:
        return self.masked_rules()[name].prefix or name.upper()

    def hmac_prefixes(self) -> dict[str, str]:
        """Detector name to token prefix for the reversible (keyed) rules."""
        return {
            n: self.prefix_of(n)
            for n, r in self.masked_rules().items()
            if r.mode == "hmac" and n not in self.maskers
        }

    def field_actions(self) -> dict[str, FieldRule]:
        """Lower-cased field name to its enabled rule; of names equal but for case the last wins."""
        return {name.lower(): rule for name, rule in self.field_rules.items() if rule.enabled}

    def replacement(self, span: Column, token: Callable[[Column, Column], Column] | None = None) -> Column:
        """Mask of one span by the rule of its detector; without a rule the value stays.

        ``token(digest, new_token)`` may swap the keyed token (token cache).
        """
        name, value = span["detector"], span["value"]
        by_mode: dict[str, list[str]] = {}
        for detector, rule in self.masked_rules().items():
            if detector not in self.maskers:
                by_mode.setdefault(rule.mode, []).append(detector)

        branches: list[tuple[Column, Column]] = [
            (name == F.lit(detector), masker(value)) for detector, masker in self.maskers.items()
        ]
        if "hmac" in by_mode:
            digest = hmac_sha256(value, self.secret)
            new = token_of(digest, _lookup(name, self.hmac_prefixes()))
            branches.append((name.isin(by_mode["hmac"]), token(digest, new) if token else new))
        if "partial" in by_mode:
            branches.append((name.isin(by_mode["partial"]), mask_partial(value)))
        if "preserve_format" in by_mode:
            branches.append((name.isin(by_mode["preserve_format"]), mask_preserve_format(value, self.secret)))
        for detector in by_mode.get("redact", ()):
            branches.append((name == F.lit(detector), mask_redact(self.prefix_of(detector))))

        if not branches:
            return value
        chosen = F.when(*branches[0])
        for condition, result in branches[1:]:
            chosen = chosen.when(condition, result)
        return chosen.otherwise(value)


def _lookup(name: Column, values: Mapping[str, str]) -> Column:
    chosen = None
    for key, value in values.items():
        test, result = name == F.lit(key), F.lit(value)
        chosen = F.when(test, result) if chosen is None else chosen.when(test, result)
    return chosen


def _only_keys(where: str, data: Any, allowed: set[str]) -> None:
    if not isinstance(data, Mapping):
        raise ValueError(f"{where} has to be an object")
    unknown = sorted(set(data) - allowed)
    if unknown:
        raise ValueError(f"unknown keys in {where}: {', '.join(map(str, unknown))}")


def _build(kind: type, name: str, value: Any) -> Any:
    data = {} if value is None else value
    _only_keys(f"{kind.__name__} {name}", data, set(kind.__dataclass_fields__))
    return kind(**data)
