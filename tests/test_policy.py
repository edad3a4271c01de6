"""Policies: strict reading, defaults, refused input."""

import json

import pytest

from cloakframe.plans.policy import SECRET_ENV, FieldRule, Policy, Rule


def test_from_dict():
    policy = Policy.from_dict(
        {
            "secret": "s3",
            "rules": {"email": {"mode": "partial"}, "inn": None, "bik": {"enabled": False}},
            "field_rules": {"Password": {"action": "remove"}, "PASSWORD": {"action": "replace", "replacement": "x"}},
        }
    )
    assert [d.name for d in policy.detectors()] == ["email", "inn"]
    assert policy.prefix_of("inn") == "INN"
    assert policy.field_actions()["password"].replacement == "x"


@pytest.mark.parametrize(
    "data",
    [
        {},
        {"secret": "changeme"},
        {"secret": "s", "extra": 1},
        {"secret": "s", "rules": {"email": {"mode": "shred"}}},
        {"secret": "s", "rules": {"email": {"color": "red"}}},
        {"secret": "s", "rules": {"nothing": {}}},
        {"secret": "s", "rules": {"person": {}}},
        {"secret": "s", "field_rules": {"a": {"action": "eat"}}},
        {"secret": "s", "ner": {"enabled": True, "min_confidence": 2}},
    ],
)
def test_refused(data, monkeypatch):
    monkeypatch.delenv(SECRET_ENV, raising=False)
    with pytest.raises(ValueError):
        Policy.from_dict(data)


def test_files_and_environment(tmp_path, monkeypatch):
    path = tmp_path / "policy.json"
    path.write_text(json.dumps({"secret": "changeme", "rules": {"email": {}}}))
    monkeypatch.setenv(SECRET_ENV, "from the environment")
    assert Policy.load(path).secret == "from the environment"
    path.write_text("[]")
    with pytest.raises(ValueError):
        Policy.load(path)
    with pytest.raises(FileNotFoundError):
        Policy.load(tmp_path / "none.json")


def test_secret_is_not_shown():
    assert "hush" not in repr(Policy.default("hush"))
    with pytest.raises(ValueError):
        Policy("")


def test_entity_rules():
    policy = Policy("s", rules={"person": Rule(mode="redact"), "address": Rule(enabled=False)}, ner=True)
    assert {n: policy.prefix_of(n) for n in policy.masked_rules()} == {
        "person": "PERSON",
        "organization": "ORG",
        "location": "LOC",
    }
    assert policy.detectors() == []


def test_field_rules_can_be_added():
    assert Policy("s").with_field_rules(a=FieldRule(action="remove")).field_actions()["a"].action == "remove"
