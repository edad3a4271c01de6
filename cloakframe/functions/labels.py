"""Names: entity labels, field names, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.binding import let

# --- fixed values -------------------------------------------------------------------------
LABEL_ALIASES = {
    "PER": "person",
    "PERSON": "person",
    "FULL_NAME": "person",
    "NAME": "person",
    "ORG": "organization",
    "ORGANIZATION": "organization",
    "COMPANY": "organization",
    "BANK": "organization",
    "BANK_BRANCH": "organization",
    "LEGAL_ENTITY": "organization",
    "INDIVIDUAL_ENTREPRENEUR": "organization",
    "LOC": "location",
    "LOCATION": "location",
    "GPE": "location",
    "ADDRESS": "address",
    "DOCUMENT": "document",
    "BANK_ACCOUNT": "bank_account",
}
SOURCE_PRIORITIES = {"spacy": 30, "natasha": 20, "qwen": 15, "gliner": 10}
SENSITIVE_FIELDS = (
    "value", "text", "content", "source_text", "raw",
    "email", "phone",
    "fio", "name", "surname", "firstname", "lastname", "patronymic",
    "address", "street", "city",
    "inn", "guid", "snils", "passport", "ogrn", "kpp",
    "account", "bik", "card", "iban",
    "login", "username", "password", "token", "secret",
    "url", "domain", "ip", "host",
)
SUPPORTED_SUFFIXES = (".txt", ".log", ".docx", ".xlsx", ".sql", ".csv", ".xml", ".json")
# Of those, the office formats have no reader here.
READABLE_SUFFIXES = tuple(s for s in SUPPORTED_SUFFIXES if s not in (".docx", ".xlsx"))
# --- end of fixed values ------------------------------------------------------------------


def _map_of(values: dict) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def normalize_entity_type(label: Column) -> Column:
    """Model label to entity type: known aliases first, else the label in lower case."""
    # Python's str.strip cuts every kind of white space.
    bare = F.regexp_replace(label, r"(?U)\A\s+|\s+\z", "")
    return let(
        F.upper(F.translate(bare, "- ", "__")),
        lambda name: F.coalesce(F.try_element_at(_map_of(LABEL_ALIASES), name), F.lower(name)),
    )


def source_priority(source: Column) -> Column:
    """Priority of a candidate's source; unknown sources get 0."""
    return F.coalesce(F.try_element_at(_map_of(SOURCE_PRIORITIES), source), F.lit(0))


def local_name(name: Column) -> Column:
    """XML name without its ``{namespace}``."""
    return F.regexp_replace(name, r"\A.*\}", "")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty when there is none (also for ``.name``)."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))


def file_stem(path: Column) -> Column:
    return let(
        file_name(path),
        lambda name: name.substr(F.lit(1), F.length(name) - F.length(file_suffix(name))),
    )


def safe_file_name(path: Column) -> Column:
    return F.regexp_replace(F.trim(file_name(path)), r"[^A-Za-z0-9._-]+", "_")


def is_supported_file(path: Column) -> Column:
    return file_suffix(path).isin(*SUPPORTED_SUFFIXES)


def output_label(path: Column, kind: str = "masked") -> Column:
    """``{stem}.masked{suffix}`` (or ``.demasked``) of a path, made of safe characters."""
    if kind not in ("masked", "demasked"):
        raise ValueError("kind has to be 'masked' or 'demasked'")
    return let(
        safe_file_name(path),
        lambda name: F.concat(file_stem(name), F.lit(f".{kind}"), file_suffix(name)),
    )
