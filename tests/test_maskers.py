"""Maskers and checksums on exact values."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from cloakframe.functions.checksums import is_valid_inn, is_valid_ipv4, is_valid_ogrn, is_valid_snils
from cloakframe.functions.maskers import hmac_sha256, mask_hmac, mask_partial, mask_preserve_format, mask_redact

VALUES = ["", "a", "admin@example.com", "Иван Ёжиков", "😀 x", "1234567890" * 20, " tab\t", "²٣"]


def column(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.o for r in df.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize("secret", ["s", "k" * 64, "долгий ключ " * 20])
def test_hmac(spark, secret):
    want = [hmac.new(secret.encode(), v.encode(), hashlib.sha256).hexdigest() for v in VALUES]
    assert column(spark, VALUES, lambda v: hmac_sha256(v, secret)) == want
    assert column(spark, VALUES, lambda v: mask_hmac(v, secret, "P")) == [f"P_{w[:24]}" for w in want]


def test_limits():
    with pytest.raises(ValueError):
        mask_hmac(F.lit("x"), "")
    for length in (7, 65):
        with pytest.raises(ValueError):
            mask_hmac(F.lit("x"), "s", "P", length)
    with pytest.raises(ValueError):
        mask_partial(F.lit("x"), 0)
    with pytest.raises(ValueError):
        mask_preserve_format(F.lit("x"), "")


def test_partial(spark):
    values = ["example@mail.ru", "ab@x.ru", "@x.ru", "1234567890", "ab", "abcd", "abcde", "", None]
    want = ["ex***@mail.ru", "***@x.ru", "@x***ru", "12***90", "***", "***", "ab***de", "", None]
    assert column(spark, values, mask_partial) == want
    assert column(spark, ["1234567890"], lambda v: mask_partial(v, 3)) == ["123***890"]


def test_redact(spark):
    assert column(spark, ["x"], lambda v: mask_redact("EMAIL")) == ["EMAIL_REDACTED"]
    assert column(spark, ["x"], lambda v: mask_redact()) == ["[REDACTED]"]


def expected_substitute(value, secret):
    stream = b"".join(
        hmac.new(secret.encode(), f"{n}:{value}".encode(), hashlib.sha256).digest() for n in range(len(value) // 32 + 1)
    )
    classes = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    classes += ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
    out = ""
    for i, c in enumerate(value):
        alphabet = classes[0] if c.isdigit() else next((a for a in classes if c in a), None)
        out += c if alphabet is None else alphabet[stream[i] % len(alphabet)]
    return out


def test_preserve_format(spark):
    values = [*VALUES, "+7 (999) 123-45-67", "x" * 32, "y" * 33]
    got = column(spark, values, lambda v: mask_preserve_format(v, "secret"))
    assert got == [expected_substitute(v, "secret") for v in values]
    assert column(spark, [None], lambda v: mask_preserve_format(v, "secret")) == [None]


@pytest.mark.parametrize(
    ("check", "good", "bad"),
    [
        (is_valid_inn, ["7707083893", "500100732259"], ["7707083894", "500100732258", "", "77070838", "77070838a3"]),
        (is_valid_ogrn, ["1027700132195", "304500116000157"], ["1027700132196", "10277001321", "x"]),
        (is_valid_snils, ["112-233-445 95", "11223344595"], ["112-233-445 96", "00223344595", "1"]),
        (is_valid_ipv4, ["0.0.0.0", "255.255.255.255"], ["256.1.1.1", "1.1.1.x"]),
    ],
)
def test_checksums(spark, check, good, bad):
    assert column(spark, good, check) == [True] * len(good)
    assert column(spark, bad, check) == [False] * len(bad)


def test_key_is_hidden_in_plans(spark):
    df = spark.createDataFrame([("x",)], "v string").select(mask_hmac(F.col("v"), "secret").alias("m"))
    pad = bytes(b ^ 0x36 for b in b"secret".ljust(64, b"\0")).hex()
    text = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")
    )
    assert pad not in text.lower()
