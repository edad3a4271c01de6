"""Masking functions: keyed tokens, partial masks, format-preserving substitutes, redaction."""

from __future__ import annotations

import hashlib
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions.binding import let, matches

# --- fixed values -------------------------------------------------------------------------
TOKEN_HEX_LENGTH = 24
TOKEN_HEX_MIN = 8
TOKEN_HEX_MAX = 64
PLACEHOLDER = "***"
REDACTED = "[REDACTED]"
DIGITS = "0123456789"
LATIN_LOWER = "abcdefghijklmnopqrstuvwxyz"
LATIN_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC_LOWER = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
CYRILLIC_UPPER = "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
# --- end of fixed values ------------------------------------------------------------------

_SHA256_BLOCK = 64


def _hmac_pads(secret: str) -> tuple[str, str]:
    """Inner and outer key pads (RFC 2104) as hex."""
    if not secret:
        raise ValueError("the masking secret must not be empty")
    key = secret.encode("utf-8")
    if len(key) > _SHA256_BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_SHA256_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(value: Column, secret: str) -> Column:
    """HMAC-SHA256 of the UTF-8 bytes of ``value`` as lower-case hex."""
    inner, outer = _hmac_pads(secret)
    digest = F.sha2(F.concat(F.unhex(F.lit(inner)), value.cast("binary")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(digest)), 256)


def token_of(digest: Column, prefix: Column, length: int = TOKEN_HEX_LENGTH) -> Column:
    return F.concat(prefix, F.lit("_"), F.substring(digest, 1, length))


def mask_hmac(
    value: Column,
    secret: str,
    prefix: str | Column = "MASK",
    length: int = TOKEN_HEX_LENGTH,
) -> Column:
    """``PREFIX_`` and the first ``length`` hex digits of the keyed digest."""
    if not TOKEN_HEX_MIN <= length <= TOKEN_HEX_MAX:
        raise ValueError(f"token length must lie between {TOKEN_HEX_MIN} and {TOKEN_HEX_MAX}")
    label = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return token_of(hmac_sha256(value, secret), label, length)


def mask_partial(value: Column, visible: int = 2) -> Column:
    """Keep the ends of a value, or the head of an e-mail's local part and its domain."""
    if visible < 1:
        raise ValueError("at least one character has to stay visible")
    at = F.locate("@", value)
    local = F.when(at - 1 > visible, F.substring(value, 1, visible)).otherwise(F.lit(""))
    address = F.concat(local, F.lit(PLACEHOLDER), value.substr(at, F.length(value)))
    plain = F.when(F.length(value) <= visible * 2, F.lit(PLACEHOLDER)).otherwise(
        F.concat(F.substring(value, 1, visible), F.lit(PLACEHOLDER), F.right(value, F.lit(visible)))
    )
    return F.when(F.length(value) == 0, value).when(at > 1, address).otherwise(plain)


def mask_redact(prefix: str = "") -> Column:
    return F.lit(f"{prefix}_REDACTED" if prefix else REDACTED)


@cache
def _digit_like() -> str:
    """Non-ASCII characters with a digit value (decimal digits, super- and subscripts)."""
    return "".join(
        chr(code)
        for code in range(0x80, sys.maxunicode + 1)
        if unicodedata.digit(chr(code), None) is not None
    )


def _is_digit(char: Column) -> Column:
    ascii_digit = char.between("0", "9")
    # \p{L}\p{M}\p{P}\p{Z}\p{S} never hold digits, so the long list is met only by odd characters.
    odd = matches(char, r"\A[^\x00-\x7F\p{L}\p{M}\p{P}\p{Z}\p{S}]")
    return ascii_digit | (odd & (F.position(char, F.lit(_digit_like())) > 0))


def mask_preserve_format(value: Column, secret: str) -> Column:
    """Swap every letter and digit for one of the same class; keep everything else.

    Byte ``i`` of a key stream drives character ``i``; block ``n`` of the stream is the keyed
    digest of ``"n:value"``.
    """
    _hmac_pads(secret)

    def substitute(char: Column, byte: Column) -> Column:
        def pick(alphabet: str) -> Column:
            return F.lit(alphabet).substr(byte % len(alphabet) + 1, F.lit(1))

        return (
            F.when(_is_digit(char), pick(DIGITS))
            .when(char.between("a", "z"), pick(LATIN_LOWER))
            .when(char.between("A", "Z"), pick(LATIN_UPPER))
            .when(char.between("а", "я"), pick(CYRILLIC_LOWER))
            .when(char.between("А", "Я"), pick(CYRILLIC_UPPER))
            .otherwise(char)
        )

    def masked(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.length(v) - 1) / 32).cast("int"))
        stream = F.array_join(
            F.transform(blocks, lambda n: hmac_sha256(F.concat(n.cast("string"), F.lit(":"), v), secret)),
            "",
        )

        def spell(hex_stream: Column) -> Column:
            def one(char: Column, index: Column) -> Column:
                byte = F.conv(hex_stream.substr(index * 2 + 1, F.lit(2)), 16, 10).cast("int")
                return let(byte, lambda b: substitute(char, b))

            return F.array_join(F.transform(F.split(v, ""), one), "")

        return let(stream, spell)

    return F.when(F.length(value) == 0, value).when(value.isNotNull(), let(value, masked))
