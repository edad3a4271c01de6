"""Restoring texts with keys of any shape and any number, held in a table.

A key may be any string, so no pattern finds it. Every place of a text is tried against all keys at once:
rolling hashes of its first one, two, four or eight characters are looked up in a bitmap of what keys begin
with, and where that says yes, hashes of the whole lengths that such keys have in a bitmap of whole keys.
Both bitmaps have a fixed size and let every key through; what passes is joined to the keys by its text, so
nothing but the lengths of keys is known to the driver or to every task.

At a place the longest key wins, and the text goes on behind it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.arrow import map_tuples
from cloakframe.functions.spans import replace_spans

#: Characters that a key is first looked up by: the most of these that it has.
HEADS = (1, 2, 4, 8)
#: A bitmap has 2**BITS bits, however many keys there are.
BITS = 24
#: Characters of a text that are hashed at a time.
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mixed(values: np.ndarray, length: int) -> np.ndarray:
    values = values + np.uint64(length * _BASE & (1 << 64) - 1)
    values = (values ^ values >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ values >> np.uint64(29)


class Rolling:
    """Hashes of the stretches of a text, each from its place and length."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.size = codes.size
        ones = np.ones(1, np.uint64)
        powers = np.cumprod(np.concatenate([ones, np.full(self.size, _BASE, np.uint64)]))
        inverses = np.cumprod(np.concatenate([ones, np.full(self.size, _INVERSE, np.uint64)]))
        self.powers = powers
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * inverses[:-1])])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the stretches of ``length`` that begin at the places; they have to fit in."""
        ends = places + length
        return _mixed((self.sums[ends] - self.sums[places]) * self.powers[places], length)


def _head(length: int) -> int:
    return max(h for h in HEADS if h <= length)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """The packed bits of ``slot`` (from 0), from bitmaps of a fixed total size."""
    place = F.col("slot") + 1
    rows = (
        slots.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << BITS, bool)
    for bucket, packed in rows:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        out[(bucket - 1) * bits.size :][: bits.size] = bits
    return np.packbits(out)


def key_places(text: str, heads: np.ndarray, wholes: np.ndarray, lengths: dict[int, list[int]]) -> Iterator[tuple[int, int]]:
    """Place and length of every stretch that may be a key; those that are one are among them."""
    longest = max((n for own in lengths.values() for n in own), default=0)
    for start in range(0, len(text), CHUNK):
        rolling = Rolling(text[start : start + CHUNK + longest - 1])
        for head, own in lengths.items():
            first = np.arange(min(CHUNK, rolling.size - head + 1)) if rolling.size >= head else np.arange(0)
            places = first[heads[_slot(rolling.at(first, head))]]
            for length in own:
                fit = places[places + length <= rolling.size]
                hits = fit[wholes[_slot(rolling.at(fit, length))]]
                yield from ((start + p, length) for p in hits.tolist())


def leftmost_longest(hits: Iterable[tuple[int, str, str]]) -> list[tuple[int, int, str]]:
    """``start, end, value`` of the ``place, key, value`` that are put in, from left to right, the longest key at a place."""
    out, at = [], 0
    for place, key, value in sorted(hits, key=lambda h: (h[0], -len(h[1]))):
        if place >= at:
            at = place + len(key)
            out.append((place, at, value))
    return out


def demask_any_keys(df: DataFrame, mapping: DataFrame, text: str = "text") -> DataFrame:
    """Put the values of ``token, value`` back for keys of any shape, and add ``replacements``.

    Keys are compared character by character. A token that is null or empty, or whose value is null, is none; of
    several values of a token the smallest is taken. A null text stays null. Equal texts are looked up once, and
    only texts that hold a key are joined to their values. ``df`` and ``mapping`` are read more than once, so both
    should be stored.
    """
    spark = df.sparkSession
    keys = mapping.where("token <> '' AND value IS NOT NULL").groupBy("token").agg(F.min("value").alias("value"))

    def hashed(rows: Iterable[tuple]) -> Iterator[tuple]:
        for (token,) in rows:
            rolling, zero = Rolling(token), np.zeros(1, np.int64)
            head = _head(len(token))
            yield (
                len(token), head, int(_slot(rolling.at(zero, head))[0]), int(_slot(rolling.at(zero, len(token)))[0])
            )

    slots = map_tuples(keys.select("token"), hashed, "length int, head int, first long, whole long")
    lengths = defaultdict(list)
    # As many rows as there are lengths of keys.
    for length, head in slots.select("length", "head").distinct().collect():
        lengths[head].append(length)
    heads = spark.sparkContext.broadcast(_bitmap(slots.select(F.col("first").alias("slot"))))
    wholes = spark.sparkContext.broadcast(_bitmap(slots.select(F.col("whole").alias("slot"))))
    lengths = dict(lengths)

    def found(rows: Iterable[tuple]) -> Iterator[tuple]:
        first, whole = (np.unpackbits(b.value).astype(bool) for b in (heads, wholes))
        for print_, content in rows:
            for place, length in key_places(content, first, whole, lengths):
                yield print_, place, content[place : place + length]

    print_ = F.sha2(text, 256)
    texts = df.where(F.col(text).isNotNull()).select(print_.alias("print"), F.col(text).alias("text"))
    places = map_tuples(texts, found, "print string, place int, token string", 4096).distinct()
    # Both sides grow with the rows; their sizes are guessed from those of compressed files, far too small for a broadcast.
    hits = (
        places.hint("merge").join(keys, "token")
        .groupBy("print")
        .agg(F.collect_list(F.struct("place", "token", "value")).alias("hits"))
    )

    def chosen(rows: Iterable[tuple]) -> Iterator[tuple]:
        for print_, own in rows:
            spans = leftmost_longest((h["place"], h["token"], h["value"]) for h in own)
            yield print_, [{"start": start, "end": end, "value": value} for start, end, value in spans]

    put_in = map_tuples(hits, chosen, "_print string, _hits array<struct<start: int, end: int, value: string>>", 256)
    joined = df.join(put_in.hint("merge"), print_ == F.col("_print"), "left")
    spans = F.coalesce("_hits", F.array().cast("array<struct<start: int, end: int, value: string>>"))
    whole = F.when(F.col("_hits").isNull(), F.col(text)).otherwise(replace_spans(F.col(text), spans, lambda s: s["value"]))
    columns = [whole.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*columns, F.size(spans).cast("bigint").alias("replacements"))
