"""Benchmark decontamination by winnowing.

A text keeps, of every ``w`` neighbouring k-grams, the one of smallest hash. With ``k + w - 1`` the
window length, two texts that share a window keep a common k-gram inside it. Kept grams of documents
and of benchmark items are joined, and every hit is extended word by word on both sides: where the
common run is as long as a window, its words are hit. Items shorter than a window are sought whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cloakframe.llm.common import map_rows, staged

WINDOW = 13
GRAM = 5
#: A document is contaminated when at least one word in so many is hit.
SHARE = 20
#: Slots of the filter that spares the join grams no item has; it has this many bits at any input size.
SLOT_BITS = 23

# Bytes of a word: digits, letters in lower case and everything beyond ASCII; all else parts words.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_GRAM = "hash long, span int, place int, left int, words string"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` word hashes."""
    total = np.zeros(max(0, words.size - k + 1), np.uint64)
    for i in range(k if total.size else 0):
        total = total * _FACTOR + words[i : i + total.size]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ total >> np.uint64(32)


def winnowed(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest hash of every ``width`` neighbours, the last one of equals."""
    if hashes.size < width:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], width)
    first = view.argmin(axis=1) + np.arange(view.shape[0])
    return np.unique(hashes.size - 1 - first)


def _grams(words: list[bytes], spans: dict[int, int], slots: np.ndarray | None) -> list[tuple]:
    """Kept grams of one text: ``spans`` maps the length of a gram to how many neighbours choose one."""
    hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out = []
    for span, width in spans.items():
        grams = rolled(hashes, span)
        places = winnowed(grams, width) if width > 1 else np.arange(grams.size)
        if slots is not None:
            places = places[slots[(grams[places] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]]
        around = width - 1
        for place in places.tolist():
            low = max(0, place - around)
            near = b" ".join(words[low : place + span + around]).decode("utf-8", "replace")
            out.append((int(grams[place].view(np.int64)), span, place, place - low, near))
    return out


def _common(mine: list[str], at: int, other: list[str], there: int, span: int) -> tuple[int, int]:
    """How many equal words lie left and right of equal grams; (-1, -1) where the grams differ."""
    if mine[at : at + span] != other[there : there + span]:
        return -1, -1
    left = right = 0
    while left < min(at, there) and mine[at - 1 - left] == other[there - 1 - left]:
        left += 1
    mine, other = mine[at + span :], other[there + span :]
    while right < min(len(mine), len(other)) and mine[right] == other[right]:
        right += 1
    return left, right


def item_grams(items: DataFrame, key: str, text: str, window: int, gram: int) -> DataFrame:
    """``item`` and its kept grams; an item shorter than the window is one gram."""

    def grams(rows: Iterable[tuple]) -> Iterator[tuple]:
        for name, content in rows:
            words = words_of(content)
            if words:
                spans = {gram: window - gram + 1} if len(words) >= window else {len(words): 1}
                yield from ((name, *g) for g in _grams(words, spans, None))

    return map_rows(items.select(key, text), grams, f"item {items.schema[key].dataType.simpleString()}, {_GRAM}")


def _slots(grams: DataFrame) -> np.ndarray:
    """Which slots the grams fall in, from bitmaps of a fixed total size."""
    slot = F.shiftrightunsigned("hash", 64 - SLOT_BITS) + 1  # buckets and their bits count from 1
    bits = (
        grams.groupBy(F.bitmap_bucket_number(slot).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << SLOT_BITS, bool)
    for bucket, packed in bits:
        unpacked = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        out[(bucket - 1) * unpacked.size :][: unpacked.size] = unpacked
    return out


def _judged(
    docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int, gram: int, share: int
) -> DataFrame:
    """``contamination`` under the names ``name`` and ``print``, a hash of the text."""
    item_rows = staged(item_grams(items, item_key, item_text, window, gram), "items")
    short = sorted(r[0] for r in item_rows.where(F.col("span") != gram).select("span").distinct().collect())
    # An item that is just one gram long is sought at every place, as other short ones.
    whole = [gram] if not item_rows.where((F.col("span") == gram) & (F.size(F.split("words", " ")) == gram)).isEmpty() else []
    slots = docs.sparkSession.sparkContext.broadcast(np.packbits(_slots(item_rows)))

    def grams(rows: Iterable[tuple]) -> Iterator[tuple]:
        known = np.unpackbits(slots.value).astype(bool)
        for name, print_, content in rows:
            words = words_of(content)
            kept = _grams(words, {gram: window - gram + 1} | dict.fromkeys(short, 1), known) if words else []
            for span in whole:
                kept += [g for g in _grams(words, {span: 1}, known)]
            yield name, print_, len(words), [dict(zip(("hash", "span", "place", "left", "words"), g, strict=True)) for g in kept]

    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(key, F.xxhash64(text), text)
    found = f"array<struct<{', '.join(f'{n}: {t}' for n, t in (f.split() for f in _GRAM.split(', ')))}>>"
    read = map_rows(source, grams, f"name {kind}, print long, n_words long, grams {found}")
    read = staged(read.withColumn("row", F.monotonically_increasing_id()), "grams")

    mine = read.select("row", F.explode("grams").alias("g")).select("row", "g.*")
    theirs = item_rows.select("item", "hash", "span", F.col("left").alias("there"), F.col("words").alias("item_words"))

    def extended(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row, place, at, mine_, item, there, other, span in rows:
            other = other.split(" ")
            need = min(window, len(other)) if span == len(other) else window
            left, right = _common(mine_.split(" "), at, other, there, span)
            if left >= 0 and left + span + right >= need:
                yield row, item, place - left, place + span + right

    matched = mine.join(theirs, ["hash", "span"]).select(
        "row", "place", "left", "words", "item", "there", "item_words", "span"
    )
    item_kind = items.schema[item_key].dataType.simpleString()
    hits = staged(map_rows(matched, extended, f"row long, item {item_kind}, low int, high int", 4096), "hits")

    before = Window.partitionBy("row").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    covered = (
        hits.select("row", "low", "high")
        .distinct()
        .withColumn("done", F.coalesce(F.max("high").over(before), F.lit(0)))
        .groupBy("row")
        .agg(F.sum(F.greatest(F.col("high") - F.greatest("low", "done"), F.lit(0))).alias("n_hit"))
    )
    named = (
        hits.select("row", F.col("item").cast("string").alias("item"))
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return (
        read.drop("grams")
        .join(covered, "row", "left")
        .join(named, "row", "left")
        .select(
            "name",
            "print",
            "n_words",
            n_hit.alias("n_hit"),
            F.size(names).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        )
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    share: int = SHARE,
) -> DataFrame:
    """One row per document: ``n_words, n_hit, n_items, items_sha256, contaminated``.

    A document word is hit when it lies in an occurrence of ``window`` neighbouring words of an item, or of
    a whole item that is shorter. Null texts have no words, and items without words have no windows. A
    repeated document is a row of its own. Items of equal key count once; a null item key marks words but
    is not among the items. Empty tables and unrelated columns do no harm.

    A document is read once, into rows of its own number, count and grams that pass the filter. Only those
    grams are shuffled. The filter is a bitmap of fixed size and lets through every gram an item has.
    """
    out = _judged(docs, items, key, text, item_key, item_text, window, gram, share)
    return out.drop("print").withColumnRenamed("name", key)


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that are not contaminated, with all their columns. Keys and hashes of the others are joined away."""
    judged = _judged(docs, items, key, text, "item_id", "text", WINDOW, GRAM, SHARE)
    out = judged.where("contaminated").select("name", "print").distinct()
    same = docs[key].eqNullSafe(out["name"]) & (F.xxhash64(docs[text]) == out["print"])
    return docs.join(out, same, "left_anti")
