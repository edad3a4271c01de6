"""Near copies by SimHash, found with covering locality-sensitive hashing.

Every text has a 64-bit fingerprint of its word shingles. Two fingerprints are linked when they
differ in at most ``radius`` bits. Each of the ``2**(radius + 1) - 1`` tables keeps the bits of one
structured mask: bit ``i`` owns a code ``c(i)`` of ``radius + 1`` bits, and table ``v`` keeps the
bits whose code has odd overlap with ``v``. The codes of at most ``radius`` differing bits leave some
``v`` orthogonal to all of them, so every linked pair shares a bucket in some table: none is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import components, gram_hashes, map_rows, staged

WORDS = 4
RADIUS = 4
#: A bucket of more distinct fingerprints is split by the masks of its free bits.
BUCKET = 4096
_BLOCK = 1 << 16


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the shingles, repeats included; 0 for a text without words. A null counts as empty."""
    hashes = gram_hashes((text or "").encode("utf-8", "replace").lower().split(), words)
    ones = np.zeros(64, np.int64)
    for start in range(0, hashes.size, _BLOCK):
        block = hashes[start : start + _BLOCK].astype(">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > hashes.size).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def covering_masks(fixed: int = 0, radius: int = RADIUS) -> list[int]:
    """The masks over the bits that ``fixed`` leaves free, each with the fixed bits added."""
    tables = range(1, 1 << (radius + 1))
    # Single bits first: with more free bits than the radius every table then keeps at least one of them.
    codes = sorted(tables, key=lambda code: (code.bit_count(), code))
    free = [i for i in range(64) if not fixed >> i & 1]
    return [
        fixed | sum(1 << bit for place, bit in enumerate(free) if (codes[place % len(codes)] & table).bit_count() % 2)
        for table in tables
    ]


def forest(prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links that join exactly what the links among these distinct fingerprints join, one fewer than members.

    A breadth-first search that compares each member with those not yet reached, so a dense bucket costs
    about its size and not its pairs.
    """
    left = prints
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                for other in found.tolist():
                    yield int(at), other


def _bucket_links(rows: Iterable[tuple], radius: int, limit: int) -> Iterator[tuple]:
    """Rows ``mask, key, fp`` sorted by bucket become links, or rows of finer buckets where one is too full."""
    current, members, finer = None, [], None

    def finish() -> Iterator[tuple]:
        if current is not None and finer is None and len(members) > 1:
            prints = np.array(members, np.int64).view(np.uint64)
            for a, b in forest(prints, radius):
                yield None, None, signed(a), signed(b)

    def refined() -> Iterator[tuple]:
        for member in members:
            for mask in finer:
                yield signed(mask), signed(member & mask), member, None

    for mask, key, print_ in rows:
        if (mask, key) != current:
            yield from finish()
            current, members, finer = (mask, key), [], None
        members.append(print_)
        if finer is None and len(members) > limit:
            finer = covering_masks(mask & (1 << 64) - 1, radius)
        if finer is not None:
            yield from refined()
            members.clear()
    yield from finish()


def hamming_links(prints: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """Links ``u, v`` that join the distinct fingerprints ``fp`` (long) within ``radius`` bits.

    They have the same components as all linked pairs, without being all of them. A bucket of more than
    ``limit`` fingerprints moves on to the masks over its free bits, which halve them again; the guarantee
    holds at each level, and a level ends with at most ``2**free bits`` members, so no bucket stays too full.
    """
    table = F.explode(F.array(*[F.lit(signed(m)) for m in covering_masks(0, radius)]))
    key = F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    rows = prints.select("fp", table.alias("mask")).select("mask", key, "fp")
    found = []
    while True:
        out = map_rows(
            rows.repartition("mask", "key").sortWithinPartitions("mask", "key"),
            lambda part: _bucket_links(part, radius, limit),
            "mask long, key long, u long, v long",
            4096,
        )
        out = staged(out, "buckets")
        found.append(out.where("mask is null").select("u", "v"))
        finer = out.where("mask is not null")
        if finer.isEmpty():
            break
        rows = finer.select("mask", "key", F.col("u").alias("fp"))
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def _grouped(docs: DataFrame, text: str, key: str, words: int, radius: int) -> DataFrame:
    """``name, fp, root, component_id`` of each document; ``root`` names the group."""

    def prints(rows):
        for name, content in rows:
            yield name, signed(fingerprint(content, words))

    source = docs.select(F.col(key).alias("name"), F.col(text).alias("content"))
    kind = source.schema["name"].dataType.simpleString()
    each = staged(map_rows(source, prints, f"name {kind}, fp long", 4096), "fingerprints")
    known = staged(each.groupBy("fp").agg(F.min("name").alias("first")), "distinct")
    member = components(hamming_links(known.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = known.join(member, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return each.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def simhash_groups(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """One row ``key, fingerprint, component_id`` per document.

    ``fingerprint`` has 16 hex digits; ``component_id`` is the smallest key that links reach, its own
    included. Null texts count as empty, and all texts without words share fingerprint 0. A repeated row
    gives a repeated result; a null key is no ``component_id`` unless its whole group has null keys.
    An empty table gives no rows, and other columns are not looked at.

    Copies meet in one fingerprint by partial aggregation before any search, so a hot text costs one entry.
    """
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    rows = _grouped(docs, text, key, words, radius)
    return rows.select(F.col("name").alias(key), digits.alias("fingerprint"), "component_id")


def one_of_each_group(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, radius: int = RADIUS
) -> DataFrame:
    """One document of each group, with all its columns: the one of the smallest key, then fingerprint.

    Of repeated rows of that key and fingerprint the smallest text stays. Only keys and fingerprints are
    grouped; the texts move once, in the join with the kept keys.
    """

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(t, words)) for t in texts], dtype="int64")

    # Else the filter would move below the join, to all documents.
    print_of = print_of.asNondeterministic()
    rows = staged(_grouped(docs, text, key, words, radius), "groups")
    first = rows.groupBy("root").agg(F.min(F.struct("name", "fp")).alias("kept")).select("kept.*")
    copies = rows.groupBy("name").agg((F.count("*") > 1).alias("again")).withColumnRenamed("name", "known")
    first = staged(first.join(copies, F.col("name").eqNullSafe(F.col("known"))).drop("known"), "first")
    single = first.where("not again").select(F.col("name").alias("kept"))
    kept = docs.join(single, docs[key].eqNullSafe(single["kept"]), "left_semi")
    several = first.where("again").select(F.struct("name", "fp").alias("kept"))
    if several.isEmpty():
        return kept
    content = F.col(f"row.`{text}`")
    again = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        .join(several, F.col(f"row.`{key}`").eqNullSafe(F.col("kept.name")))
        .where(print_of(content) == F.col("kept.fp"))
        .groupBy("kept")
        .agg(F.min_by("row", F.coalesce(content, F.lit(""))).alias("row"))
        .select("row.*")
    )
    return kept.unionByName(again)
