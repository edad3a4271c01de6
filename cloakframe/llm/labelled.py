"""Labelled rows for fitting: a bounded sample of those that are not held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import staged

FOLDS = 5


def held_out(key: str = "doc_id") -> Column:
    """The fold that no label is learned from. A row without key is not held out, and has no label."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sample(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, dict[int, int]]:
    """``text, label`` of at most ``bound`` texts of each label value, picked by a hash of their keys, and how many
    texts of each value there are in all.

    Keys labelled both ways, null labels and held-out rows are left out, and equal texts count once, under the
    label of their smallest key. The counts are over all rows: a fit weights by them what it draws from the
    sample, so that its results do not hang on whether the bound binds. The bound also bounds what the second
    join may broadcast and what a fit sees.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
        .groupBy(key)
        .agg(F.min(label).cast("int").alias("label"), F.max(label).alias("most"))
        .where("label = most")
        .select(F.col(key).alias("known"), "label")
    )
    content = F.coalesce(text, F.lit(""))
    prints = docs.select(F.col(key).alias("known"), F.sha2(content, 256).alias("print")).join(known, "known")
    texts = staged(prints.groupBy("print").agg(F.min(F.struct("known", "label")).alias("r")).select("print", "r.*"), "texts")
    counts = {0: 0, 1: 0} | {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("known")
    parts = [texts.where(F.col("label") == value).orderBy(order, "known", "print").limit(bound) for value in (0, 1)]
    mark = F.xxhash64("print").alias("mark")  # short, so that the picked keys are few bytes to broadcast
    picked = staged(parts[0].unionByName(parts[1]).select("known", mark, "label"), "picked")
    rows = docs.select(F.col(key).alias("known"), content.alias("text")).join(picked, "known")
    rows = rows.select("*", F.sha2("text", 256).alias("print")).where(F.col("mark") == mark)
    return staged(rows.groupBy("print").agg(F.min_by(F.struct("text", "label"), "known").alias("r")).select("r.*"), "sample"), counts


def weights(counts: dict[int, int], sampled: dict[int, int]) -> dict[int, float]:
    """What a sampled text of each kind stands for, in texts of the kind that is sampled most densely."""
    stands = {kind: counts[kind] / n for kind, n in sampled.items() if n}
    return {kind: value / min(stands.values()) for kind, value in stands.items()}
