"""Masking plans over one text column of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.spans import (
    collect_spans,
    count_by_detector,
    mark_applied,
    replace_spans,
    resolve_overlaps,
)
from cloakframe.plans.policy import Policy

STAT_COLUMNS = ("matches_found", "matches_applied", "matches_skipped", "detector_counts")


def mask_text(text: Column, policy: Policy) -> Column:
    """Masked text as one Column; usable inside arrays, maps and structs."""
    spans = resolve_overlaps(collect_spans(text, policy.detectors()))
    return replace_spans(text, spans, policy.replacement)


def _stat_columns(found: Column, kept: Column) -> list[Column]:
    return [
        F.size(found).cast("bigint").alias("matches_found"),
        F.size(kept).cast("bigint").alias("matches_applied"),
        (F.size(found) - F.size(kept)).cast("bigint").alias("matches_skipped"),
        count_by_detector(kept).alias("detector_counts"),
    ]


def with_spans(
    df: DataFrame,
    policy: Policy,
    text: str = "text",
    found: str = "_found",
    kept: str = "_kept",
    extra: str | None = None,
) -> DataFrame:
    """Add the collected and the resolved spans, each staged as a column and so computed once."""
    entities = F.col(extra) if extra is not None else None
    return df.withColumn(found, collect_spans(F.col(text), policy.detectors(), entities)).withColumn(
        kept, resolve_overlaps(F.col(found))
    )


def mask_with_stats(df: DataFrame, policy: Policy, text: str = "text", extra: str | None = None) -> DataFrame:
    """Mask ``text`` in place and add the four statistics columns, in one pass."""
    others = [c for c in df.columns if c not in (text, extra)]
    masked = replace_spans(F.col(text), F.col("_kept"), policy.replacement).alias(text)
    return with_spans(df, policy, text, extra=extra).select(
        *others, masked, *_stat_columns(F.col("_found"), F.col("_kept"))
    )


def analyze_text(df: DataFrame, policy: Policy, text: str = "text", extra: str | None = None) -> DataFrame:
    """Statistics only; the text itself is not carried along."""
    others = [c for c in df.columns if c not in (text, extra)]
    return with_spans(df, policy, text, extra=extra).select(
        *others, *_stat_columns(F.col("_found"), F.col("_kept"))
    )


def explode_spans(df: DataFrame, spans: str, keys: list[str], with_value: bool) -> DataFrame:
    """One row per span.

    The outer explode with a filter on its output keeps Catalyst from copying the span
    expression into a size filter below it, which would run the detection twice.
    """
    fields = ["detector", F.col("s.start").alias("start"), F.col("s.end").alias("end")]
    rows = df.select(*keys, F.explode_outer(spans).alias("s")).where(F.col("s.detector").isNotNull())
    columns = [
        *keys,
        F.col("s.detector").alias("detector"),
        *fields[1:],
        (F.col("s.end") - F.col("s.start")).alias("length"),
        F.col("s.applied").alias("applied"),
    ]
    if with_value:
        columns.append(F.col("s.value").alias("value"))
    return rows.select(*columns)


def findings(
    df: DataFrame,
    policy: Policy,
    text: str = "text",
    keys: list[str] | None = None,
    with_value: bool = False,
    extra: str | None = None,
) -> DataFrame:
    """The findings table: one row per span, with ``applied`` telling whether it survived.

    Original values are left out unless asked for.
    """
    keys = keys if keys is not None else [c for c in df.columns if c not in (text, extra)]
    marked = mark_applied(F.col("_found"), F.col("_kept"))
    staged = with_spans(df, policy, text, extra=extra).withColumn("_marked", marked)
    return explode_spans(staged, "_marked", keys, with_value)
