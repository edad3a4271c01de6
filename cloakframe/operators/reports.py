"""Report aggregates: per file, per batch, per detector, per column; audit events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.plans.policy import Policy


def _sums(rows: DataFrame, keys: Sequence[str], totals: dict[str, Column], counts: str, name: str) -> DataFrame:
    """Sums of ``totals`` by ``keys`` and the map ``name`` of all detectors' counts.

    Each row is taken apart into its totals and its counts, which are summed by detector with partial
    aggregation; a key then has one row per detector, so the map is small and no detector is lost.
    """
    kind = F.lit(None).cast("string")
    own = F.struct(kind.alias("detector"), F.lit(0).cast("bigint").alias("n"), *[c.cast("bigint").alias(t) for t, c in totals.items()])
    zeros = [F.lit(0).cast("bigint").alias(t) for t in totals]
    found = F.coalesce(F.map_entries(counts), F.array().cast("array<struct<key:string,value:bigint>>"))
    parts = F.transform(found, lambda e: F.struct(e["key"].alias("detector"), e["value"].alias("n"), *zeros))
    # Never empty; an inner explode would copy what the counts are made of into a filter on their size.
    taken = rows.select(*keys, F.explode_outer(F.concat(F.array(own), parts)).alias("p")).select(*keys, "p.*")
    each = taken.groupBy(*keys, "detector").agg(*[F.sum(c).alias(c) for c in ("n", *totals)])
    entry = F.when(F.col("detector").isNotNull() & (F.col("n") > 0), F.struct("detector", "n"))
    return each.groupBy(*keys).agg(
        *[F.coalesce(F.sum(t), F.lit(0)).cast("bigint").alias(t) for t in totals],
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name),
    )


def file_report(stats: DataFrame, by: str | list[str], failures: DataFrame | None = None) -> DataFrame:
    """Sum the statistics columns of texts, cells, lines or literals per file, for all detectors seen.

    ``failures`` holds files that could not be read, with the same key columns and a ``message``.
    """
    keys = [by] if isinstance(by, str) else list(by)
    names = ("matches_found", "matches_applied", "matches_skipped")
    report = _sums(stats, keys, {n: F.col(n) for n in names}, "detector_counts", "detector_counts").select(
        *keys,
        F.lit(True).alias("success"),
        F.lit("OK").alias("message"),
        *names,
        "detector_counts",
        F.lit(False).alias("timed_out"),
    )
    if failures is None:
        return report
    zero = F.lit(0).cast("bigint")
    failed = failures.select(
        *keys,
        F.lit(False).alias("success"),
        F.col("message").alias("message"),
        zero.alias("matches_found"),
        zero.alias("matches_applied"),
        zero.alias("matches_skipped"),
        F.create_map().cast("map<string,bigint>").alias("detector_counts"),
        (F.col("timed_out") if "timed_out" in failures.columns else F.lit(False)).alias("timed_out"),
    )
    good = report.join(failures.select(*keys).distinct(), keys, "left_anti")
    return good.unionByName(failed)


def run_report(rows: DataFrame, by: str | list[str], what: str = "document") -> DataFrame:
    """The file report of rows that also tell by ``failed`` what could not be read: one pass over what was masked.

    A file with a failed row is a failed file without matches; its message counts the rows.
    """
    keys = [by] if isinstance(by, str) else list(by)
    names = ("matches_found", "matches_applied", "matches_skipped")
    totals = {n: F.col(n) for n in names} | {"_failed": F.col("failed").cast("int")}
    sums = _sums(rows, keys, totals, "detector_counts", "detector_counts")
    good = F.col("_failed") == 0
    message = F.concat(F.lit(f"ValueError: malformed {what}, records: "), F.col("_failed").cast("string"))
    return sums.select(
        *keys,
        good.alias("success"),
        F.when(good, F.lit("OK")).otherwise(message).alias("message"),
        *[F.when(good, F.col(n)).otherwise(F.lit(0).cast("bigint")).alias(n) for n in names],
        F.when(good, F.col("detector_counts")).otherwise(F.create_map().cast("map<string,bigint>")).alias("detector_counts"),
        F.lit(False).alias("timed_out"),
    )


def batch_report(files: DataFrame) -> DataFrame:
    """One row of totals over a file report, for all detectors seen."""
    totals = {
        "total": F.lit(1),
        "success": F.col("success").cast("int"),
        "failed": (~F.col("success")).cast("int"),
        "total_matches_found": F.col("matches_found"),
        "total_matches_applied": F.col("matches_applied"),
        "total_matches_skipped": F.col("matches_skipped"),
        "timeout_count": F.col("timed_out").cast("int"),
    }
    return _sums(files, [], totals, "detector_counts", "detector_totals").select(*totals, "detector_totals")


def batch_document(files: DataFrame) -> DataFrame:
    """The batch report as one JSON document per file row and one of totals: ``kind, document``."""
    totals = batch_report(files).select(F.lit("statistics").alias("kind"), F.to_json(F.struct("*")).alias("document"))
    each = files.select(F.lit("file").alias("kind"), F.to_json(F.struct("*")).alias("document"))
    return totals.unionByName(each)


def detector_totals(findings: DataFrame, by: str | None = None) -> DataFrame:
    """Applied spans per detector; with ``by`` also per group, the overall rows having a null group."""
    applied = findings.where("applied")
    if by is None:
        return applied.groupBy("detector").agg(F.count(F.lit(1)).alias("n"))
    return (
        applied.groupingSets([(F.col(by), F.col("detector")), (F.col("detector"),)], by, "detector")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(by, "detector", "n")
    )


def column_profile(df: DataFrame, policy: Policy, columns: Sequence[str] | None = None) -> DataFrame:
    """Sensitivity of each string column: non-empty cells, cells with a hit, spans per detector.

    Cells become rows of column name and text, so detection stands in the plan once; they are summed by
    column and detector before anything is shuffled. A column without rows has zeros.
    """
    from cloakframe.operators.fields import string_columns
    from cloakframe.functions.spans import collect_spans, count_by_detector, resolve_overlaps

    names = list(columns) if columns is not None else string_columns(df)
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("cell")) for n in names])
    kind = "array<struct<column_name:string,cell:string>>"
    cells = df.select(F.explode(pairs.cast(kind)).alias("c")).select("c.*")
    spans = cells.withColumn("_kept", resolve_overlaps(collect_spans(F.col("cell"), policy.detectors())))
    counted = spans.select(
        "column_name",
        (F.coalesce(F.length("cell"), F.lit(0)) > 0).cast("bigint").alias("cells"),
        (F.size("_kept") > 0).cast("bigint").alias("cells_hit"),
        count_by_detector(F.col("_kept")).alias("detector_counts"),
    )
    zero = F.lit(0).cast("bigint")
    listed = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("column_name"))
    zeros = listed.select("column_name", zero.alias("cells"), zero.alias("cells_hit"), F.create_map().cast("map<string,bigint>").alias("detector_counts"))
    totals = {"cells": F.col("cells"), "cells_hit": F.col("cells_hit")}
    return _sums(counted.unionByName(zeros), ["column_name"], totals, "detector_counts", "detector_counts").select(
        "column_name",
        "cells",
        "cells_hit",
        F.when(F.col("cells") > 0, F.col("cells_hit") / F.col("cells")).alias("hit_share"),
        "detector_counts",
    )


def audit_events(
    files: DataFrame,
    source: str,
    destination: Column | None = None,
    overwrite: bool = False,
) -> DataFrame:
    """Audit trail of a file report: a start event per file, and an end event if it succeeded."""
    from cloakframe.functions.labels import file_suffix

    suffix = file_suffix(F.col(source).cast("string"))
    zero = F.lit(0).cast("bigint")

    def event(kind: str, found: Column, applied: Column, skipped: Column, metadata: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("event_type"),
            found.alias("matches_found"),
            applied.alias("matches_applied"),
            skipped.alias("matches_skipped"),
            metadata.alias("metadata"),
        )

    started = event(
        "file_processing_started",
        zero,
        zero,
        zero,
        F.create_map(F.lit("suffix"), suffix, F.lit("overwrite"), F.lit(str(overwrite).lower())),
    )
    finished = event(
        "file_processing_finished",
        F.col("matches_found"),
        F.col("matches_applied"),
        F.col("matches_skipped"),
        F.create_map(F.lit("suffix"), suffix),
    )
    events = F.when(F.col("success"), F.array(started, finished)).otherwise(F.array(started))
    return files.select(
        F.col(source).cast("string").alias("source"),
        (destination if destination is not None else F.lit(None).cast("string")).alias("destination"),
        F.explode(events).alias("e"),
    ).select(
        "e.event_type",
        "source",
        "destination",
        F.lit(None).cast("string").alias("detector"),
        "e.matches_found",
        "e.matches_applied",
        "e.matches_skipped",
        # Tasks share files, so only a caller can know how long one took.
        (F.col("duration_ms") if "duration_ms" in files.columns else F.lit(None)).cast("bigint").alias("duration_ms"),
        "e.metadata",
    )


def demask_report(restored: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replacements made and size of the mapping, as one row."""
    done = restored.agg(F.coalesce(F.sum("replacements"), F.lit(0)).cast("bigint").alias("replacements"))
    size = mapping.agg(F.count(F.lit(1)).alias("mapping_size"))
    return done.select(
        "replacements", F.lit(None).cast("bigint").alias("mapping_size")
    ).unionByName(
        size.select(F.lit(None).cast("bigint").alias("replacements"), "mapping_size")
    ).agg(F.max("replacements").alias("replacements"), F.max("mapping_size").alias("mapping_size"))
