"""Which spans lost, and to which: reports on overlap resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.binding import let
from cloakframe.functions.spans import lost_spans
from cloakframe.plans.masking import with_spans
from cloakframe.plans.policy import Policy


def overlap_conflicts(df: DataFrame, policy: Policy, keys: list[str], text: str = "text") -> DataFrame:
    """Every skipped span with the applied spans it overlaps.

    The applied spans of a text do not overlap each other, so those that a skipped span meets stand next to
    each other: from the first that ends behind its start to the last that starts before its end.
    """
    staged = with_spans(df, policy, text).withColumn("_lost", lost_spans(F.col("_found"), F.col("_kept")))

    def met_by(lost: Column, kept: Column) -> Column:
        ends, starts = F.transform(kept, lambda k: k["end"]), F.transform(kept, lambda k: k["start"])
        passed = _marks_before(F.transform(lost, lambda s: s["start"]), ends, ties=True)
        reached = _marks_before(F.transform(lost, lambda s: s["end"]), starts, ties=False)
        ranges = F.arrays_zip(lost.alias("lost"), passed.alias("low"), reached.alias("high"))
        return F.flatten(
            F.transform(
                ranges,
                lambda r: F.transform(
                    F.slice(kept, r["low"] + 1, r["high"] - r["low"]), lambda k: F.struct(r["lost"].alias("lost"), k.alias("kept"))
                ),
            )
        )

    pairs = let(F.col("_lost"), lambda lost: let(F.col("_kept"), lambda kept: met_by(lost, kept)))
    rows = staged.select(*keys, F.explode_outer(pairs).alias("p")).where(F.col("p.lost.detector").isNotNull())
    return rows.select(
        *keys,
        F.col("p.lost.detector").alias("lost_detector"),
        F.col("p.lost.start").alias("lost_start"),
        F.col("p.lost.end").alias("lost_end"),
        F.col("p.kept.detector").alias("kept_detector"),
        F.col("p.kept.start").alias("kept_start"),
        F.col("p.kept.end").alias("kept_end"),
    )


def _marks_before(points: Column, marks: Column, ties: bool) -> Column:
    """How many marks lie before each point (or at it, with ``ties``), by sorting both together once."""
    both = F.array_sort(
        F.concat(
            F.transform(marks, lambda m: F.struct(m.alias("at"), F.lit(not ties).alias("late"), F.lit(-1).alias("id"))),
            F.transform(points, lambda p, i: F.struct(p.alias("at"), F.lit(ties).alias("late"), i.alias("id"))),
        )
    )
    placed = F.transform(both, lambda x, i: F.struct(x["id"].alias("id"), i.alias("i")))
    # As many points as its own number among the points stand before it, and all else are marks.
    counts = F.transform(
        F.filter(placed, lambda x: x["id"] >= 0), lambda x, j: F.struct(x["id"].alias("id"), (x["i"] - j).alias("n"))
    )
    return F.transform(F.array_sort(counts), lambda x: x["n"])


def skipped_findings(df: DataFrame, policy: Policy, keys: list[str], text: str = "text") -> DataFrame:
    """Spans found but not applied."""
    staged = with_spans(df, policy, text).withColumn("_lost", lost_spans(F.col("_found"), F.col("_kept")))
    rows = staged.select(*keys, F.explode_outer("_lost").alias("s")).where(F.col("s.detector").isNotNull())
    return rows.select(
        *keys,
        F.col("s.detector").alias("detector"),
        F.col("s.start").alias("start"),
        F.col("s.end").alias("end"),
    )
