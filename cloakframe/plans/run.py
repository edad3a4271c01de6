"""Masking and reporting in one pass: totals are observed while the masked rows are written.

Spark counts the rows of an observed DataFrame as they pass, so nothing is scanned or masked twice for a report.
A stream delivers the same totals with each micro-batch's progress.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from cloakframe.plans.masking import mask_with_stats
from cloakframe.plans.policy import Policy

_SUMS = ("matches_found", "matches_applied", "matches_skipped")


def _totals(policy: Policy) -> list[Column]:
    """Sums over the statistics columns; the detectors of a policy are known, so each has a sum of its own."""
    count = lambda name: F.coalesce(F.try_element_at("detector_counts", F.lit(name)), F.lit(0))
    return [
        F.count(F.lit(1)).alias("texts"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMS],
        *[F.coalesce(F.sum(count(n)), F.lit(0)).alias(f"detector {n}") for n in policy.detector_names()],
    ]


def _named(found: dict) -> dict:
    """The totals, with those of detectors as one dict of what was seen."""
    counts = {k.removeprefix("detector "): v for k, v in found.items() if k.startswith("detector ") and v}
    return {k: found[k] for k in ("texts", *_SUMS)} | {"detector_totals": counts}


def mask_and_report(
    df: DataFrame, policy: Policy, write: Callable[[DataFrame], None], text: str = "text", with_stats: bool = False
) -> dict:
    """Hand the masked rows to ``write``, which writes them, and return the totals of what was written.

    ``write`` gets the columns of ``df``, with the statistics columns if ``with_stats``, and has to run one action
    over all rows. Tasks that are run again count once.
    """
    seen = Observation()
    masked = mask_with_stats(df, policy, text).observe(seen, *_totals(policy))
    write(masked if with_stats else masked.select(*df.columns))
    return _named(seen.get)


def observed_stream(masked: DataFrame, policy: Policy, name: str) -> DataFrame:
    """A masked stream (see ``streams.mask_stream``) whose progress carries the totals under ``name``."""
    return masked.observe(name, *_totals(policy))


class StreamTotals(StreamingQueryListener):
    """Adds up the totals that ``observed_stream`` reports under a name, over all micro-batches seen.

    Register it with ``spark.streams.addListener``; progress arrives after its batch, in another thread.
    """

    def __init__(self, name: str) -> None:
        super().__init__()
        self.name = name
        self.batches: dict[tuple[str, int], dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        row = progress.observedMetrics.get(self.name)
        if row is not None:
            # A batch that is run again replaces what it had reported.
            self.batches[(str(progress.id), progress.batchId)] = _named(row.asDict())

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def totals(self) -> dict:
        out = {"texts": 0, **dict.fromkeys(_SUMS, 0), "detector_totals": {}}
        for batch in list(self.batches.values()):
            for c in ("texts", *_SUMS):
                out[c] += batch[c]
            for name, n in batch["detector_totals"].items():
                out["detector_totals"][name] = out["detector_totals"].get(name, 0) + n
        return out


def totals_frame(spark: SparkSession, totals: dict) -> DataFrame:
    """The totals as one row: ``texts``, the sums, and the map ``detector_totals``."""
    schema = "texts long, " + ", ".join(f"{c} long" for c in _SUMS) + ", detector_totals map<string,long>"
    return spark.createDataFrame([tuple(totals[c] for c in ("texts", *_SUMS, "detector_totals"))], schema)
