"""Session settings the plans of this package are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Key pads and stored keys are long hexadecimal literals; this hides them in plans and event logs.
_SECRET_LITERALS = r"(?i)(0x|X')?[0-9a-f]{64,}'?"

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.redaction.string.regex": _SECRET_LITERALS,
}


def build_session(app: str = "cloakframe", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def protect_plans(spark: SparkSession) -> None:
    """Hide key material in ``explain`` output and event logs of an existing session."""
    spark.conf.set("spark.sql.redaction.string.regex", _SECRET_LITERALS)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="cloakframe-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
