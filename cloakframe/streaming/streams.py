"""Masking of streams. Masking is stateless, so a stream gets the batch projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cloakframe.operators.mapping import build_mapping, cache_entries, keyed_spans, save_mapping, save_token_cache
from cloakframe.plans.masking import mask_with_stats
from cloakframe.plans.policy import Policy


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "parquet", **options: str
) -> DataFrame:
    """A stream of the files at ``path``, which is a folder of part files or a single file.

    Without a schema that of the files now there is taken, so there has to be one. A path ending in a glob
    names folders and files alike, which a plain path does not: the last character becomes a class of itself.
    """
    if schema is None:
        schema = spark.read.format(fmt).options(**options).load(path).schema
    head, last = path.rstrip("/")[:-1], path.rstrip("/")[-1]
    if last.isalnum() and not set(path) & set("*?[]{}"):
        path = f"{head}[{last}]"
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def mask_stream(stream: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """Masked stream with statistics columns; no state, any sink in append mode."""
    return mask_with_stats(stream, policy, text)


def write_stream(
    masked: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = True
) -> StreamingQuery:
    """Start writing a masked stream to files."""
    writer = masked.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def _per_batch(stream: DataFrame, checkpoint: str, available_now: bool, save: Callable) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def _query_of(batch: DataFrame) -> str:
    """Identity of the running query, the same after each restart from its checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"


def mapping_stream(
    stream: DataFrame,
    policy: Policy,
    path: str,
    passphrase: str,
    checkpoint: str,
    text: str = "text",
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the encrypted mapping of a stream: every micro-batch is one generation of the store.

    A batch that is run again finds its generation in the store and changes nothing. The run is named after
    the query that the checkpoint belongs to, so what others have stored is never rewritten.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        save_mapping(build_mapping(batch, policy, text), path, passphrase, batch_id, _query_of(batch), replace=False)

    return _per_batch(stream, checkpoint, available_now, save)


def token_cache_stream(
    stream: DataFrame,
    policy: Policy,
    path: str,
    key: str,
    checkpoint: str,
    text: str = "text",
    available_now: bool = True,
) -> StreamingQuery:
    """Keep the token cache ``(digest, token)`` of a stream, one generation per micro-batch.

    The generation saved first wins on reading: a value keeps the token it was first given.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        entries = cache_entries(keyed_spans(batch, policy, text, keys=[key]), [key])
        save_token_cache(entries, path, batch_id, _query_of(batch), replace=False)

    return _per_batch(stream, checkpoint, available_now, save)
