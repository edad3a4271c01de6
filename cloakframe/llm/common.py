"""What the operators of this subpackage share: staging, Arrow mapping, word hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cloakframe.session import shared_folder

#: Bytes of an Arrow batch on its way to Python, and characters of the results that leave together.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared folder and read back: computed once, whoever is lost later."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end at ``BATCH_BYTES`` for the rest of the session, if it does not say itself where.

    Else one holds 10,000 rows, however long their texts: a task has it in the JVM, as vectors and as bytes to be sent, and in Python.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def map_rows(df: DataFrame, rows: Callable[..., Iterable[tuple]], schema: str, batch: int = 512) -> DataFrame:
    """``rows(iterator of row tuples)`` run over each partition, Arrow on both sides.

    Rows are read from Arrow one at a time and results leave in small batches, so a task holds one
    incoming batch and ``batch`` results, or those of ``BATCH_BYTES`` characters, however long the partition is.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch], fields=tuple(_arrow_fields(schema, df))) -> Iterator[pa.RecordBatch]:
        target = pa.schema([pa.field(name, kind) for name, kind in fields])
        long = [i for i, (_, kind) in enumerate(fields) if pa.types.is_string(kind) or pa.types.is_binary(kind)]
        pending: list[tuple] = []
        size = 0
        for row in rows(r for b in batches for r in _tuples(b)):
            pending.append(row)
            for i in long:
                if row[i] is not None:
                    size += len(row[i])
            if len(pending) >= batch or size >= BATCH_BYTES:
                yield _packed(pending, target)
                pending, size = [], 0
        if pending:
            yield _packed(pending, target)

    return df.mapInArrow(run, schema)


def _arrow_fields(schema: str, df: DataFrame) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return [(f.name, f.type) for f in arrow]


def _tuples(batch: pa.RecordBatch, step: int = 256) -> Iterator[tuple]:
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _packed(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def carried(df: DataFrame, keep: Iterable[str]) -> tuple[list, str, Callable[[DataFrame], DataFrame]]:
    """Columns that a row function passes on behind its own: what to select, their types, and their names again."""
    keep = list(keep)
    columns = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(keep)]
    types = "".join(f", kept_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return columns, types, lambda out: out.select([F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)])


def kept_beside(keep: Iterable[str], held: Sequence[str]) -> tuple[list[str], list[int]]:
    """The columns to ``keep`` that a row function is not given anyhow, and the place of each kept one in the ``held`` and these.

    So a text that is both looked at and passed on crosses to Python once.
    """
    keep = list(keep)
    others = [c for c in keep if c not in held]
    every = [*held, *others]
    return others, [every.index(c) for c in keep]


def gram_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``k`` words joined by blanks; one for all words if they are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-k].tolist()]
    stops = (ends[k - 1 :] - 1).tolist()
    return np.fromiter(
        (xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(starts)
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links ``u, v``: one row ``node, root`` for each node that has a link.

    ``root`` is the smallest node of the component. Alternating large-star and small-star steps: a
    minimum per node by partial aggregation, then an equality join that AQE may split. Each round is
    written to the shared folder, and the rounds end when all links are stars, which one more would not change.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = staged(links, "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = staged(small, "links")
        if _starred(links):
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _starred(links: DataFrame) -> bool:
    """Whether each ``u`` of distinct links to smaller nodes has one link and is no ``v``: then a round changes nothing."""
    ends = [F.struct(F.col(c).alias("node"), F.lit(up).alias("up")) for c, up in (("u", 1), ("v", 0))]
    nodes = links.select(F.inline(F.array(*ends))).groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.where("ups > least").isEmpty()
