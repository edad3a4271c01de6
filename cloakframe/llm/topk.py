"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in vertical layout, one row per dimension. A query adds up its scores block by block
of dimensions; after each block the norms of what remains bound every final score from both sides,
and the candidates that cannot reach the k-th best lower bound are compacted away.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import staged

SCALE = 64
K = 20
EVERY = 20
DIMENSIONS = 16
CANDIDATES = 16384
QUERIES = 2048
# Sums of products below this are exact in double precision.
_EXACT = 2.0**53


def quantised(vector: F.Column, scale: int = SCALE) -> F.Column:
    """floor(scale * x) of each component, or null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of the list column, shorter ones filled up with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy()
    if sizes.size and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((sizes.size, width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def best(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, step: int = DIMENSIONS
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its place, and the ids and scores of the ``k`` best vectors that have another id."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    width = vectors.shape[1]
    size = np.sqrt((vectors.astype(float) ** 2).sum(axis=1)) if len(ids) else np.zeros(0)
    lengths = np.sqrt((queries.astype(float) ** 2).sum(axis=1)) if len(queries) else np.zeros(0)
    most = size.max(initial=0) * lengths.max(initial=0)
    kind = np.float64 if most * width < _EXACT else np.int64
    columns = np.ascontiguousarray(vectors.T.astype(kind))
    rows = queries.astype(kind)
    cuts = [*range(0, width, step), width] if width else [0, 0]

    def remaining(values: np.ndarray) -> np.ndarray:
        squares = values.astype(float) ** 2
        return np.sqrt(np.stack([squares[c:].sum(axis=0) for c in cuts[1:]]))

    mass, query_mass = remaining(columns), remaining(rows.T)
    # Rounding of the bounds: half a point, scores being whole, and the last bits of large norms.
    slack = 0.5 + 1e-9 * most
    for at, query in enumerate(rows):
        own = slice(np.searchsorted(ids, query_ids[at], "left"), np.searchsorted(ids, query_ids[at], "right"))
        alive = np.delete(np.arange(len(ids)), own)
        whole = own.start == own.stop
        score = np.zeros(len(alive), kind)
        for part, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            block = columns[low:high] if whole else columns[low:high, alive]
            score = score + query[low:high] @ block
            if len(alive) <= k:
                continue
            rest = query_mass[part, at] * (mass[part] if whole else mass[part, alive])
            floor = np.partition(score - rest, len(alive) - k)[len(alive) - k]
            keep = score + rest >= floor - slack
            if not keep.all():
                alive, score, whole = alive[keep], score[keep], False
        top = np.lexsort((ids[alive], -score))[:k]
        yield at, ids[alive[top]], score[top].astype(np.int64)


def top_k(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    every: int = EVERY,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for each row whose key is divisible by ``every``.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without key.
    A repeated row counts each time, as query too; every row with the query's key is the query's own.
    Ties go to the smaller key. Shorter vectors count as filled up with zeros, empty ones score 0. Products
    beyond 64 bits are not meant. An empty table gives no rows; other columns are not looked at.

    Rows are dealt by hash into blocks of about ``candidates``, queries into blocks of ``queries``; a task
    sees one block of each, and only ``k`` rows of every query and block are sorted at the end.
    """
    rows = vectors.select(F.col(key).alias("id"), quantised(F.col(vector)).alias("v")).where("id is not null and v is not null")
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(F.col("id") % every == 0)
    n, n_asked, width = rows.agg(
        F.count("*"), F.count_if(F.col("id") % every == 0), F.coalesce(F.max(F.size("v")), F.lit(0))
    ).first()
    groups, blocks = max(1, math.ceil(n / candidates)), max(1, math.ceil(n_asked / queries))

    def search(key_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ask, have = matrix(left["v"], width), matrix(right["v"], width)
        ids, row_ids = left["id"].to_numpy(), left["row"].to_numpy()
        out = [([row_ids[at]] * len(near), [ids[at]] * len(near), near, score)
               for at, near, score in best(ask, ids, have, right["id"].to_numpy(), k)]
        columns = [np.concatenate(c) if out else np.empty(0) for c in (zip(*out, strict=True) if out else [()] * 4)]
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("row", "query_id", "vec_id", "score"), columns, strict=True)})

    hashed = F.xxhash64("row")
    left = asked.withColumn("block", F.pmod(hashed, F.lit(blocks))).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    right = rows.withColumn("part", F.pmod(hashed, F.lit(groups)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    found = (
        left.groupBy("block", "part")
        .cogroup(right.groupBy("block", "part"))
        .applyInArrow(search, "row long, query_id long, vec_id long, score long")
    )
    place = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
