"""A Merkle manifest of a dataset: a content-addressed store of digests, and proofs by descent.

Rows are leaves, ordered by key within their tree. Every ``arity`` consecutive nodes become the digest of
their digests until one remains; the roots of the trees are folded alike into one root. The store keeps a
record ``digest -> children`` of every node, a table per height. A proof descends from the root: at each
record the digit of the leaf's rank selects the child to follow, and the children not selected are
collected. Requests that share a way descend it together, so a height costs as many rows as it has nodes.
Segments are collected from the root down and reversed for folding.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import staged

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Manifest:
    """What ``build`` makes.

    ``requests``: ``tree, rank, leaf`` and the other columns of the leaves, one row per leaf.
    ``trees``: ``tree, name, size, height, subroot``, one row per tree, numbered in the order of their names.
    ``records``: for each height from 1 on, the store of the trees' nodes, ``digest, children``.
    ``top``: the same for the nodes above the trees' roots. ``root``: one row ``digest``, none for no leaves.
    """

    requests: DataFrame
    trees: DataFrame
    records: list[DataFrame]
    top: list[DataFrame]
    root: DataFrame


def digest_of(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if null and else its length in bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def ranked(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """The rows, written to the shared folder, with their place in the order as ``place``, from 0.

    Rows are dealt by range and numbered within their partition; only a count per partition is summed up.
    Equal rows are next to each other, in any order.
    """
    place = F.monotonically_increasing_id().alias("place")
    rows = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", place), label)
    part = F.shiftright("place", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = counts.select("part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    out = rows.withColumn("part", part).join(shift, "part")
    return out.withColumn("place", F.col("place") + F.col("shift")).drop("part", "shift")


def _folded(nodes: DataFrame, most: int, arity: int, label: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """For each height the nodes ``tree, rank, digest, size`` above ``nodes``, and their records.

    ``size`` counts the nodes of the tree at this height; trees of one node go no higher.
    """
    while most > 1:
        up = F.floor(F.col("rank") / arity).alias("rank")
        runs = nodes.where("size > 1").groupBy("tree", "size", up).agg(F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("run"))
        size = F.floor((F.col("size") + (arity - 1)) / arity).alias("size")
        made = runs.select("tree", "rank", size, F.col("run.digest").alias("children"))
        made = staged(made.withColumn("digest", F.sha2(F.concat_ws("", "children"), 256)), label)
        nodes = made.drop("children")
        yield nodes, made.select("digest", "children")
        most = -(-most // arity)


def build(leaves: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of the leaves ``name, key, leaf``: a tree for each ``name``, leaves in the order of ``key``, then ``leaf``.

    A null name is a tree of its own and comes first, as does a null key. Other columns stay with their request
    (``tree``, ``rank``, ``size`` and ``place`` must not be among them). The table is read twice.
    """
    placed = ranked(leaves, ["name", "key", "leaf"], "leaves")
    found = placed.groupBy("name").agg(F.min("place").alias("start"), F.count("*").alias("size"))
    numbered = ranked(found, ["name"], "trees").withColumnRenamed("place", "tree")
    height = sum((F.col("size") > arity**k).cast("int") for k in range(64) if arity**k < 1 << 63)
    trees = staged(numbered.withColumn("height", height), "heights")
    known = trees.select(F.col("name").alias("known"), "tree", "start", "size")
    requests = (
        placed.join(known, F.col("name").eqNullSafe(F.col("known")))
        .withColumn("rank", F.col("place") - F.col("start"))
        .drop("known", "start", "place")
    )
    requests = staged(requests, "requests")

    count, most = trees.agg(F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    nodes = requests.select("tree", "rank", F.col("leaf").alias("digest"), "size")
    roots = nodes.where("size = 1")
    records, top = [], []
    for above, record in _folded(nodes, most, arity, "records"):
        roots = roots.unionByName(above.where("size = 1"))
        records.append(record)
    subroots = staged(roots.select(F.lit(0).cast("long").alias("nothing"), F.col("tree").alias("rank"), "digest"), "roots")
    named = trees.drop("start").join(subroots.select(F.col("rank").alias("tree"), F.col("digest").alias("subroot")), "tree")
    root = subroots.withColumnRenamed("nothing", "tree").withColumn("size", F.lit(count).cast("long"))
    for above, record in _folded(root, count, arity, "top"):
        root = above
        top.append(record)
    return Manifest(requests.drop("size"), staged(named, "named"), records, top, root.select("digest"))


def _segment(children: Column, digit: Column) -> Column:
    """The children beside the selected one, as hex texts."""
    return F.struct(
        F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
        F.array_join(F.slice(children, digit + 2, F.size(children)), "").alias("right"),
    )


_PATH = "array<struct<left: string, right: string>>"


def _down(front: DataFrame, records: DataFrame, arity: int) -> DataFrame:
    """The frontier ``rank, digest, path`` one height lower. The store answers by digest alone."""
    store = records.dropDuplicates(["digest"])
    at = front.join(store, "digest").drop("digest").select("*", F.posexplode("children").alias("digit", "digest"))
    return at.select(
        *[c for c in front.columns if c not in ("rank", "digest", "path")],
        (F.col("rank") * arity + F.col("digit")).alias("rank"),
        "digest",
        F.concat("path", F.array(_segment(F.col("children"), F.col("digit")))).alias("path"),
    )


def prove(manifest: Manifest, arity: int = ARITY) -> DataFrame:
    """The requests with ``subroot``, ``root`` and ``path``: siblings ``left, right`` of each height from the leaf up to the root.

    The last step is not spread out: requests join the record above them by tree and rank, so the long
    paths are shuffled once per ``arity`` leaves.
    """
    front = manifest.root.select(
        F.lit(0).cast("long").alias("rank"), "digest", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path")
    )
    for records in reversed(manifest.top):
        front = _down(front, records, arity)
    at = manifest.trees.select(F.col("tree").alias("rank"), "height")
    entered = front.join(at, "rank").select(
        F.col("rank").alias("tree"), "root", F.col("digest").alias("subroot"), "height", F.lit(0).cast("long").alias("rank"), "digest", "path"
    )
    entered = staged(entered, "entered")
    front = None
    for height in range(len(manifest.records), 1, -1):
        new = entered.where(F.col("height") == height).drop("height")
        front = _down(front.unionByName(new) if front else new, manifest.records[height - 1], arity)
    lone = entered.where("height = 0").drop("height", "digest").withColumn("children", F.lit(None).cast("array<string>"))
    if manifest.records:
        new = entered.where("height = 1").drop("height")
        front = front.unionByName(new) if front else new
        last = front.join(manifest.records[0].dropDuplicates(["digest"]), "digest").drop("digest").unionByName(lone)
    else:
        last = lone
    asked = manifest.requests.withColumn("above", F.floor(F.col("rank") / arity))
    digit = (F.col("rank") % arity).cast("int")
    own = F.when(F.col("children").isNull(), F.array().cast(_PATH)).otherwise(F.array(_segment(F.col("children"), digit)))
    return (
        asked.join(last.withColumnRenamed("rank", "above"), ["tree", "above"])
        .withColumn("path", F.reverse(F.concat("path", own)))
        .drop("above", "children")
    )


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf digest and its siblings make."""
    return F.aggregate(path, start, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def audited(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    tree: str = "lang",
    key: str = "doc_id",
    text: str = "text",
    every: int = 3,
    arity: int = ARITY,
) -> DataFrame:
    """One row per document: ``key, leaf, subroot, root, proof_sha256, folded_root, verified``.

    The manifest holds the documents as they are. Where ``every`` divides the CRC-32 of the key, the proof is
    folded from a tampered leaf, whose text has A-Z in lower case; a text without A-Z is thereby not changed,
    and still verified. A null key is not tampered with and comes first in its tree, a null ``tree`` makes the
    first tree, other nulls are ``-`` in the leaf. Repeated rows are leaves of their own with equal digests,
    next to each other. A tree of one leaf has that leaf as its root, and an empty table gives no rows. Texts
    of any length are hashed whole; columns not among ``fields`` are not looked at, whatever their names.
    """
    columns = {f: F.col(f"`{f}`") for f in fields}
    changed = columns | {text: F.translate(columns[text], UPPER, LOWER)}
    tampered = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % every == 0
    leaves = docs.select(
        F.col(f"`{tree}`").alias("name"),
        F.col(f"`{key}`").alias("key"),
        digest_of(list(columns.values())).alias("leaf"),
        F.when(tampered, digest_of(list(changed.values()))).alias("altered"),
    )
    proofs = prove(build(staged(leaves, "digests"), arity), arity)
    folded = fold(F.coalesce("altered", "leaf"), F.col("path"))
    out = proofs.select(
        F.col("key").alias(key), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
