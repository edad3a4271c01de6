"""Long texts as blocks: one file is read by many tasks, and each block knows what stands around it.

Spark deals a text file to tasks by byte ranges. The records of a range (lines, or pieces between any other
separator) are put together to blocks of some length; a record that is longer is cut. Every block carries a
halo: the end of the text before it and the beginning of the text after it. Within a range the task has
these at hand; across ranges they are exchanged as one row per range, and the text itself does not move.

A span belongs to the block it starts in. The blocks on both sides of a border see the same neighbourhood
and so agree on the spans that cross it: the one masks such a span as a whole, the other goes on behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakframe.functions.binding import let
from cloakframe.functions.spans import collect_spans, count_by_detector, replace_spans, resolve_overlaps
from cloakframe.plans.policy import Policy
from cloakframe.sources.readers import _tree

BLOCK_CHARS = 1 << 20
HALO_CHARS = 4096

#: Characters of blocks that leave for the JVM together, and of records that are put together before they are cut.
BATCH_CHARS = 1 << 20

_SCHEMA = pa.schema(
    [
        ("source", pa.string()), ("split", pa.int64()), ("size", pa.int64()), ("seq", pa.int64()), ("last", pa.bool_()),
        ("before", pa.string()), ("text", pa.string()), ("after", pa.string()), ("alone", pa.bool_()), ("n_bytes", pa.int64()),
    ]
)
_ENDS = pa.schema([("source", pa.string()), ("split", pa.int64()), ("head", pa.string()), ("tail", pa.string()), ("n_bytes", pa.int64())])


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], separator: str, block: int, halo: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the records ``source, split, size, alone, value, n_bytes``, which come range by range in their order.

    ``n_bytes`` of a range's last block are those of the range. A block leaves once ``halo`` characters behind it
    are known, so a task holds two blocks and a batch of them, or one record.
    """
    where, pieces, length, n_bytes, seq, before = None, [], 0, 0, 0, ""
    enough, width = max(2 * block + halo, BATCH_CHARS), len(separator.encode())

    def row(text: str, after: str, last: bool) -> tuple:
        source, split, size, alone = where
        return source, split, size, seq, last, before, text, after, alone, n_bytes

    def ready() -> Iterator[tuple]:
        nonlocal pieces, length, seq, before
        whole, at = "".join(pieces), 0
        while len(whole) - at > block + halo:
            # Whole records where there are any, else a cut anywhere.
            found = whole.rfind(separator, at + block // 2, at + block)
            cut = found + len(separator) if found >= 0 else at + block
            yield row(whole[at:cut], whole[cut : cut + halo], False)
            before = whole[max(at, cut - halo) : cut]
            at, seq = cut, seq + 1
        pieces, length = [whole[at:]], len(whole) - at

    def finish() -> Iterator[tuple]:
        if where is not None:
            yield from ready()
            yield row(pieces[0], "", True)

    def cut() -> Iterator[tuple]:
        nonlocal where, pieces, length, n_bytes, seq, before
        for batch in batches:
            for *at, value, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != where:
                    yield from finish()
                    where, pieces, length, n_bytes, seq, before = at, [], 0, 0, 0, ""
                pieces.append(value + separator)
                length += len(value) + len(separator)
                n_bytes += size + width
                if length >= enough:
                    yield from ready()
        yield from finish()

    rows, chars = [], 0
    for made in cut():
        rows.append(made)
        chars += len(made[5]) + len(made[6]) + len(made[7])
        if chars >= BATCH_CHARS:
            yield _packed(rows, _SCHEMA)
            rows, chars = [], 0
    if rows:
        yield _packed(rows, _SCHEMA)


def _ends(batches: Iterator[pa.RecordBatch], separator: str, halo: int) -> Iterator[pa.RecordBatch]:
    """``source, split, head, tail, n_bytes`` of each range of the records ``source, split, first, final, n_bytes``.

    ``first`` and ``final`` are a record's own ends of up to ``halo`` characters; ``final`` is null where that is all of it.
    """
    where, head, tail, held, n_bytes, width = None, "", [], 0, 0, len(separator.encode())

    def ends() -> Iterator[pa.RecordBatch]:
        if where is not None:
            yield _packed([(*where, head[:halo], "".join(tail)[-halo:], n_bytes)], _ENDS)

    for batch in batches:
        for *at, first, final, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != where:
                yield from ends()
                where, head, tail, held, n_bytes = at, "", [], 0, 0
            if len(head) < halo:
                head += first + separator
            piece = (first if final is None else final) + separator
            if final is not None or held > 64 * halo:
                tail, held = ["".join(tail)[-halo:]] if final is None else [], 0
            tail.append(piece)
            held += len(piece)
            n_bytes += size + width
    yield from ends()


def read_text_blocks(
    spark: SparkSession,
    path: str,
    suffix: str = ".txt",
    block_chars: int = BLOCK_CHARS,
    halo_chars: int = HALO_CHARS,
    separator: str = "\n",
) -> DataFrame:
    """``source, place, before, text, after``: the blocks of UTF-8 files, in the order of ``place`` within a file.

    The texts of a file's blocks, one behind the other, are the file's text. ``before`` and ``after`` hold up to
    ``halo_chars`` characters around a block. Only a record between two separators has to fit into a task, so
    for files without line ends give a separator that they do have, such as a blank. Bytes that are no UTF-8
    become U+FFFD. A file without any record has no block.
    """
    if not separator or halo_chars < 1 or block_chars <= 2 * halo_chars:
        raise ValueError("blocks need a separator and have to be longer than two halos")
    at = F.col("_metadata.file_block_start")
    lines = _tree(spark, suffix).text(path, lineSep=separator).select(
        F.col("_metadata.file_path").alias("source"),
        at.alias("split"),
        F.col("_metadata.file_size").alias("size"),
        ((at == 0) & (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size"))).alias("alone"),
        F.make_valid_utf8("value").alias("value"),
        F.octet_length("value").cast("long").alias("n_bytes"),
    )
    read = lines.mapInArrow(
        lambda batches: _blocks(batches, separator, block_chars, halo_chars),
        "source string, split long, size long, seq long, last boolean, before string, text string, after string, alone boolean, n_bytes long",
    )
    first, final = F.left("value", F.lit(halo_chars)), F.when(F.length("value") > halo_chars, F.right("value", F.lit(halo_chars)))
    ranges = lines.where("NOT alone").select("source", "split", first.alias("first"), final.alias("final"), "n_bytes").mapInArrow(
        lambda batches: _ends(batches, separator, halo_chars), "source string, split long, head string, tail string, n_bytes long"
    )
    return _with_borders(read, ranges, separator)


def _with_borders(blocks: DataFrame, ranges: DataFrame, separator: str) -> DataFrame:
    """Blocks with what lies beyond their range, and without a last separator that the file does not have.

    One row per range of the files of several ranges goes through the window and to the blocks, which stay where they
    are: two halos for what Spark puts into a range, 128 MB by its settings. A file of one range needs none.
    """
    first, last = F.col("seq") == 0, F.col("last")
    by_place = Window.partitionBy("source").orderBy("split")
    beside = ranges.select(
        "source",
        "split",
        F.lag("tail").over(by_place).alias("behind"),
        F.lead("head").over(by_place).alias("ahead"),
        F.sum("n_bytes").over(Window.partitionBy("source")).alias("total"),
    )
    # The reader does not tell whether the last record has a separator behind it, and drops a byte-order mark of three.
    total = F.when(F.col("alone"), F.col("n_bytes")).otherwise(F.col("total"))
    extra, width = total - F.col("size"), len(separator.encode())
    added = last & F.col("ahead").isNull() & ((extra == width) | ((extra == width - 3) & F.lit(width != 3)))
    return blocks.join(F.broadcast(beside), ["source", "split"], "left").select(
        "source",
        F.struct(F.col("split").alias("block"), F.col("seq").alias("line")).alias("place"),
        F.when(first, F.coalesce("behind", F.lit(""))).otherwise(F.col("before")).alias("before"),
        F.when(added, F.left("text", F.length("text") - len(separator))).otherwise(F.col("text")).alias("text"),
        F.when(last, F.coalesce("ahead", F.lit(""))).otherwise(F.col("after")).alias("after"),
    )


def _shifted(spans: Column, by: Column) -> Column:
    return F.transform(
        spans, lambda s: s.withField("start", (s["start"] - by).cast("int")).withField("end", (s["end"] - by).cast("int"))
    )


def mask_text_blocks(blocks: DataFrame, policy: Policy) -> DataFrame:
    """Masked blocks with their statistics: ``source, place, text`` and the statistics columns.

    The texts in order are the masked text of the file, and the statistics add up to the file's, as long as no
    group of overlapping spans is longer than the halo. A span counts where it starts. Nothing is shuffled.
    """
    staged = (
        blocks.withColumn("_at", F.length("before"))
        .withColumn("_to", F.col("_at") + F.length("text"))
        .withColumn("_around", F.concat("before", "text", "after"))
        .withColumn("_all", collect_spans(F.col("_around"), policy.detectors()))
        .withColumn("_best", resolve_overlaps(F.col("_all")))
    )
    mine = lambda spans: F.filter(spans, lambda s: (s["start"] >= F.col("_at")) & (s["start"] < F.col("_to")))
    crossing = F.filter("_best", lambda s: (s["start"] < F.col("_at")) & (s["end"] > F.col("_at")))
    staged = (
        staged.withColumn("_found", mine(F.col("_all")))
        .withColumn("_kept", mine(F.col("_best")))
        # A span of the block before may reach into this one, or beyond it.
        .withColumn("_from", F.coalesce(F.array_max(F.transform(crossing, lambda s: s["end"])), F.col("_at")))
        .withColumn("_until", F.greatest(F.coalesce(F.array_max(F.transform("_kept", lambda s: s["end"])), F.col("_to")), F.col("_to")))
    )
    length = F.greatest(F.col("_until") - F.col("_from"), F.lit(0))
    body = F.substring(F.col("_around"), F.col("_from") + 1, length)
    masked = let(
        F.struct(body.alias("body"), _shifted(F.col("_kept"), F.col("_from")).alias("spans")),
        lambda x: replace_spans(x["body"], x["spans"], policy.replacement),
    )
    found, kept = F.size("_found").cast("bigint"), F.size("_kept").cast("bigint")
    return staged.select(
        "source",
        "place",
        masked.alias("text"),
        found.alias("matches_found"),
        kept.alias("matches_applied"),
        (found - kept).alias("matches_skipped"),
        count_by_detector(F.col("_kept")).alias("detector_counts"),
    )
