"""Chat formatting: a dialogue rendered once from the view of each of its participants.

In a view the participant's turns are the assistant's, all other speakers are users with their names,
and system turns stay. Turns become segments with their offsets in the whole rendering, so a rendering
of any length is a set of rows in order; the mask is the range of characters that the view is trained on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm.common import staged

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"


def perspectives(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    partitions: int | None = None,
) -> DataFrame:
    """``conv_id, perspective, position, turn, role, name, segment, start, end, mask_start, mask_end``.

    One row for each turn and each participant, that is each speaker but the system. The segments of a
    view, joined by ``position``, are its rendering; ``start`` and ``end`` are offsets in it. The mask covers
    the view's own text and end mark; it is null elsewhere. Turns are in order of number, speaker and text,
    nulls first; repeated rows are repeated turns. A null text is empty. A turn without speaker is a user
    without name and no view. A null conversation is a conversation; one without participants has no view.
    An empty table gives no rows; other columns are not looked at.

    Offsets are running sums in two steps, within ranges of turns and over the sums of the ranges, so a
    conversation that holds a third of all turns is still shared by many tasks.
    """
    spark = turns.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "turn", "who", "text", "row"]
    rows = turns.select(
        F.col(conversation).alias("conv"),
        F.col(turn).alias("turn"),
        F.col(speaker).alias("who"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    # From here on ``place`` is the order of turns, and texts stay behind until offsets are known.
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row")
    numbered = ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    numbered = staged(numbered, "turns")
    slim = numbered.select("conv", "who", "part", "place", F.length("text").cast("long").alias("length"))
    views = slim.where(F.col("who") != SYSTEM).select(F.col("conv").alias("of"), F.col("who").alias("perspective")).distinct()
    both = slim.join(views, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    own = F.coalesce(F.col("who") == F.col("perspective"), F.lit(False))
    system = F.coalesce(F.col("who") == SYSTEM, F.lit(False))
    name = F.when(~own & ~system, F.col("who"))
    role = F.when(own, "assistant").when(system, SYSTEM).otherwise("user")
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    both = both.select(
        "conv", "perspective", "part", "place", role.alias("role"), name.alias("name"), head.alias("head"),
        (F.length(head) + F.col("length") + len(END) + 1).alias("size"),
    )
    keys = ["conv", "perspective", "part"]
    earlier = Window.partitionBy("conv", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = both.groupBy(*keys).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    before = totals.select(
        F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("q"),
        _or_zero(F.sum("size").over(earlier)).alias("base"), _or_zero(F.sum("n").over(earlier)).alias("first"),
    )
    inside = Window.partitionBy(*keys).orderBy("place")
    so_far = _or_zero(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    placed = both.withColumn("so_far", so_far).withColumn("number", F.row_number().over(inside))
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("q"))
    start = F.col("base") + F.col("so_far")
    offsets = placed.join(before, same).drop("c", "p", "q", "part")
    mine = F.col("role") == "assistant"
    return offsets.join(numbered.select("place", "turn", "text"), "place").select(
        F.col("conv").alias("conv_id"),
        "perspective",
        (F.col("first") + F.col("number")).alias("position"),
        "turn",
        "role",
        "name",
        F.concat("head", "text", F.lit(END + "\n")).alias("segment"),
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        F.when(mine, start + F.length("head")).alias("mask_start"),
        F.when(mine, start + F.col("size") - 1).alias("mask_end"),
    )


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")
