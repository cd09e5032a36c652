"""Snapshot anchors: blocks at a coarse step, and at a fine one where a stress window is near."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremor.operators.intervals import merge_intervals


def snapshot_anchors(stress: DataFrame, start: int, end: int, normal: int = 25, fine: int = 5) -> DataFrame:
    """(block) of a walk over [start, end): a step is `fine` where [block, block + normal) meets a stress window
    [start_block, end_block), else `normal`.

    A window makes a zone of blocks with fine steps, from normal - 1 blocks before it. `normal` must be a multiple of `fine`, so
    all anchors are congruent modulo `fine`, and a zone is left at its first such block past the end, however it was
    entered. Each zone's anchors thus follow from its own bounds and the one before, without a walk. Only the
    merged zones, one row a stress window at most, are ordered in one task.
    """
    if fine <= 0 or normal <= 0 or normal % fine:
        raise ValueError("the coarse step must be a positive multiple of the fine one")
    if end <= start:
        raise ValueError("end must be after start")
    up = lambda x, step: (F.ceil(x / step) * step).cast("long")
    zones = stress.select((F.col("start_block") - (normal - 1)).alias("start_block"), "end_block").where((F.col("end_block") > start) & (F.col("start_block") < end))
    zones = merge_intervals(zones, []).withColumn("leave", F.lit(start) + up(F.col("end_block") - start, fine))
    zones = zones.withColumn("since", F.lag("leave", 1, start).over(W.orderBy("start_block")))
    zones = zones.withColumn("enter", F.col("since") + up(F.greatest(F.col("start_block") - F.col("since"), F.lit(0)), normal))
    rest = zones.agg(F.coalesce(F.max("leave"), F.lit(start)).cast("long").alias("since")).select("since", F.lit(end).cast("long").alias("enter"))
    walk = lambda a, b, step: F.when(F.col(b) > F.col(a), F.sequence(F.col(a).cast("long"), (F.col(b) - 1).cast("long"), F.lit(step).cast("long")))
    quiet = zones.select("since", "enter").unionByName(rest).select(F.explode(walk("since", "enter", normal)).alias("block"))
    dense = zones.select(F.explode(walk("enter", "leave", fine)).alias("block"))
    return quiet.unionByName(dense).where(F.col("block") < end)
