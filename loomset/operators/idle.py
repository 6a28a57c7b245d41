"""Idle streaks in utilisation samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.operators.skew import (
    BLOCK_ROWS,
    HOT_ROWS,
    check_block_order,
    hot_blocks,
    hot_hashes,
    key_hash,
)

# Fixed value: consecutive idle samples after which a device counts as idle.
IDLE_LIMIT = 30


def total_utilisation(samples: DataFrame, *by: str, util: str = "util") -> DataFrame:
    """Utilisation summed over the devices sampled together."""
    return samples.groupBy(*by).agg(F.sum(util).alias(util))


def idle_streaks(
    samples: DataFrame,
    device: str = "device",
    ts: str = "ts",
    util: str = "util",
    tie: tuple[str, ...] = (),
    limit: int = IDLE_LIMIT,
    initial: str | None = None,
    hot_rows: int = HOT_ROWS,
    hot: list[int] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``streak``, the number of idle samples in a row up to this one, and ``alert``, true
    where the streak rises to ``limit``. A device that enters with more has no such sample; there
    ``streak >= limit`` tells.

    A sample is idle when its utilisation is 0; a missing reading counts as active. ``initial``
    names a column with the streak a device enters with. ``ts`` is a number, date or time.

    A device is counted in one task, except hot ones: those are cut into blocks of about
    ``block_rows`` samples that follow each other, counted block by block and completed by what
    the blocks before carry over, one small row each. Samples of one time share a block. ``hot``
    is the result of ``hot_hashes`` where it is known already.
    """
    check_block_order(samples.schema[ts].dataType)
    idle = F.coalesce(F.col(util) == 0, F.lit(False))
    entered = F.lit(0) if initial is None else F.coalesce(F.col(initial), F.lit(0))
    kept = [name for name in samples.columns if name != initial]

    def count_inside(df: DataFrame, part: str) -> DataFrame:
        inside = Window.partitionBy(part).orderBy(ts, *tie)
        so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("_pos", F.row_number().over(inside)).withColumn(
            "_active", F.max(F.when(~idle, F.col("_pos"))).over(so_far)
        )

    def finish(counted: DataFrame, streak: Column) -> DataFrame:
        own = F.col("_pos") - F.col("_active")
        return counted.select(
            *kept, F.coalesce(own, streak).cast("long").alias("streak")
        ).withColumn("alert", F.col("streak") == limit)

    def count_whole(df: DataFrame) -> DataFrame:
        return finish(count_inside(df, device), F.col("_pos") + entered)

    if hot is None:
        hot = hot_hashes(samples, [device], hot_rows)
    if not hot:
        return count_whole(samples)

    is_hot = key_hash([device]).isin(hot)
    counted = count_inside(hot_blocks(samples.filter(is_hot), hot, device, ts, block_rows), "_block")
    earlier = (
        Window.partitionBy("_block.of").orderBy("_block.at").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        counted.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("n"), F.max("_active").alias("last"))
        .withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("_reached", F.max(F.col("_before") + F.col("last")).over(earlier))
        .select("_block", "_before", "_reached")
    )
    place = F.col("_before") + F.col("_pos")
    completed = finish(
        counted.join(carried, "_block"),
        F.coalesce(place - F.col("_reached"), place + entered),
    )
    return count_whole(samples.filter(~is_hot)).unionByName(completed)

