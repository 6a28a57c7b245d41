"""Finding hot keys and spreading their rows over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

from loomset.session import materialise

# A key is hot when it holds more than this share of the rows, which at most 1 / HOT_SHARE keys
# can, and at least HOT_ROWS rows. In a large table that share is more than a task should hold, so
# a key of TASK_ROWS rows is hot whatever its share. Any other key is light work for one task.
HOT_SHARE = 0.0001
HOT_ROWS = 100_000
TASK_ROWS = 10_000_000

# Rows of a hot group that go to one task, and the most blocks a group is cut into.
BLOCK_ROWS = 65_536
BLOCKS = 1_024

# So many bounds of blocks are small enough to broadcast.
_BROADCAST_BOUNDS = 1_000_000

_BUCKETS = 65_536


def hot_hashes(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> list[int]:
    """``key_hash`` of every hot key.

    One pass counts rows per hash bucket, a fixed number of counts whatever the table holds.
    Only if a bucket is heavy are the keys inside it counted one by one.
    """
    hashed = df.select(key_hash(keys).alias("h"))
    bucket = F.pmod("h", F.lit(_BUCKETS))
    sizes = (
        hashed.groupBy(bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("total"),
            F.collect_list(F.when(F.col("n") >= hot_rows, F.struct("bucket", "n"))).alias("heavy"),
        )
        .first()
    )
    least = max(hot_rows, min(TASK_ROWS, HOT_SHARE * (sizes.total or 0)))
    heavy = [b.bucket for b in sizes.heavy if b.n >= least]
    if not heavy:
        return []
    hot = hashed.filter(bucket.isin(heavy)).groupBy("h").count().filter(F.col("count") >= least)
    return [row.h for row in hot.collect()]


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*keys)


def check_block_order(kind: DataType) -> None:
    """Groups of any size are ordered by a type that hot groups can be cut by."""
    if not isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        raise ValueError(f"groups are ordered by numbers, dates or times, not {kind.simpleString()}")


def hot_blocks(
    rows: DataFrame, hot: list[int], group: str, order_by: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``_block``, the group (``of``) and the place of the block in it (``at``), to rows of hot
    groups.

    A group is cut at percentiles of ``order_by`` into blocks of about ``block_rows`` rows, and
    into ``BLOCKS`` of them at most, however its values are spread. Rows that are equal in
    ``order_by`` share a block, missing values are in the first one. The bounds are written, so
    that every later step cuts at the same places.
    """
    check_block_order(rows.schema[order_by].dataType)
    # Structs compare equal on NULL fields, so rows without a group stay in.
    named = rows.withColumn("_of", F.struct(group))
    found = named.groupBy("_of").agg(
        F.least(F.ceil(F.count(F.lit(1)) / block_rows), F.lit(BLOCKS)).cast("int").alias("_blocks"),
        F.percentile_approx(order_by, [i / BLOCKS for i in range(1, BLOCKS)]).alias("_at"),
    )
    ends = F.transform(
        F.sequence(F.lit(1), F.col("_blocks") - 1),
        lambda i: F.get("_at", F.floor(i * BLOCKS / F.col("_blocks")).cast("int") - 1),
    )
    ends = F.when(F.col("_blocks") > 1, F.array_sort(F.array_distinct(ends)))
    bounds = materialise(found.select("_of", ends.alias("_ends")), "bounds")
    held = bounds.agg(F.sum(F.size("_ends") + 1).alias("n")).first().n or 0
    if held <= _BROADCAST_BOUNDS:
        placed = named.join(F.broadcast(bounds), "_of")
    else:
        placed = join_hot(named, bounds, "_of", hot=hot)
    # How many bounds are below the row's value, by bisection: ten plain steps that Spark compiles
    # with the join. Past the last bound, or where anything is missing, nothing is below.
    placed, step = placed.withColumn("_block", F.lit(0)), BLOCKS // 2
    while step:
        further = F.col("_block") + step
        below = F.get("_ends", further - 1) < F.col(order_by)
        placed = placed.withColumn("_block", F.when(below, further).otherwise(F.col("_block")))
        step //= 2
    block = F.struct(F.col(group).alias("of"), F.col("_block").alias("at"))
    return placed.withColumn("_block", block).drop("_of", "_ends")


def join_hot(
    many: DataFrame,
    one: DataFrame,
    on: str | list[str],
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    hot: list[int] | None = None,
) -> DataFrame:
    """Join ``many`` to ``one``, which has one row per key, with hot keys spread over tasks.

    Rows of ``many`` with a hot key go to the task chosen by the partition they come from, and
    the matching row of ``one`` is repeated for each of those tasks. All other keys are joined
    as usual. The salt depends on the partition, not on chance, row order or content, so a task
    that is run again sends every row to the same place.

    It is always a sort-merge join: both sides may be large, a sort can spill, and Spark would
    decide on a broadcast by the compressed size of files. ``hot`` is the result of
    ``hot_hashes`` where it is known already.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep the right side whole when salted")
    keys = [on] if isinstance(on, str) else list(on)
    for key in keys:
        if many.schema[key].dataType.simpleString() != one.schema[key].dataType.simpleString():
            raise ValueError(f"{key} must have the same type on both sides")
    if hot is None:
        hot = hot_hashes(many, keys, hot_rows)
    if not hot:
        return many.join(one.hint("merge"), keys, how)
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = key_hash(keys).isin(hot)
    salted = many.withColumn(
        "_salt", F.when(is_hot, F.spark_partition_id() % F.lit(tasks)).otherwise(F.lit(0))
    )
    repeated = one.withColumn(
        "_salt",
        F.explode(
            F.when(is_hot, F.sequence(F.lit(0), F.lit(tasks - 1))).otherwise(F.array(F.lit(0)))
        ),
    )
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")
