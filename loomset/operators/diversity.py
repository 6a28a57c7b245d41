"""Diverse rows: spread over strata by exact quotas, or far apart as vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType

from loomset.operators.sampling import row_digest, seeded_sample
from loomset.operators.skew import join_hot
from loomset.session import materialise

# Vectors that are compared in one task. Rounds go on until one task holds what is left.
BLOCK = 8192

# Strata that may go to every task; more are joined by shuffles.
BROADCAST_STRATA = 100_000

# Rows of a stratum that are ranked in one task.
RANKED = 50_000

_DIGITS = 3  # hex digits of a digest a round, so 16**3 counts a stratum
_COPIES = 24

# Fields of a stratum's struct, so that missing values meet each other.
_OF = "_of"


def water_level(sizes: DataFrame, n: int, size: str = "size") -> tuple[int, int]:
    """How many rows every stratum may give so that at most ``n`` are taken, and what is left over,
    which is less than the number of strata that have more.

    Only the distinct sizes are put in order; there are far fewer of them than rows.
    """
    if n <= 0:
        return 0, 0
    by_size = sizes.groupBy(F.col(size).cast("decimal(38,0)").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    up_to = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    beyond = Window.orderBy("s").rowsBetween(1, Window.unboundedFollowing)
    filled = by_size.select(
        "s",
        F.sum(F.col("s") * F.col("c")).over(up_to).cast("decimal(38,0)").alias("below"),
        F.coalesce(F.sum("c").over(beyond), F.lit(0)).alias("above"),
    )
    fits = F.col("below") + F.col("s") * F.col("above") <= F.lit(n)
    row = (
        filled.filter(fits)
        .agg(F.max_by(F.struct("s", "below", "above"), "s").alias("at"))
        .select("at.*")
        .first()
    )
    if row.s is None:  # not even the smallest stratum can be given whole
        below, above = 0, sizes.count()
    else:
        below, above = int(row.below), row.above
    if not above:
        return int(row.s) if row.s is not None else 0, 0
    level = (n - below) // above
    return level, n - below - level * above


def quotas(rows: DataFrame, n: int, strata: list[str], seed: int) -> DataFrame:
    """``*strata, size, quota`` of every stratum: small ones give all they have, the others share
    what is left equally, and the rest goes, one each, to those first by a seeded digest.

    Quotas add up to ``n``, or to the number of rows where there are fewer.
    """
    sizes = materialise(rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("size")), "strata")
    level, rest = water_level(sizes, n)
    given = sizes.withColumn("quota", F.least("size", F.lit(level)))
    if not rest:
        return given
    larger = given.filter(F.col("size") > level)
    more = seeded_sample(larger, rest, seed, strata).withColumn("quota", F.col("quota") + 1)
    key = F.struct(*strata)
    chosen = more.select(key.alias("_key"))
    others = given.join(chosen, key.eqNullSafe(F.col("_key")), "left_anti")
    return others.unionByName(more)


def spread_over_strata(
    rows: DataFrame, n: int, strata: list[str], seed: int, key: str | list[str] | None = None
) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer), spread over the strata as evenly as their
    sizes allow; which rows of a stratum depends on the seed and ``key`` (without it, on the whole
    row).

    No stratum is sorted: the digest of its last row is found by counting rows per digits of
    the digest, for all strata at once, until few rows are left to rank. Copies that share the
    digest at the end of a stratum are ranked by their content, and are interchangeable beyond it.
    """
    of = F.struct(*strata)
    wanted = quotas(rows, n, strata, seed).select(of.alias(_OF), "size", "quota")
    wanted = materialise(wanted, "quotas")
    few = wanted.count() <= BROADCAST_STRATA

    def with_bounds(df: DataFrame, bounds: DataFrame) -> DataFrame:
        return df.join(F.broadcast(bounds), _OF) if few else join_hot(df, bounds, _OF)

    digest = row_digest(rows, seed, key)
    digests = rows.select(of.alias(_OF), digest.alias("_d"))
    bounds = wanted.filter((F.col("quota") > 0) & (F.col("quota") < F.col("size"))).select(
        _OF, F.lit("").alias("_prefix"), F.col("quota").alias("_left"), F.col("size").alias("_n")
    )
    settled = bounds.limit(0)
    while True:
        # Digests that agree so far are those of copies.
        done = (F.col("_n") <= RANKED) | (F.length("_prefix") >= _COPIES)
        settled = settled.unionByName(bounds.filter(done))
        bounds = bounds.filter(~done)
        if bounds.isEmpty():
            break
        inside = with_bounds(digests, bounds).filter(F.expr("startswith(_d, _prefix)"))
        counts = inside.groupBy(_OF, "_prefix", "_left", _next_digits().alias("_next")).agg(
            F.count(F.lit(1)).alias("_n")
        )
        before = Window.partitionBy(_OF).orderBy("_next").rowsBetween(Window.unboundedPreceding, -1)
        # The first digits with which the quota is reached.
        reached = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(
            (F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_n") >= F.col("_left"))
        )
        bounds = materialise(
            reached.select(
                _OF,
                F.concat("_prefix", "_next").alias("_prefix"),
                (F.col("_left") - F.col("_before")).alias("_left"),
                "_n",
            ),
            "bounds",
        )
    whole = wanted.filter(F.col("quota") == F.col("size")).select(
        _OF, F.lit("").alias("_prefix"), F.col("size").alias("_left"), F.lit(0).cast("long").alias("_n")
    )
    ends = materialise(settled.unionByName(whole), "bounds")
    placed = with_bounds(rows.withColumns({_OF: of, "_d": digest}), ends)
    start = F.expr("left(_d, length(_prefix))")
    sure = (F.col("_n") == 0) | (start < F.col("_prefix"))
    open_ = (F.col("_n") > 0) & (start == F.col("_prefix"))
    last = [F.col("_d"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))]
    rank = F.row_number().over(Window.partitionBy(_OF).orderBy(*last))
    ranked = placed.filter(open_).withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_left"))
    return placed.filter(sure).select(*rows.columns).unionByName(ranked.select(*rows.columns))


def _next_digits() -> Column:
    return F.expr(f"substring(_d, length(_prefix) + 1, {_DIGITS})")


def _usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, vector`` of rows whose vector has only finite components, at least one."""
    kind = rows.schema[vector].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, NumericType):
        raise ValueError(f"{vector} must be an array of numbers")
    numbers = F.col(vector).cast("array<double>")
    finite = F.forall(
        numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return rows.select(F.col(key).alias("key"), numbers.alias("vector")).filter(
        F.col("key").isNotNull() & finite & (F.size("vector") > 0)
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.unique(lists.value_lengths().to_numpy())
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} components")
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def greedy(vectors: np.ndarray, n: int) -> tuple[list[int], list[float]]:
    """Positions of ``n`` vectors, the first one and then always the one farthest from all before,
    and that distance; fewer, when all others are copies. Of equally far ones the first."""
    picked, far = [0], [np.inf]
    distance = np.full(len(vectors), np.inf)
    while len(picked) < min(n, len(vectors)):
        # Differences, not a product: copies must come out at exactly 0.
        np.minimum(distance, np.square(vectors - vectors[picked[-1]]).sum(axis=1), out=distance)
        at = int(distance.argmax())
        if distance[at] == 0:
            break
        picked.append(at)
        far.append(float(np.sqrt(distance[at])))
    return picked, far


def farthest_points(rows: DataFrame, n: int, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """``key, rank, distance``: ``n`` rows whose vectors cover all others, by farthest-point
    selection in rounds. ``distance`` is that to the nearest row of a smaller rank, NULL for the
    first.

    Rows are dealt into blocks by a hash of their content; each block gives its own ``n`` farthest points,
    and what the blocks give is dealt again, until one block holds it. The choice depends on the
    rows only. Selecting from all rows at once covers them within twice the least radius possible,
    each round adds that much again. No distance is kept beyond one per row of a block.

    Rows without key, or whose vector is NULL, empty or holds NULL, NaN or infinite components take
    no part; copies of a vector are chosen once.
    """
    if n <= 0:
        raise ValueError("at least one row is selected")
    block = max(block, 4 * n)
    kind = rows.schema[key].dataType.simpleString()

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        picked, far = greedy(_matrix(table.column("vector")), n)
        chosen = table.select(["key", "vector"]).take(picked)
        rank = pa.array(range(1, len(picked) + 1), pa.int32())
        distance = pa.array([None if x == np.inf else x for x in far], pa.float64())
        return chosen.append_column("rank", rank).append_column("distance", distance)

    points = _usable(rows, key, vector)
    count = points.count()
    while True:
        # Half a block each, so that an uneven deal stays below a block.
        groups = 1 if count <= block else -(-2 * count // block)
        dealt = points.withColumn("group", F.pmod(F.xxhash64("key", "vector"), F.lit(groups)))
        points = dealt.groupBy("group").applyInArrow(
            pick, f"key {kind}, vector array<double>, rank int, distance double"
        )
        if groups == 1:
            return points.select(F.col("key").alias(key), "rank", "distance")
        points = materialise(points, "farthest").select("key", "vector")
        count = points.count()


def covering_radius(rows: DataFrame, picked: DataFrame, key: str, vector: str) -> float:
    """The largest distance of any row's vector to the nearest of the ``picked`` ones, which are
    few enough for every task; NULL without rows."""
    chosen = rows.join(F.broadcast(picked.select(key)), key, "left_semi")
    centres = rows.sparkSession.sparkContext.broadcast(
        np.array([r.vector for r in _usable(chosen, key, vector).collect()])
    )

    def farthest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(pa.Table.from_batches([batch]).column("vector"))
            nearest = np.full(len(found), np.inf)
            for centre in centres.value:
                np.minimum(nearest, np.square(found - centre).sum(axis=1), out=nearest)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt(nearest.max()))])], ["far"])

    far = _usable(rows, key, vector).mapInArrow(farthest, "far double")
    return far.agg(F.max("far").alias("far")).first().far
