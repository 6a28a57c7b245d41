"""Nearest neighbours by inner product along shifted space-filling curves.

Vectors are projected to a few dimensions, shifted by a random offset per curve, and numbered
along a Hilbert curve; several projections and offsets give several orderings. Each ordering is
range-partitioned in Spark into stretches. Near copies share a number and so a stretch, however
many they are; such a stretch is cut into blocks of about equal size by the hash of its vectors,
and every query of the stretch meets all of them. A query looks into the stretch it
would lie in and the ones beside it on every curve; these windows are merged and reranked by the
exact measure. What the best found so far are then tells how far to open the window on the first
curve: a stretch is read as well if a vector in it may be as near, by its centre and radius.

So results are exact. Where vectors form clusters, few stretches are opened. Where they are noise
without neighbours to speak of, most are, and the work is that of the query set against all rows,
in blocks.

Equal vectors are one class: only their smallest ids can be among the nearest, so a vector that
fills a third of the table is one point on the curves. Vectors that are null, of length zero, or
hold a null or a value that is not finite, take no part, and neither do rows without id or of
another dimension than the most common one. Rows that repeat an id and its vector count once; the
same id with another vector is another row. A table without vectors gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.session import materialise

CURVES = 3
DIMENSIONS = 6
BITS = 8
# Classes in a stretch of a curve, and queries that one task holds against a stretch.
STRETCH = 4096
QUERIES = 4096
# Vectors that are multiplied with a block of queries at a time.
VECTORS = 4096
# Rows of the sample that gives the scale of the projections and the ends of the stretches.
SAMPLE = 20_000
# Difference of inner products that rounding may make.
_SLACK = 1e-9


# --- curves ---------------------------------------------------------------------------------------


def hilbert_numbers(cells: np.ndarray, bits: int) -> np.ndarray:
    """The position of each row of ``cells`` (unsigned integers below 2^bits, one column for each
    dimension) on the Hilbert curve through all of them."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    mask = 1 << (bits - 1)
    # From cells to the transposed index: undo rotations and reflections, from the top bit down.
    q = mask
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = mask
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    number = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            number = number << 1 | (x[i] >> bit) & 1
    return number


class Curves:
    """Projections, offsets and scale of all curves: fixed by a seed and a bounded sample."""

    def __init__(self, dimension: int, sample: np.ndarray, curves: int = CURVES, seed: int = 7):
        random = np.random.default_rng(seed)
        self.dimensions = min(DIMENSIONS, dimension)
        self.projections = [
            np.linalg.qr(random.normal(size=(dimension, self.dimensions)))[0] for _ in range(curves)
        ]
        self.scales = []
        for projection in self.projections:
            low, high = np.quantile(sample @ projection, [0.001, 0.999], axis=0)
            width = np.maximum(high - low, 1e-12)
            # The grid is one and a half times as wide as the data, which is shifted inside it.
            self.scales.append((low - width * random.uniform(0, 0.5, self.dimensions), 1.5 * width))

    def numbers(self, vectors: np.ndarray) -> list[np.ndarray]:
        found = []
        for projection, (low, width) in zip(self.projections, self.scales, strict=True):
            cells = np.floor((vectors @ projection - low) / width * (1 << BITS))
            found.append(hilbert_numbers(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS))
        return found


# --- exact measure --------------------------------------------------------------------------------


def best_of(
    queries: np.ndarray,
    query_ids: np.ndarray,
    vectors: np.ndarray,
    ids: np.ndarray,
    k: int,
    least: np.ndarray | None = None,
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each query the ids and scores of its ``k`` nearest, other than itself: by score, then
    by id. ``least`` leaves out what is below a score that is surpassed already.

    A matrix product chooses candidates; their scores are summed again row by row, so equal
    vectors have equal scores wherever they stand.
    """
    if len(vectors) > VECTORS:
        parts = []
        bound = np.full(len(queries), -np.inf) if least is None else least.astype(np.float64)
        for at in range(0, len(vectors), VECTORS):
            some = slice(at, at + VECTORS)
            part = best_of(queries, query_ids, vectors[some], ids[some], k, bound)
            parts.append(part)
            full = [x[-1] if len(x) == k else -np.inf for x in part[1]]
            bound = np.maximum(bound, full)
        found_ids, found_scores = [], []
        for i in range(len(queries)):
            own = np.concatenate([p[0][i] for p in parts])
            scores = np.concatenate([p[1][i] for p in parts])
            order = np.lexsort((own, -scores))[:k]
            found_ids.append(own[order])
            found_scores.append(scores[order])
        return found_ids, found_scores
    found_ids, found_scores = [], []
    for at in range(0, len(queries), 512):
        block = queries[at : at + 512]
        rough = block @ vectors.T
        rough[query_ids[at : at + 512, None] == ids[None, :]] = -np.inf
        if rough.shape[1] > k:
            bound = np.partition(rough, -k, axis=1)[:, -k]
        else:
            bound = np.full(len(block), -np.inf)
        if least is not None:
            bound = np.maximum(bound, least[at : at + 512])
        size = np.sqrt((block * block).sum(1))
        for i in range(len(block)):
            own = np.flatnonzero(rough[i] >= bound[i] - _SLACK * (1 + size[i] * size[i]))
            own = own[np.isfinite(rough[i][own])]
            scores = (vectors[own] * block[i]).sum(1)
            order = np.lexsort((ids[own], -scores))[:k]
            found_ids.append(ids[own][order])
            found_scores.append(scores[order])
    return found_ids, found_scores


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


# --- search ---------------------------------------------------------------------------------------


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` of rows that take part, in double precision."""
    found = df.select(
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.col(f"`{vector}`").cast("array<double>").alias("vector"),
    ).filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    finite = F.forall(
        "vector",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return found.filter(finite & F.exists("vector", lambda x: x != 0))


def nearest(
    df: DataFrame,
    k: int = 20,
    every: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    curves: int = CURVES,
    stretch: int = STRETCH,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row whose id is divisible by
    ``every``, among all other rows."""
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    # Zero has one sign, so that equal vectors are equal keys.
    rows = (
        usable_vectors(df, key, vector)
        .withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
        .distinct()
    )
    # Classes of equal vectors, with as many of their smallest ids as any query can need. Each
    # task cuts a class to these before anything is shuffled.
    by_id = Window.partitionBy("vector").orderBy("id")
    smallest = rows.withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    asking = rows.filter(F.col("id") % every == 0).groupBy("vector").agg(F.count("id").alias("q"))
    classes = (
        smallest.groupBy("vector")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .join(asking, "vector", "left")
        .fillna(0, ["q"])
    )
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    common = sizes.first()
    if common is None:
        return empty
    dimension = common.n
    classes = materialise(
        classes.filter(F.size("vector") == dimension).withColumn("class", F.col("ids")[0]), "classes"
    )
    total = classes.count()

    # Bounded by SAMPLE: the scale of the curves and the ends of their stretches.
    sample = classes.select("vector").orderBy(F.xxhash64("class")).limit(SAMPLE).collect()
    points = np.array([row.vector for row in sample])
    shape = Curves(dimension, points, curves)
    n_stretches = max(1, math.ceil(total / stretch))
    ends = [
        np.quantile(numbers, np.arange(1, n_stretches) / n_stretches) for numbers in shape.numbers(points)
    ]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers = shape.numbers(_matrix(batch["vector"]))
            places = [np.searchsorted(e, n, side="right") for e, n in zip(ends, numbers, strict=True)]
            yield batch.assign(places=list(np.stack(places, axis=1).astype(np.int64)))

    placed = materialise(
        classes.mapInPandas(
            place, "vector array<double>, ids array<bigint>, q bigint, class bigint, places array<bigint>"
        ),
        "placed",
    )
    # Places that hold more than two stretches, and the blocks they are cut into: at most a row for
    # each two stretches of a curve.
    on_curves = F.explode(
        F.transform("places", lambda p, i: F.struct(i.alias("curve"), p.alias("place")))
    ).alias("at")
    crowded = (
        placed.select(on_curves)
        .groupBy("at.curve", "at.place")
        .count()
        .filter(F.col("count") > 2 * stretch)
        .select("curve", "place", F.ceil(F.col("count") / stretch).cast("int").alias("blocks"))
    )
    blocks = crowded.collect()
    asked = placed.filter(F.col("q") > 0)
    n_queries = asked.count()
    if not n_queries:
        return empty
    # A query block of at most about QUERIES queries meets a stretch in one task.
    salts = max(1, math.ceil(n_queries / QUERIES))
    answer = "query bigint, near array<bigint>, scores array<double>"

    def meet(queries: DataFrame, stretches: DataFrame) -> DataFrame:
        """Best in one stretch for each query that looks into it. ``queries`` has ``class, vector,
        least, curve, place``; ``stretches`` has ``class, vector, curve, place``."""
        spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0)
        left = queries.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(salts)).cast("int"))
        right = stretches.withColumn("salt", spread.cast("int") if salts == 1 else spread)
        by = ["curve", "place", "salt"]
        if blocks:

            def cut(side: DataFrame) -> DataFrame:
                made = spark.createDataFrame(blocks, "curve int, place bigint, blocks int")
                return side.join(F.broadcast(made), ["curve", "place"], "left")

            n = F.coalesce("blocks", F.lit(1))
            left = cut(left).withColumn("block", F.explode(F.sequence(F.lit(0), n - 1))).drop("blocks")
            # Another seed than the salt of the queries, which are vectors of the stretch too.
            block = F.pmod(F.xxhash64("class", F.lit(1)), n).cast("int")
            right = cut(right).withColumn("block", block).drop("blocks")
            # Both sides come from one table: columns of their own, or the groups are ambiguous.
            left, right = left.toDF(*left.columns), right.toDF(*right.columns)
            by = [*by, "block"]

        def both(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"query": [], "near": [], "scores": []}, dtype=object)
            own = q["class"].to_numpy()
            near, scores = best_of(
                _matrix(q["vector"]),
                own,
                _matrix(v["vector"]),
                v["class"].to_numpy(),
                k,
                q["least"].to_numpy(np.float64),
            )
            return pd.DataFrame({"query": own, "near": near, "scores": scores})

        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(both, answer)

    def merge(parts: DataFrame) -> DataFrame:
        """The ``k`` best of a query over all stretches it has looked into."""
        flat = parts.select("query", F.explode(F.arrays_zip("near", "scores")).alias("x")).distinct()
        pairs = F.transform(
            F.slice(
                F.array_sort(F.collect_list(F.struct((-F.col("x.scores")).alias("far"), "x.near"))), 1, k
            ),
            lambda x: x,
        )
        return flat.groupBy("query").agg(pairs.alias("best"))

    # Windows: the stretch of the query and its neighbours, on every curve.
    window = F.sequence(
        F.greatest(F.col("at.place") - 1, F.lit(0)),
        F.least(F.col("at.place") + 1, F.lit(n_stretches - 1)),
    )
    curved = placed.select("class", "vector", on_curves).select(
        "class", "vector", F.col("at.curve").alias("curve"), F.col("at.place").alias("place")
    )
    looks = (
        asked.select("class", "vector", on_curves)
        .select("class", "vector", F.col("at.curve").alias("curve"), F.explode(window).alias("place"))
        .withColumn("least", F.lit(float("-inf")))
    )
    first = materialise(meet(looks, curved), "windows")
    so_far = materialise(merge(first), "merged")

    # Stretches of the first curve: centre and radius. A stretch can hold a vector as near as the
    # last one found only if the query's product with its centre, and the radius, reach that far.
    spans = _spans(placed.select("vector", F.col("places")[0].alias("place")), dimension)
    last = F.when(F.size("best") >= k, -F.col("best")[k - 1]["far"]).otherwise(float("-inf"))
    wide = asked.select("class", "vector", F.col("places")[0].alias("own")).join(
        so_far.select(F.col("query").alias("class"), last.alias("least")), "class", "left"
    ).fillna(float("-inf"), ["least"])
    centres = np.array([s[1] for s in spans])
    radii = np.array([s[2] for s in spans])
    places = np.array([s[0] for s in spans])

    def open_more(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = _matrix(batch["vector"])
            reach = q @ centres.T + np.sqrt((q * q).sum(1))[:, None] * radii[None, :]
            least = batch["least"].to_numpy(np.float64)
            may = reach >= least[:, None] - _SLACK * (1 + np.abs(reach))
            may &= np.abs(places[None, :] - batch["own"].to_numpy()[:, None]) > 1
            i, j = np.nonzero(may)
            yield pd.DataFrame(
                {
                    "class": batch["class"].to_numpy()[i],
                    "vector": batch["vector"].to_numpy()[i],
                    "least": least[i],
                    "curve": np.zeros(len(i), np.int32),
                    "place": places[j],
                }
            )

    more = wide.mapInPandas(
        open_more, "class bigint, vector array<double>, least double, curve int, place bigint"
    )
    second = meet(more, curved.filter(F.col("curve") == 0))
    kept = so_far.select(
        "query",
        F.transform("best", lambda b: b["near"]).alias("near"),
        F.transform("best", lambda b: -b["far"]).alias("scores"),
    )
    best = merge(kept.unionByName(second))

    # From classes to rows: a class that is found stands for its smallest ids, and the query's own
    # class for its other members.
    members = placed.select("class", "ids", "vector", "q")
    own_score = F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    askers = (
        rows.filter(F.col("id") % every == 0)
        .select(F.col("id").alias("query_id"), "vector")
        .distinct()
        .join(members.select("vector", F.col("class").alias("query"), F.col("ids").alias("own")), "vector")
        .select("query_id", "query", "own", own_score.alias("own_score"))
    )
    found = best.select("query", F.explode("best").alias("b")).select(
        "query", F.col("b.near").alias("class"), (-F.col("b.far")).alias("score")
    )
    expanded = found.join(members.select("class", "ids"), "class").groupBy("query").agg(
        F.collect_list(F.struct("score", "ids")).alias("found")
    )
    others = F.flatten(
        F.transform(
            F.coalesce("found", F.expr("array()").cast("array<struct<score:double,ids:array<bigint>>>")),
            lambda f: F.transform(
                f["ids"], lambda i: F.struct((-f["score"]).alias("far"), i.alias("vec_id"))
            ),
        )
    )
    mates = F.transform(
        F.filter("own", lambda i: i != F.col("query_id")),
        lambda i: F.struct((-F.col("own_score")).alias("far"), i.alias("vec_id")),
    )
    ranked = F.slice(F.array_sort(F.concat(others, mates)), 1, k)
    return (
        askers.join(expanded, "query", "left")
        .select("query_id", F.posexplode(ranked).alias("pos", "hit"))
        .select(
            "query_id",
            (F.col("pos") + 1).cast("int").alias("rank"),
            F.col("hit.vec_id").alias("vec_id"),
            (-F.col("hit.far")).alias("score"),
        )
    )


def _spans(placed: DataFrame, dimension: int) -> list[tuple[int, np.ndarray, float]]:
    """Place, centre and radius of each stretch: one small row per STRETCH vectors."""
    centre = placed.groupBy("place").agg(
        F.array(*[F.avg(F.col("vector")[i]) for i in range(dimension)]).alias("centre")
    )
    square = F.aggregate(
        F.zip_with("vector", "centre", lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    radius = (
        placed.join(F.broadcast(centre), "place")
        .groupBy("place")
        .agg(F.max(F.sqrt(square)).alias("radius"))
    )
    found = centre.join(radius, "place").collect()
    return [(r.place, np.array(r.centre), r.radius) for r in found]
