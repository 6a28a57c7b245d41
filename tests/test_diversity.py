import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import diversity


def even_quotas(sizes, n):
    """Rows given one at a time, always by the strata that gave least and have more."""
    given = dict.fromkeys(sizes, 0)
    while sum(given.values()) < min(n, sum(sizes.values())):
        least = min(g for s, g in given.items() if g < sizes[s])
        open_ = [s for s, g in given.items() if g == least and g < sizes[s]]
        if sum(given.values()) + len(open_) > n:
            return given, n - sum(given.values()), open_
        for s in open_:
            given[s] += 1
    return given, 0, []


@pytest.fixture(scope="module")
def strata(spark):
    """One stratum holds a third, one has no name, many are tiny."""
    rng = random.Random(5)
    names = ["hot"] * 900 + [None] * 40 + [f"s{rng.randrange(60)}" for _ in range(700)] + ["mid"] * 200
    rows = [(n, i % 2 if n == "mid" else 0, i) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "a string, b int, id long").repartition(5)


@pytest.mark.parametrize("n", [0, 1, 5, 63, 64, 200, 1000, 1839, 1840, 9999])
def test_quotas_fill_like_water(strata, n):
    sizes = {(r.a, r.b): r["count"] for r in strata.groupBy("a", "b").count().collect()}
    want, rest, open_ = even_quotas(sizes, n)
    got = {(r.a, r.b): r.quota for r in diversity.quotas(strata, n, ["a", "b"], 3).collect()}
    assert sum(got.values()) == min(n, 1840) and set(got) == set(sizes)
    more = [s for s in sizes if got[s] != want[s]]
    assert len(more) == rest and all(got[s] == want[s] + 1 and s in open_ for s in more)


@pytest.mark.parametrize(("n", "ranked", "few"), [(200, 50_000, 100_000), (200, 7, 100_000), (1000, 20, 0), (5000, 7, 0)])
def test_rows_of_a_stratum_by_digest(spark, strata, monkeypatch, n, ranked, few):
    monkeypatch.setattr(diversity, "RANKED", ranked)
    monkeypatch.setattr(diversity, "BROADCAST_STRATA", few)
    got = diversity.spread_over_strata(strata, n, ["a", "b"], 3, "id")
    rows = got.collect()
    assert got.columns == strata.columns and len({r.id for r in rows}) == len(rows) == min(n, 1840)
    quotas = {(r.a, r.b): r.quota for r in diversity.quotas(strata, n, ["a", "b"], 3).collect()}
    assert Counter((r.a, r.b) for r in rows) == Counter({k: v for k, v in quotas.items() if v})
    digests = strata.select("a", "b", "id", F.md5(F.concat(F.lit("3:"), "id")).alias("d")).collect()
    for stratum, quota in quotas.items():
        first = sorted((r.d, r.id) for r in digests if (r.a, r.b) == stratum)[:quota]
        assert {r.id for r in rows if (r.a, r.b) == stratum} == {i for _, i in first}


def test_copies_are_taken_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(diversity, "RANKED", 5)
    df = spark.createDataFrame([("x", 1)] * 50 + [("y", 2)] * 3, "s string, v int")
    got = diversity.spread_over_strata(df, 20, ["s"], 1).groupBy("s").count().collect()
    assert {r.s: r["count"] for r in got} == {"x": 17, "y": 3}
    assert diversity.spread_over_strata(df.limit(0), 20, ["s"], 1).count() == 0


def least_radius_bound(vectors, n):
    """Selecting from all rows at once comes within twice of the least radius."""
    picked, _ = diversity.greedy(vectors, n + 1)
    apart = [np.linalg.norm(vectors[i] - vectors[j]) for i in picked for j in picked if i < j]
    return min(apart) / 2  # n balls cannot hold n + 1 points that far apart


@pytest.mark.parametrize("block", [8192, 64])
def test_farthest_points_cover_all_rows(spark, block):
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 5)) * 10
    vectors = np.concatenate([centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 5)), np.tile(centres[0], (300, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(None, [0.0] * 5), (9001, None), (9002, [None] * 5), (9003, [float("nan")] * 5), (9004, [float("inf")] * 5), (9005, [])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(7)
    got = diversity.farthest_points(df, 16, "id", "v", block).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 17)) and got[0].distance is None
    if block > 1200:
        assert [r.id for r in got] == diversity.greedy(vectors, 16)[0]
    assert len({tuple(vectors[r.id]) for r in got}) == 16
    for r in got[1:]:
        before = [np.linalg.norm(vectors[r.id] - vectors[x.id]) for x in got if x["rank"] < r["rank"]]
        assert math.isclose(min(before), r.distance)
    picked = spark.createDataFrame([(r.id,) for r in got], "id long")
    radius = diversity.covering_radius(df, picked, "id", "v")
    nearest = np.min([np.linalg.norm(vectors - vectors[r.id], axis=1) for r in got], axis=0)
    assert math.isclose(radius, nearest.max())
    rounds = 1 if block > 1200 else 3
    assert radius <= 2 * rounds * least_radius_bound(vectors, 16) * 2
    assert [tuple(r) for r in diversity.farthest_points(df.repartition(2), 16, "id", "v", block).orderBy("rank").collect()] == [tuple(r) for r in got]


def test_fewer_different_vectors_than_wanted(spark):
    df = spark.createDataFrame([(i, [float(i % 3)]) for i in range(30)], "id long, v array<float>")
    assert diversity.farthest_points(df, 9, "id", "v").count() == 3
    assert diversity.farthest_points(df.limit(0), 9, "id", "v").count() == 0
    with pytest.raises(ValueError, match="numbers"):
        diversity.farthest_points(df, 2, "v", "id")
