import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import evaluation, judgements, selection


def fitted(rows, prior, rounds=5000):
    names = sorted({x for pair in rows for x in pair})
    at = {x: i for i, x in enumerate(names)}
    wins = np.zeros((len(names), len(names)))
    for w, l in rows:
        wins[at[w], at[l]] += 1
    wins += prior * ((wins + wins.T) > 0)
    p, met = np.ones(len(names)), wins + wins.T
    for _ in range(rounds):
        p = wins.sum(1) / (met / (p[:, None] + p)).sum(1)
    return dict(zip(names, p / np.exp(np.log(p).mean()), strict=True))


@pytest.mark.parametrize("few", [500_000, 0])
def test_strengths_are_those_of_a_plain_fit(spark, monkeypatch, few):
    monkeypatch.setattr(judgements, "BROADCAST_ITEMS", few)
    rng = random.Random(2)
    rows = []
    for _ in range(200):
        a, b = rng.sample(range(6), 2)
        rows.append((f"i{a}", f"i{b}") if rng.random() < (a + 1) / (a + b + 2) else (f"i{b}", f"i{a}"))
    rows += [("top", "i3"), ("top", "i5"), ("i2", "never")]  # one-sided
    odd = [("i1", None), (None, "i1"), ("i1", "i1")]
    df = spark.createDataFrame(rows + odd, "w string, l string")
    got = judgements.bradley_terry(df, "w", "l", prior=2).collect()
    want = fitted(rows, 2)
    assert {r.item for r in got} == set(want)
    for r in got:
        assert math.isclose(r.strength, want[r.item], rel_tol=1e-6)
        assert r.wins == sum(w == r.item for w, _ in rows) and r.judged == sum(r.item in x for x in rows)
    assert judgements.bradley_terry(df.limit(0), "w", "l").count() == 0


def test_judged_candidates_and_the_best_of_them(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "w string, l string")
    strengths = judgements.bradley_terry(df, "w", "l")
    candidates = spark.createDataFrame([(1, "b"), (1, "c"), (2, "a"), (2, "d"), (3, "d")], "p long, k string")
    scored = judgements.judged_scores(candidates, strengths, "k")
    assert scored.columns == ["p", "k", "score"] and scored.filter("k = 'd' AND score IS NULL").count() == 2
    assert {(r.p, r.k) for r in selection.best_of(scored, "p", "k", "score").collect()} == {(1, "c"), (2, "a")}
    with pytest.raises(ValueError, match="prior"):
        judgements.bradley_terry(df, "w", "l", prior=0)
    with pytest.raises(ValueError, match="move"):
        judgements.bradley_terry(df.union(df.limit(1)), "w", "l", most_rounds=1)


def test_best_of_with_any_key(spark):
    rows = [(1, "b", 1), (1, "a", 2**62), (1, "c", 2**62), (2, "x", -(2**63)), (2, "w", -(2**63)), (3, "n", None)]
    df = spark.createDataFrame(rows, "p long, k string, score long")
    assert {(r.p, r.k) for r in selection.best_of(df, "p", "k", "score").collect()} == {(1, "a"), (2, "w")}
    pairs = selection.best_worst_pairs(df, "p", "k", "score", "k").collect()
    assert [(r.p, r.chosen, r.rejected) for r in pairs] == [(1, "a", "b")]
    odd = spark.createDataFrame([(1, "a", float("nan")), (1, "b", 0.5), (2, "c", float("nan"))], "p long, k string, score double")
    assert [tuple(r) for r in selection.best_of(odd, "p", "k", "score").collect()] == [(1, "b", 0.5)]


def returns(rewards, discount):
    out, after = [], 0.0
    for r in reversed(rewards):
        after = (r or 0.0) + discount * after
        out.append(after)
    return out[::-1]


@pytest.mark.parametrize(("discount", "hot_rows"), [(1.0, 100_000), (0.99, 1000), (0.5, 100_000), (1e-3, 100_000), (1e-300, 100_000), (0.0, 1000)])
def test_returns_of_long_conversations(spark, discount, hot_rows):
    rng = random.Random(1)
    lengths = {"long": 20_000, "a": 1, "b": 64, "c": 65, None: 130, "d": 4096}
    rewards = {c: [rng.choice([None, 0.0, rng.uniform(-1, 1)]) for _ in range(n)] for c, n in lengths.items()}
    rows = [(c, i * 3, r) for c, x in rewards.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "c string, t long, r double").repartition(6)
    got = selection.discounted_returns(df, "c", "t", "r", discount, hot_rows=hot_rows)
    assert got.columns == ["c", "t", "r", "return"]
    found = {(r.c, r.t): r["return"] for r in got.collect()}
    assert len(found) == len(rows)
    for c, x in rewards.items():
        for i, want in enumerate(returns(x, discount)):
            assert math.isclose(found[c, i * 3], want, rel_tol=1e-9, abs_tol=1e-9)


def test_first_turn_has_the_whole_reward(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(200)], "c long, t long, r double")
    first = selection.discounted_returns(df, "c", "t", "r").filter("t = 0").first()["return"]
    assert first == selection.trajectory_rewards(df, "c", "t", "r").first().total_reward
    assert selection.discounted_returns(df.limit(0), "c", "t", "r").count() == 0


def test_bootstrap_weights_and_bounds(spark):
    steps = evaluation.POISSON_STEPS
    below, term = 0.0, math.exp(-1)
    for k, step in enumerate(steps):
        below += term
        term /= k + 1
        assert step == math.floor(below * 65536)
    rng = random.Random(3)
    rows = []
    for i in range(600):
        base = float(rng.random() < 0.5)
        rows += [("base", i, base), ("new", i, max(base, float(rng.random() < 0.1)))]
    rows += [("base", 9000, 1.0), ("new", 9001, 1.0), ("other", 1, 1.0)]
    df = spark.createDataFrame(rows, "model string, id long, reward double")
    r = evaluation.improvement_interval(df, "base", "new", "id", replicates=400).first()
    gains = [b[2] - a[2] for a, b in zip(rows[:1200:2], rows[1:1200:2], strict=True)]
    mean, error = sum(gains) / 600, np.std(gains) / math.sqrt(600)
    assert r.examples == 600 and math.isclose(r.improvement, mean)
    assert math.isclose(r.low, mean - 1.96 * error, abs_tol=0.4 * error)
    assert math.isclose(r.high, mean + 1.96 * error, abs_tol=0.4 * error)
    none = evaluation.improvement_interval(df.limit(0), "base", "new", "id").first()
    assert (none.examples, none.improvement, none.low, none.high) == (0, None, None, None)
    again = evaluation.improvement_interval(df.repartition(7), "base", "new", "id", replicates=400).first()
    assert again == r


def test_one_pass_for_all_replicates(spark):
    df = spark.range(10).select(F.lit("a").alias("model"), F.col("id"), F.lit(1.0).alias("reward"))
    plan = evaluation.improvement_interval(df, "a", "b", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
