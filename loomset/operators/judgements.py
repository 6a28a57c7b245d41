"""Scores from judgements given as pairs: which of two candidates somebody preferred."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomset.operators.skew import join_hot
from loomset.session import materialise

# Strengths of so many candidates may go to every task; more are joined by shuffles.
BROADCAST_ITEMS = 500_000


def bradley_terry(
    judgements: DataFrame,
    winner: str,
    loser: str,
    prior: float = 0.1,
    tolerance: float = 1e-8,
    most_rounds: int = 200,
) -> DataFrame:
    """``item, strength, wins, judged``: how strong each candidate is, so that the first of a pair
    wins with the probability of its share in the sum of both strengths. The logarithms of all
    strengths have the mean 0; candidates that no chain of judgements connects cannot be compared.

    ``prior`` is added to the wins of both sides of every two that met, so candidates that always or
    never won have a strength, too. A round takes two minorise-maximise steps, each a join and an
    aggregate over the distinct pairs, is written, and goes on as far as the two steps point (squared
    extrapolation, one number for all candidates). Rounds end when no logarithm of a strength moves
    by more than ``tolerance``.

    Judgements that lack a side or name one candidate twice say nothing and are left out.
    """
    if prior <= 0:
        raise ValueError("without a prior, candidates that never lost have no strength")
    known = F.col("w").isNotNull() & F.col("l").isNotNull() & (F.col("w") != F.col("l"))
    won = (
        judgements.select(F.col(winner).alias("w"), F.col(loser).alias("l"))
        .filter(known)
        .groupBy("w", "l")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # A row for each side of every two that met, however often they did.
    sides = F.inline(
        F.array(
            F.struct(F.col("w").alias("item"), F.col("l").alias("other"), F.col("n").alias("wins")),
            F.struct(F.col("l").alias("item"), F.col("w").alias("other"), F.lit(0).cast("long").alias("wins")),
        )
    )
    pairs = won.select("n", sides).groupBy("item", "other").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"))
    pairs = materialise(pairs, "pairs")
    totals = materialise(
        pairs.groupBy("item").agg(
            F.sum("wins").alias("wins"), F.sum("n").alias("judged"), F.count(F.lit(1)).alias("met")
        ),
        "wins",
    )
    few = totals.count() <= BROADCAST_ITEMS

    def joined(rows: DataFrame, on: str, strengths: DataFrame, x: str) -> DataFrame:
        found = strengths.select(F.col("item").alias(on), F.exp(x).alias(f"of_{on}"))
        return rows.join(F.broadcast(found), on) if few else join_hot(rows, found, on)

    def step(strengths: DataFrame, before: str, after: str) -> DataFrame:
        """``strengths`` with the logarithms that follow from those ``before``."""
        met = joined(joined(pairs, "item", strengths, before), "other", strengths, before)
        share = (F.col("n") + 2 * prior) / (F.col("of_item") + F.col("of_other"))
        load = met.groupBy("item").agg(F.sum(share).alias("load"))
        moved = F.log((F.col("wins") + prior * F.col("met")) / F.col("load"))
        return strengths.join(load, "item").withColumn(after, moved).drop("load")

    strengths = totals.withColumn("x", F.lit(0.0))
    for _ in range(most_rounds):
        moved = step(step(strengths, "x", "x1"), "x1", "x2")
        first = F.col("x1") - F.col("x")
        turn = F.col("x2") - F.col("x1") - first
        seen = Observation()
        watched = moved.observe(
            seen, F.sum(first * first).alias("first"), F.sum(turn * turn).alias("turn")
        )
        written = materialise(watched, "strengths")
        if not seen.get["first"]:  # no candidates, or none that moves
            strengths = written
            break
        reach = max(1.0, math.sqrt(seen.get["first"] / seen.get["turn"])) if seen.get["turn"] else 1.0
        onward = written.select(
            "item", "wins", "judged", "met", (F.col("x") + 2 * reach * first + reach**2 * turn).alias("x"),
            F.abs(2 * reach * first + reach**2 * turn).alias("far"),
        )
        strengths = onward.drop("far")
        farthest = onward.agg(F.max("far")).first()[0]
        if farthest <= tolerance:
            break
    else:
        raise ValueError(f"strengths still move by {farthest} after {most_rounds} rounds")
    mean = strengths.agg(F.avg("x")).first()[0] or 0.0
    return strengths.select("item", F.exp(F.col("x") - F.lit(mean)).alias("strength"), "wins", "judged")


def judged_scores(
    candidates: DataFrame, strengths: DataFrame, key: str, score: str = "score"
) -> DataFrame:
    """Candidates with the logarithm of their strength as ``score``; NULL for those nobody
    judged."""
    found = strengths.select(F.col("item").alias(key), F.log("strength").alias(score))
    others = [c for c in candidates.columns if c != score]
    return join_hot(candidates.select(*others), found, key, "left").select(*others, score)
