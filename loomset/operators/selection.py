"""Choosing training rows: best of several responses, thresholds, pairs, filters, diversity."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType, IntegralType

from loomset.functions import chat
from loomset.operators.inference import Generate, generate_responses
from loomset.operators.sampling import number_rows
from loomset.operators.skew import HOT_ROWS, join_hot
from loomset.session import materialise

# Fixed value: what is added to the deviation of a group before dividing by it.
ADVANTAGE_EPSILON = 1e-4

# Turns of a conversation that are summed together.
STRETCH = 64


def best_of(
    candidates: DataFrame, prompt: str, key: str, score: str, *keep: str
) -> DataFrame:
    """The candidate with the highest score of each prompt; ties go to the smallest ``key``, which
    may be of any type with an order.

    One aggregate: each task first keeps one candidate per prompt of its own rows. Candidates
    without a score are left out, and so are those whose score is no number.
    """
    return _extremes(candidates, prompt, key, score, keep).select(
        prompt, *[F.col(f"_best.{c}").alias(c) for c in (key, score, *keep)]
    )


def _extremes(candidates: DataFrame, prompt: str, key: str, score: str, keep: tuple) -> DataFrame:
    held = F.struct(*[F.col(c) for c in dict.fromkeys([key, score, *keep])])
    known = F.col(score).isNotNull()
    if isinstance(candidates.schema[score].dataType, FractionalType):
        known = known & ~F.isnan(F.col(score).cast("double"))
    return (
        candidates.filter(known)
        .groupBy(prompt)
        .agg(
            F.min_by(held, F.struct(_downwards(candidates, score), F.col(key))).alias("_best"),
            F.min_by(held, F.struct(F.col(score), F.col(key))).alias("_worst"),
        )
    )


def _downwards(candidates: DataFrame, score: str) -> Column:
    """A number that falls as the score rises, exact for whole numbers of any size."""
    column = F.col(score)
    if isinstance(candidates.schema[score].dataType, IntegralType):
        column = column.cast("decimal(20,0)")
    return -column


def reject_below(
    candidates: DataFrame, least: float, prompt: str, key: str, score: str, most: int | None = None
) -> DataFrame:
    """Candidates that score at least ``least``; with ``most`` the best so many of each prompt,
    which each task cuts down to before anything is shuffled."""
    passed = candidates.filter(F.col(score) >= least)
    if most is None:
        return passed
    ranked = Window.partitionBy(prompt).orderBy(F.desc(score), key)
    return (
        passed.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= most)
        .drop("_rank")
    )


def best_worst_pairs(
    candidates: DataFrame, prompt: str, key: str, score: str, response: str
) -> DataFrame:
    """The best response of each prompt as ``chosen`` and the worst as ``rejected``, with their
    scores. Prompts whose best and worst score are the same make no pair."""
    both = _extremes(candidates, prompt, key, score, (response,))
    return both.filter(F.col(f"_best.{score}") > F.col(f"_worst.{score}")).select(
        prompt,
        F.col(f"_best.{response}").alias("chosen"),
        F.col(f"_worst.{response}").alias("rejected"),
        F.col(f"_best.{score}").alias("chosen_score"),
        F.col(f"_worst.{score}").alias("rejected_score"),
    )


def human_or_model_score(
    candidates: DataFrame, judged: DataFrame, on: str, human: str, model: str
) -> DataFrame:
    """``score`` and ``score_source``: what a person said about a candidate, else what the model
    said. ``judged`` has one row per key."""
    joined = candidates.join(judged.select(on, human), on, "left")
    said, thought = F.col(human), F.col(model)
    source = F.when(said.isNotNull(), "human").when(thought.isNotNull(), "model")
    others = [c for c in candidates.columns if c not in (human, model)]
    return joined.select(
        *others, F.coalesce(said, thought).alias("score"), source.alias("score_source")
    )


def correction_pairs(originals: DataFrame, improved: DataFrame, prompt: str, response: str) -> DataFrame:
    """The improved response as ``chosen``, the original as ``rejected``, where both are there and
    differ. Both have one row per prompt."""
    joined = join_hot(
        originals.select(prompt, F.col(response).alias("rejected")),
        improved.select(prompt, F.col(response).alias("chosen")),
        prompt,
    )
    return joined.filter(F.col("chosen") != F.col("rejected")).select(prompt, "chosen", "rejected")


def group_advantage(rewards: DataFrame, prompt: str, reward: str = "reward") -> DataFrame:
    """``advantage``: a reward against the others of its prompt, in deviations. It is 0 for
    prompts with one reward or with equal ones.

    Groups are aggregated and joined back, so a prompt with very many responses is no load for
    one task.
    """
    groups = rewards.groupBy(prompt).agg(
        F.avg(reward).alias("_mean"), F.stddev_samp(reward).alias("_deviation")
    )
    advantage = (F.col(reward) - F.col("_mean")) / (F.col("_deviation") + ADVANTAGE_EPSILON)
    return (
        join_hot(rewards, groups, prompt)
        .withColumn("advantage", F.coalesce(advantage, F.lit(0.0)))
        .drop("_mean", "_deviation")
    )


def trajectory_rewards(
    turns: DataFrame, conversation: str, turn: str, reward: str, *by: str
) -> DataFrame:
    """``total_reward`` and ``last_reward`` of whole conversations; rewards are not discounted."""
    return turns.groupBy(conversation, *by).agg(
        F.sum(reward).alias("total_reward"), F.max_by(reward, turn).alias("last_reward")
    )


def discounted_returns(
    turns: DataFrame,
    conversation: str,
    turn: str,
    reward: str,
    discount: float = 1.0,
    name: str = "return",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the return from each turn on: its reward, plus ``discount`` times the return of the next.

    That is a linear recurrence, so stretches of turns are summed on their own, each becomes one
    row (its sum, and the factor over its length), these are summed in the same way, and what
    follows a stretch is added to its turns. A conversation of any length is spread over tasks:
    nothing holds more than a stretch of it. ``turn`` is a number, date or time, unique in a
    conversation; a missing reward counts as 0. With a discount of 1 the first turn has the whole
    reward of ``trajectory_rewards``.
    """
    if not 0.0 <= discount <= 1.0:
        raise ValueError("a discount lies between 0 and 1")
    numbered = number_rows(turns, conversation, turn, "_place", hot_rows).withColumns(
        {
            # A struct equals itself even where the conversation is NULL.
            "_of": F.struct(conversation),
            "_place": F.col("_place") - 1,
            "_value": F.coalesce(F.col(reward).cast("double"), F.lit(0.0)),
        }
    )
    longest = numbered.agg(F.max("_place")).first()[0] or 0
    summed = _sums_from_here(numbered, discount, longest)
    return summed.select(*turns.columns, F.col("_sum").alias(name))


def _sums_from_here(rows: DataFrame, factor: float, last: int) -> DataFrame:
    """``rows`` with ``_sum``, the values of each ``_of`` from ``_place`` up to ``last``, weighed by
    powers of the factor."""
    if factor ** (STRETCH - 1) < 1e-290:  # what follows is too small to be added to anything
        if factor < 1e-290:
            return rows.withColumn("_sum", F.col("_value"))
        size = max(2, int(290 / -math.log10(factor)))
    else:
        size = STRETCH
    within, stretch = F.col("_place") % size, F.floor(F.col("_place") / size)
    # A table of powers: no power is so small that dividing by it loses digits.
    power = F.element_at(F.array(*[F.lit(factor**i) for i in range(size)]), (within + 1).cast("int"))
    later = Window.partitionBy("_of", "_stretch").orderBy(F.desc("_place"))
    so_far = later.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = (
        rows.withColumns({"_stretch": stretch, "_power": power})
        .withColumn("_sum", F.sum(F.col("_value") * F.col("_power")).over(so_far) / F.col("_power"))
        .drop("_power")
    )
    if last < size:
        return inner.drop("_stretch")
    inner = materialise(inner, "returns")
    sums = inner.filter(within == 0).select("_of", F.col("_stretch").alias("_place"), F.col("_sum").alias("_value"))
    onward = _sums_from_here(sums, factor**size, last // size).select(
        "_of", (F.col("_place") - 1).alias("_stretch"), F.col("_sum").alias("_after")
    )
    rest = F.element_at(F.array(*[F.lit(factor ** (size - i)) for i in range(size)]), (within + 1).cast("int"))
    return (
        inner.join(onward, ["_of", "_stretch"], "left")
        .withColumn("_sum", F.col("_sum") + F.coalesce(rest * F.col("_after"), F.lit(0.0)))
        .drop("_stretch", "_after")
    )


def keep_quality(documents: DataFrame, labels: DataFrame, on: str, good: Column) -> DataFrame:
    """Documents with a label row for which ``good`` holds."""
    return documents.join(labels.filter(good).select(on), on, "left_semi")


def distinct_texts(documents: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """One row per distinct text, the one with the smallest ``key``. Only digests are shuffled."""
    held = F.struct(*[F.col(c) for c in dict.fromkeys([key, *keep])])
    return (
        documents.groupBy(F.sha2(text, 256).alias("_digest"))
        .agg(F.min_by(held, key).alias("_row"))
        .select("_row.*")
    )


def per_stratum(documents: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each stratum, drawn by a seeded hash of ``key``."""
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ranked = Window.partitionBy(*strata).orderBy(drawn, key)
    return (
        documents.withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def distillation_set(
    df: DataFrame, make_generate: Callable[..., Generate], prompt: Column, *keep: str, **settings: Any
) -> DataFrame:
    """``messages`` of a question and a stronger model's answer. What the model refuses is left
    out."""
    asked = df.withColumn("_prompt", prompt)
    rendered = chat.render(chat.build_messages(F.col("_prompt")), "chatml", True)
    answered = generate_responses(asked, make_generate, rendered, **settings)
    return answered.filter(F.col("response").isNotNull()).select(
        *keep,
        F.array(
            chat.message("user", F.col("_prompt")), chat.message("assistant", F.col("response"))
        ).alias("messages"),
    )
