"""Accuracy of stored or fresh completions against reference answers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import chat, reward, text
from loomset.operators.inference import Generate, generate_responses, response_or_error
from loomset.operators.skew import join_hot


def score_predictions(
    predictions: DataFrame,
    gold: DataFrame,
    key: str,
    completion: str = "completion",
    ground_truth: str = "ground_truth",
    strict: bool = False,
) -> DataFrame:
    """Join predictions to reference answers by key and add ``boxed`` and ``reward``.

    The completion is reduced to its boxed answer before the join, so the shuffle carries a
    short string and not the whole text. A prediction without a reference answer is left out;
    ``unmatched_keys`` counts those.
    """
    boxed = predictions.withColumn("boxed", reward.boxed_answer(F.col(completion))).drop(completion)
    truth = gold.select(key, F.col(ground_truth).alias("ground_truth"))
    return join_hot(boxed, truth, key).withColumn(
        "reward", reward.exact_reward(F.col("boxed"), F.col("ground_truth"), strict)
    )


def answer_examples(
    examples: DataFrame,
    make_generate: Callable[..., Generate],
    score: Callable[[Column, Column], Column] = reward.math_reward,
    style: str = "chatml",
    **settings: Any,
) -> DataFrame:
    """Ask a model every ``prompt`` and add ``response`` and ``reward``.

    ``score`` makes the reward from the completion and the ``ground_truth``; what the model
    raises is scored as its answer.
    """
    asked = chat.render(F.col("prompt"), style, True)
    answered = generate_responses(examples, make_generate, asked, **settings)
    return (
        answered.withColumn("response", response_or_error())
        .drop("error")
        .withColumn("reward", score(chat.assistant_reply(F.col("response")), F.col("ground_truth")))
    )


def accuracy(
    scored: DataFrame, *by: str, score: str = "reward", examples: DataFrame | None = None
) -> DataFrame:
    """Accuracy, number of examples and sum of rewards, overall or per model.

    With ``examples``, the table that was asked, an example without an answer counts as a wrong
    one: every model is measured on all examples, which are counted once. Without it only what
    has been answered counts. Overall figures of an empty table are 0.0, 0 and 0.0.
    """
    right = F.coalesce(F.sum(score), F.lit(0.0))
    if examples is None:
        total, mean = F.count(F.lit(1)), F.coalesce(F.avg(score), F.lit(0.0))
    else:
        n = examples.count()
        total = F.lit(n).cast("bigint")
        mean = right / F.lit(n) if n else F.lit(0.0)
    return scored.groupBy(*by).agg(
        mean.alias("accuracy"), total.alias("total_examples"), right.alias("correct_predictions")
    )


def unmatched_keys(predictions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """How many predictions lack a reference answer and the other way round, in one row.

    Both sides are first counted per key, so a hot key is one row by the time they meet.
    """
    said = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("said"))
    known = gold.groupBy(key).agg(F.count(F.lit(1)).alias("known"))
    both = said.join(known, key, "full")
    return both.agg(
        _total(F.when(F.col("known").isNull(), F.col("said"))).alias("unmatched_predictions"),
        _total(F.when(F.col("said").isNull(), F.col("known"))).alias("unmatched_examples"),
    )


# The least 16-bit numbers with which a Poisson(1) weight is 1, 2, 3 and so on.
POISSON_STEPS = (24109, 48218, 60273, 64291, 65296, 65497, 65530, 65535)

# Weights that one digest gives.
_PER_DIGEST = 8


def improvement_interval(
    scored: DataFrame,
    base: str | int,
    trained: str | int,
    key: str,
    model: str = "model",
    score: str = "reward",
    replicates: int = 200,
    level: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """One row: the improvement of ``trained`` over ``base`` on the examples both have answered,
    and the bounds between which it lies in a share ``level`` of bootstrap replicates.

    A replicate weighs every example by a Poisson number with mean 1, taken from a digest of seed,
    example and replicate: the same numbers whichever task has the example, and for both models,
    so what they have in common cancels. All replicates are summed in one pass over the examples.
    Bounds are NULL without examples.
    """
    def of(name: str | int) -> Column:
        return F.avg(F.when(F.col(model) == F.lit(name), F.col(score)))

    paired = (
        scored.filter(F.col(model).isin(base, trained))
        .groupBy(key)
        .agg(of(base).alias("base"), of(trained).alias("trained"))
        .filter(F.col("base").isNotNull() & F.col("trained").isNotNull())
    )
    blocks = -(-replicates // _PER_DIGEST)
    named = F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"), F.lit(":"), F.col("block").cast("string"))
    numbers = F.array(*[F.substring("digest", 4 * i + 1, 4) for i in range(_PER_DIGEST)])
    # Hex digits of one length are in the order of their numbers.
    steps = [(F.col("number") >= F.lit(f"{step:04x}")).cast("int") for step in POISSON_STEPS]
    weighed = (
        paired.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        .withColumn("digest", F.md5(named))
        .select("base", "trained", "block", F.posexplode(numbers).alias("at", "number"))
        .filter(F.col("number") >= F.lit(f"{POISSON_STEPS[0]:04x}"))
        .withColumn("replicate", F.col("block") * _PER_DIGEST + F.col("at"))
        .filter(F.col("replicate") < replicates)
        .withColumn("weight", sum(steps, F.lit(0)))
    )
    change = F.sum(F.col("weight") * (F.col("trained") - F.col("base"))) / F.sum("weight")
    changes = weighed.groupBy("replicate").agg(change.alias("change"))
    tail = (1 - level) / 2
    bounds = changes.agg(
        F.percentile("change", F.lit(tail)).alias("low"), F.percentile("change", F.lit(1 - tail)).alias("high")
    )
    whole = paired.agg(
        F.count(F.lit(1)).alias("examples"), F.avg(F.col("trained") - F.col("base")).alias("improvement")
    )
    # One row on either side.
    return whole.join(F.broadcast(bounds)).select("examples", "improvement", "low", "high")


def compare_models(
    metrics: DataFrame, base: str | int, trained: str | int, model: str = "model"
) -> DataFrame:
    """One row with both accuracies, their difference, and all three as percentages."""

    def of(name: str | int) -> Column:
        return F.max(F.when(F.col(model) == F.lit(name), F.col("accuracy")))

    return metrics.agg(of(base).alias("base_accuracy"), of(trained).alias("trained_accuracy")).select(
        "base_accuracy",
        "trained_accuracy",
        (F.col("trained_accuracy") - F.col("base_accuracy")).alias("improvement"),
        text.percent(F.col("base_accuracy")).alias("base_percent"),
        text.percent(F.col("trained_accuracy")).alias("trained_percent"),
        text.percent(F.col("trained_accuracy") - F.col("base_accuracy")).alias("improvement_percent"),
    )


def python_reward(
    score: Callable[..., list[float]], completion: Column, ground_truth: Column, **extra: Column
) -> Column:
    """A reward written in Python, called on Arrow batches.

    ``score(completions, ground_truth, **extra)`` gets lists and returns one number per row.
    Rewards that built-in functions can express belong in ``functions.reward`` instead.
    """
    names = list(extra)

    @F.arrow_udf("double")
    def run(completions: pa.Array, truths: pa.Array, *rest: pa.Array) -> pa.Array:
        given = _message_lists(completions)
        more = {name: _values(values) for name, values in zip(names, rest)}
        rewards = score(given, _values(truths), **more)
        if len(rewards) != len(given):
            raise ValueError(f"{len(rewards)} rewards for {len(given)} completions")
        return pa.array(rewards, pa.float64())

    return run(completion, ground_truth, *extra.values())


def _message_lists(completions: pa.Array) -> list[list[dict[str, str]] | None]:
    """Message lists, column by column: quicker than turning nested rows into Python one by one."""
    turns = completions.flatten()
    messages = iter(
        [
            {"role": role, "content": content}
            for role, content in zip(_values(turns.field("role")), _values(turns.field("content")))
        ]
    )
    return [
        None if size < 0 else list(islice(messages, size))
        for size in _values(completions.value_lengths().fill_null(-1))
    ]


def _values(column: pa.Array) -> list:
    """``to_pylist``, by way of NumPy where that keeps the values as they are."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    number = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    if text or (number and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))
