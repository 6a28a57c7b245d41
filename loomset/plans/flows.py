"""The end-to-end flows: math evaluation, preference data, text-to-SQL data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions import chat
from loomset.operators import evaluation
from loomset.operators.inference import Generate
from loomset.operators.math_data import process_math
from loomset.operators.preference import generate_pairs
from loomset.operators.sampling import assign_split, seeded_sample
from loomset.schemas import CHAT
from loomset.session import materialise
from loomset.sources.datasets import load_dataset, write_dataset

# How many text-to-SQL examples are taken and how many of them are for testing.
SQL_EXAMPLES = 12_500
SQL_TEST_SHARE = 2_500 / 12_500


def evaluate_models(
    examples: DataFrame,
    models: dict[str, Callable[..., Generate]],
    base: str,
    trained: str,
    style: str = "chatml",
    **settings,
) -> DataFrame:
    """Ask two models every math question and compare their accuracy, in one row.

    The reward stays on the row it was generated from, so nothing is joined. Rewards are
    written out before they are aggregated: generating is the dear step.
    """
    prompts = process_math(examples).select("ground_truth", "prompt")
    rewards = [
        evaluation.answer_examples(prompts, make_generate, style=style, **settings).select(
            F.lit(title).alias("model"), "reward"
        )
        for title, make_generate in models.items()
    ]
    stored = materialise(reduce(DataFrame.unionByName, rewards), "rewards")
    return evaluation.compare_models(evaluation.accuracy(stored, "model"), base, trained)


def preference_training(
    conversations: DataFrame,
    make_generate: Callable[..., Generate],
    positive: str,
    organization: str,
    out: str,
    name: str,
    *keep: str,
    **settings,
) -> DataFrame:
    """Answer the last question of every conversation, make pairs, store them as a dataset and
    read it back."""
    pairs = generate_pairs(
        conversations, make_generate, positive, organization, *keep, **settings
    ).withColumn("split", F.lit("train"))
    write_dataset(pairs, out, name, file_format="json")
    schema = pairs.drop("split").schema
    return load_dataset(conversations.sparkSession, out, name, schema=schema, file_format="json")


def text_to_sql_training(
    examples: DataFrame,
    out: str,
    name: str,
    seed: int,
    key: str,
    n: int = SQL_EXAMPLES,
    test_size: float | int = SQL_TEST_SHARE,
    template: str = chat.SQL_SYSTEM_PROMPT,
    style: str = "chatml",
) -> DataFrame:
    """Sample, split, build conversations, write JSON lines, read the training part back and
    render it as one ``text`` per example.

    The sample is written out once, so the steps after it no longer touch the whole table.
    Both splits go out in one pass, each to its own folder.
    """
    sample = materialise(seeded_sample(examples, n, seed, key), "sample")
    messages = chat.sql_conversation(
        F.col("context"), F.col("question"), F.col("answer"), template
    )
    split = assign_split(sample, test_size, seed + 1, key)
    write_dataset(split.select(messages.alias("messages"), "split"), out, name, file_format="json")
    train = load_dataset(examples.sparkSession, out, name, schema=CHAT, file_format="json")
    return train.select(chat.render(F.col("messages"), style).alias("text"))
