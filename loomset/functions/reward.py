"""Scoring completions against reference answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions.text import boxed_text


def boxed_answer(completion: Column) -> Column:
    """Boxed answer in a completion's first message; later messages are not looked at."""
    return boxed_text(F.get(completion, F.lit(0))["content"])


def exact_reward(boxed: Column, ground_truth: Column, strict: bool = False) -> Column:
    """1.0 where both strings are equal, else 0.0; nothing is trimmed or read as a number.

    An empty answer matches an empty ground truth unless ``strict``.
    """
    equal = boxed.eqNullSafe(ground_truth)
    if strict:
        equal = equal & (F.length(boxed) > 0)
    return F.when(equal, F.lit(1.0)).otherwise(F.lit(0.0))


def math_reward(completion: Column, ground_truth: Column, strict: bool = False) -> Column:
    return exact_reward(boxed_answer(completion), ground_truth, strict)
