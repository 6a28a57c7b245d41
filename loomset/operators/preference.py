"""Chosen/rejected pairs: a model's answer is rejected, the same answer renamed is chosen."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import chat, text
from loomset.operators.inference import (
    MISSING_RESPONSE,
    Generate,
    generate_responses,
    response_or_error,
)
from loomset.operators.skew import join_hot

# Fixed value: both turns of a pair whose conversation asks nothing.
ERROR_TEXT = "Error"


def build_pairs(
    df: DataFrame,
    positive: str,
    organization: str,
    *keep: str,
    system_prompt: str = chat.ASSISTANT_SYSTEM_PROMPT,
    drop_identical: bool = False,
) -> DataFrame:
    """``chosen``, ``rejected`` and ``status`` from ``conversations`` and ``response``.

    The prompt is the last human value. Both sides carry the system prompt, though the
    response was generated without it. ``status`` is ``ok``, ``no_prompt`` (both sides are the
    error pair), ``no_response``, or ``error`` if ``df`` has an ``error`` that is not NULL: the
    response then is its text, and no answer of the model. Pairs whose sides are equal are kept
    unless told otherwise.
    """
    return _pairs(
        _with_prompt(df), positive, organization, *keep,
        system_prompt=system_prompt, drop_identical=drop_identical,
    )


def _with_prompt(df: DataFrame) -> DataFrame:
    """``_asked`` and ``_prompt`` in the place of ``conversations``."""
    said = F.col("conversations")
    return df.withColumns(
        {"_asked": chat.has_speaker(said, "human"), "_prompt": chat.last_value(said, "human")}
    ).drop("conversations")


def _pairs(
    df: DataFrame,
    positive: str,
    organization: str,
    *keep: str,
    system_prompt: str,
    drop_identical: bool,
) -> DataFrame:
    prompt = F.col("_prompt")
    rejected = F.col("_rejected")
    asked = F.col("_asked")
    error_pair = F.array(chat.message("user", ERROR_TEXT), chat.message("assistant", ERROR_TEXT))

    def side(reply: Column) -> Column:
        turns = F.array(
            chat.message("system", system_prompt),
            chat.message("user", prompt),
            chat.message("assistant", reply),
        )
        return F.when(asked, turns).otherwise(error_pair)

    chosen = text.literal_replace(rejected, organization, positive)
    found = df.withColumn("_rejected", F.coalesce(F.col("response"), F.lit(MISSING_RESPONSE)))
    failed = F.col("error").isNotNull() if "error" in df.columns else F.lit(False)
    if drop_identical:
        found = found.filter(asked & (chosen != rejected))
    return found.select(
        *keep,
        side(chosen).alias("chosen"),
        side(rejected).alias("rejected"),
        F.when(~asked, "no_prompt")
        .when(failed, "error")
        .when(F.col("response").isNull(), "no_response")
        .otherwise("ok")
        .alias("status"),
    )


def generate_pairs(
    df: DataFrame,
    make_generate: Callable[..., Generate],
    positive: str,
    organization: str,
    *keep: str,
    system_prompt: str = chat.ASSISTANT_SYSTEM_PROMPT,
    style: str = "chatml",
    drop_identical: bool = False,
    **settings: Any,
) -> DataFrame:
    """Pairs from conversations alone: the caller's model answers each prompt, without a system
    turn. What the model raises becomes the text of the answer, with status ``error``."""
    human = chat.last_value(F.col("conversations"), "human")
    asked = F.when(
        chat.has_speaker(F.col("conversations"), "human"),
        chat.render(chat.build_messages(human), style, True),
    )
    answered = generate_responses(df, make_generate, asked, **settings)
    return answered.withColumn("response", response_or_error()).transform(
        build_pairs,
        positive,
        organization,
        *keep,
        system_prompt=system_prompt,
        drop_identical=drop_identical,
    )


def pairs_from_responses(
    df: DataFrame,
    responses: DataFrame,
    key: str,
    positive: str,
    organization: str,
    *keep: str,
    system_prompt: str = chat.ASSISTANT_SYSTEM_PROMPT,
    drop_identical: bool = False,
    hot: list[int] | None = None,
) -> DataFrame:
    """Pairs from conversations and a table of stored responses, one ``response`` per key; a key
    with two responses gives two pairs. Of a conversation only the last prompt goes through the
    join.

    ``hot`` is the result of ``hot_hashes`` for the key where it is known already, from the table
    the conversations are made of; it is empty where a key has one conversation. Otherwise
    the conversations are computed once more to look for hot keys."""
    asked = _with_prompt(df).select(*dict.fromkeys([key, *keep]), "_asked", "_prompt")
    stored = responses.select(key, "response", *[c for c in responses.columns if c == "error"])
    return _pairs(
        join_hot(asked, stored, key, "left", hot=hot), positive, organization, *keep,
        system_prompt=system_prompt, drop_identical=drop_identical,
    )
