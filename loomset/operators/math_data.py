"""Math examples: reference answer and prompt from question and worked answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions import chat, text


def process_math(
    df: DataFrame,
    system_prompt: str = chat.MATH_SYSTEM_PROMPT,
    question: str = "question",
    answer: str = "answer",
) -> DataFrame:
    """Append ``ground_truth`` and ``prompt``, drop ``question`` and ``answer``.

    A NULL answer gives a NULL ground truth and keeps its prompt.
    """
    return df.withColumns(
        {
            "ground_truth": text.gold_answer(F.col(answer)),
            "prompt": chat.math_prompt(F.col(question), system_prompt),
        }
    ).drop(question, answer)
