"""The first few rows of a dataset in readable form. The limit is the point of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions import chat
from loomset.operators.sampling import take_first

# Preview sizes and column titles.
CHAT_ROWS = 3
ROWS = 5
PROMPT_TITLE = "User Prompt"
RESPONSE_TITLE = "Assistant Response"


def preview_chat(df: DataFrame, order_by: str | list[str], n: int = CHAT_ROWS) -> DataFrame:
    """First user and first assistant text of the first ``n`` message rows."""
    return _head(df, order_by, n).select(
        chat.first_content(F.col("messages"), "user", chat.NO_USER_MESSAGE).alias(PROMPT_TITLE),
        chat.first_content(F.col("messages"), "assistant", chat.NO_ASSISTANT_MESSAGE).alias(
            RESPONSE_TITLE
        ),
    )


def preview_conversations(df: DataFrame, order_by: str | list[str], n: int = ROWS) -> DataFrame:
    """As ``preview_chat`` for ``messages``; last human and assistant value for
    ``conversations``; no rows for a table with neither column."""
    if "messages" in df.columns:
        return preview_chat(df, order_by, n)
    if "conversations" in df.columns:
        said = F.col("conversations")
        return _head(df, order_by, n).select(
            chat.last_value(said, "human", chat.NO_HUMAN_VALUE).alias(PROMPT_TITLE),
            chat.last_value(said, "assistant", chat.NO_ASSISTANT_VALUE).alias(RESPONSE_TITLE),
        )
    return df.sparkSession.createDataFrame([], f"`{PROMPT_TITLE}` string, `{RESPONSE_TITLE}` string")


def preview_rows(df: DataFrame, order_by: str | list[str], n: int = ROWS) -> DataFrame:
    """The first rows as they are: preference pairs, raw or processed math data."""
    return _head(df, order_by, n)


def show_full(preview: DataFrame, n: int = ROWS) -> None:
    """Print without cutting any cell."""
    preview.show(n, truncate=False)


def _head(df: DataFrame, order_by: str | list[str], n: int) -> DataFrame:
    return take_first(df, n, order_by) if n > 0 else df.limit(0)
