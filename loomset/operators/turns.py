"""Between one row per turn and one row per conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.operators.sampling import number_rows
from loomset.operators.skew import HOT_ROWS


def turns_to_messages(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    turns_per_row: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One ``messages`` array per conversation, in turn order.

    ``turn`` orders a conversation; gaps do not matter, and equal turns are ordered by role and
    text. A row holds the whole conversation, which is the record asked for; picks and counts
    need no such row, see ``pick_turns``. Callers whose conversations do not fit into a row may ask
    for ``turns_per_row``, with ``turn`` an integer: rows then also have a ``part``, counted from
    0, and hold so many turns each.
    """
    rows = turns.select(conversation, turn, role, text)
    if turns_per_row is None:
        keys, order = [conversation], turn
    else:
        rows = number_rows(rows, conversation, turn, "_idx", hot_rows).withColumn(
            "part", F.expr(f"(_idx - 1) div {int(turns_per_row)}")
        )
        keys, order = [conversation, "part"], "_idx"
    collected = F.array_sort(
        F.collect_list(
            F.struct(F.col(order).alias("at"), F.col(role).alias("role"), F.col(text).alias("content"))
        )
    )
    plain = F.transform(
        "_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
    )
    return rows.groupBy(*keys).agg(collected.alias("_turns")).select(*keys, plain.alias("messages"))


def messages_to_turns(
    df: DataFrame, *keep: str, messages: str = "messages", keep_empty: bool = False
) -> DataFrame:
    """One row per message with its 0-based position, the reverse of ``turns_to_messages``.

    With ``keep_empty`` a row without messages gives one row whose position is NULL.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(*keep, explode(messages).alias("pos", "_m")).select(
        *keep, "pos", F.col("_m.role").alias("role"), F.col("_m.content").alias("content")
    )


def to_identity(messages: Column) -> Column:
    """Role/content messages in from/value form: ``user`` speaks as ``human``, no system turn."""
    spoken = F.filter(messages, lambda m: m["role"] != "system")
    return F.transform(
        spoken,
        lambda m: F.struct(
            F.when(m["role"] == "user", "human").otherwise(m["role"]).alias("from"),
            m["content"].alias("value"),
        ),
    )


def pick_turns(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    **picks: tuple[str, str, str | None],
) -> DataFrame:
    """First or last text of a role per conversation, straight from the turn table.

    Each pick is ``name=("first" | "last", role, default)``. The answer covers conversations of
    any length, since every task first reduces its own rows to one per conversation.
    """
    columns = []
    for name, (which, wanted, default) in picks.items():
        pick = {"first": F.min_by, "last": F.max_by}[which]
        mine = F.col(role) == wanted
        # The struct tells "no such turn" from a turn whose text is NULL.
        held = pick(F.struct(F.col(text).alias("t")), F.when(mine, F.col(turn)))
        columns.append(
            F.when(F.count(F.when(mine, 1)) > 0, held["t"]).otherwise(F.lit(default)).alias(name)
        )
    return turns.groupBy(conversation).agg(*columns)


def picked_messages(
    turns: DataFrame,
    which: str,
    *roles: str,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One ``messages`` array per conversation with the ``which`` ("first" or "last") turn of each
    role only, in the order of ``turns_to_messages``.

    For picks and pairs that read no other turn: they find in it what they would find in the whole
    conversation, whose array is never made. Every task first reduces its own rows.
    """
    end = {"first": F.min, "last": F.max}[which]
    said = F.struct(F.col(turn).alias("at"), F.col(role).alias("role"), F.col(text).alias("content"))
    ends = [end(F.when(F.col(role) == wanted, said)).alias(f"_{i}") for i, wanted in enumerate(roles)]
    picked = F.array_sort(F.array_compact(F.array(*[f"_{i}" for i in range(len(roles))])))
    plain = F.transform(picked, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return turns.groupBy(conversation).agg(*ends).select(conversation, plain.alias("messages"))


def count_messages(
    turns: DataFrame, *by: str, conversation: str = "conv_id", name: str = "n"
) -> DataFrame:
    """Messages per conversation and ``by``, counted in the turn table."""
    return turns.groupBy(conversation, *by).agg(F.count("*").cast("int").alias(name))
