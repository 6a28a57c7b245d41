"""Chat messages as nested columns: building, picking, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomset.functions.text import fill_template
from loomset.schemas import MESSAGES

# Texts shown when a conversation lacks the wanted turn.
NO_USER_MESSAGE = "No user message found"
NO_ASSISTANT_MESSAGE = "No assistant message found"
NO_HUMAN_VALUE = "No human message"
NO_ASSISTANT_VALUE = "No assistant message"

# System prompts.
ASSISTANT_SYSTEM_PROMPT = "You're a helpful assistant."
MATH_SYSTEM_PROMPT = (
    "You are a helpful assistant that solves problems step-by-step. "
    "Always include the final numeric answer inside \\boxed{}."
)
SQL_SYSTEM_PROMPT = "You are an text to SQL query translator..."

# What surrounds each role's content in the plain style.
PLAIN_STYLE = {
    "system": ("System: ", "\n\n"),
    "user": ("User: ", "\n\n"),
    "assistant": ("Assistant: ", " <|endoftext|>\n"),
}
# The ChatML style.
CHATML_START = "<|im_start|>"
CHATML_END = "<|im_end|>\n"


def _column(value: str | Column | None) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("string")


def message(role: str, content: str | Column | None) -> Column:
    return F.struct(F.lit(role).alias("role"), _column(content).alias("content"))


def of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def first_content(messages: Column, role: str, default: str) -> Column:
    """Content of the role's first message. ``default`` stands in only when there is no such
    message: one whose content is NULL gives NULL."""
    found = of_role(messages, role)
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))["content"]).otherwise(F.lit(default))


def last_value(conversation: Column, speaker: str, default: str | None = None) -> Column:
    """Value of the speaker's last turn, ``default`` when the speaker has none."""
    said = F.filter(conversation, lambda m: m["from"] == speaker)
    value = F.try_element_at(said, F.lit(-1))["value"]
    return value if default is None else F.when(F.size(said) > 0, value).otherwise(F.lit(default))


def has_speaker(conversation: Column, speaker: str) -> Column:
    return F.coalesce(F.exists(conversation, lambda m: m["from"] == speaker), F.lit(False))


def build_messages(
    user: str | Column | None = None,
    system: str | Column | None = None,
    full: Column | None = None,
    always_user: bool = False,
) -> Column:
    """System and user turns as a message array.

    Empty and NULL texts add no turn, except that ``always_user`` keeps the user turn whatever
    it holds. A non-empty ``full`` array wins over both.
    """

    def present(text: Column) -> Column:
        return F.coalesce(F.length(text) > 0, F.lit(False))

    system, user = _column(system), _column(user)
    user_turn = message("user", user)
    built = F.filter(
        F.array(
            F.when(present(system), message("system", system)),
            user_turn if always_user else F.when(present(user), user_turn),
        ),
        lambda m: m.isNotNull(),
    ).cast(MESSAGES)
    return built if full is None else F.when(F.size(full) > 0, full).otherwise(built)


def sql_conversation(
    context: Column, question: Column, answer: Column, template: str = SQL_SYSTEM_PROMPT
) -> Column:
    """System, user and assistant turns of a text-to-SQL example.

    The default system text has no ``{schema}`` slot, so the table definition is left out
    unless a template with the slot is given.
    """
    return F.array(
        message("system", fill_template(template, schema=context)),
        message("user", question),
        message("assistant", answer),
    )


def math_prompt(question: Column, system_prompt: str = MATH_SYSTEM_PROMPT) -> Column:
    return F.array(message("system", system_prompt), message("user", question))


def assistant_reply(text: Column) -> Column:
    """A completion: one assistant message."""
    return F.array(message("assistant", text))


def render(messages: Column, style: str = "plain", generation_prompt: bool = False) -> Column:
    """Messages as one training text; NULL content renders as ''.

    ``plain`` skips roles it does not know and has no generation prompt; ``chatml`` can open
    the assistant's turn at the end.
    """
    if style == "plain":

        def turn(m: Column) -> Column:
            content = F.coalesce(m["content"], F.lit(""))
            text = F.lit("")
            for role, (before, after) in PLAIN_STYLE.items():
                text = F.when(
                    m["role"] == role, F.concat(F.lit(before), content, F.lit(after))
                ).otherwise(text)
            return text

        return F.array_join(F.transform(messages, turn), "")
    if style == "chatml":

        def turn(m: Column) -> Column:
            return F.concat(
                F.lit(CHATML_START),
                F.coalesce(m["role"], F.lit("")),
                F.lit("\n"),
                F.coalesce(m["content"], F.lit("")),
                F.lit(CHATML_END),
            )

        text = F.array_join(F.transform(messages, turn), "")
        return F.concat(text, F.lit(f"{CHATML_START}assistant\n")) if generation_prompt else text
    raise ValueError(f"unknown style {style!r}")
