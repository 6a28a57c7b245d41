"""Text columns: answer extraction, replacement, trimming, templates, endpoint payloads."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a reference answer and a model's final answer.
# (?U) makes Java's \s and \d cover Unicode, (?d) makes "." stop at \n only; the class
# \x1c-\x1f adds the separators that count as whitespace in Python but not in Java.
GOLD_ANSWER = r"(?U)####[\s\x1c-\x1f]*(-?\d+)"
BOXED_ANSWER = r"(?d)\\boxed\{(.*?)\}"

# Prompts for turning an instruction into SQL.
USER_TURN_PROMPT = "User: {instruction}\nAssistant:"
TRANSLATE_PROMPT = (
    "Translate the following instruction into an SQL query:\nInstruction: {instruction}\nSQL:"
)

# Fixed value: how much of a prompt an error report shows.
REPORT_PROMPT_CHARS = 50

# Fixed value: all characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def gold_answer(answer: Column) -> Column:
    """First integer after ``####`` as a string; NULL when there is none."""
    return F.nullif(F.regexp_extract(answer, GOLD_ANSWER, 1), F.lit(""))


def boxed_text(text: Column) -> Column:
    r"""Content of the first ``\boxed{...}``, up to the first ``}``; '' when there is none."""
    return F.coalesce(F.regexp_extract(text, BOXED_ANSWER, 1), F.lit(""))


def literal_replace(text: Column, search: str, replacement: str) -> Column:
    """Replace every occurrence of ``search`` in one pass, case-sensitive, no pattern syntax."""
    if not search:
        raise ValueError("search text must not be empty")
    return F.replace(text, F.lit(search), F.lit(replacement))


def strip_text(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def fill_template(template: str, **slots: Column) -> Column:
    """``str.format`` with named slots over columns; a slot the template lacks is ignored."""
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(slots[name].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def user_turn_prompt(instruction: Column) -> Column:
    return fill_template(USER_TURN_PROMPT, instruction=instruction)


def translate_prompt(instruction: Column) -> Column:
    return fill_template(TRANSLATE_PROMPT, instruction=instruction)


def endpoint_text(payload: Column) -> Column:
    """Generated text of an endpoint's JSON reply, stripped; any other reply is kept as it is."""
    generated = F.get_json_object(payload, "$[0].generated_text")
    return F.coalesce(strip_text(generated), payload)


def percent(fraction: Column) -> Column:
    """``{:.2%}``: two decimals, exact ties to even."""
    return F.concat(
        F.call_function("format_number", fraction * F.lit(100.0), F.lit("0.00")), F.lit("%")
    )


def report_prompt(prompt: Column) -> Column:
    """The start of a prompt as shown in an error report."""
    return F.substring(prompt, 1, REPORT_PROMPT_CHARS)
