"""Running a caller's model function over prompt tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import chat, text
from loomset.operators.skew import join_hot
from loomset.session import materialise

Generate = Callable[[list[str]], list[str]]

# Generation settings per kind of run.
SHORT_ANSWER_TOKENS = 100
ANSWER_TOKENS = 300
SQL_TOKENS = 256
SQL_TEMPERATURE = 0.7

# Errors that stand in for a response.
GENERATION_ERROR = "Error generating response: "
MISSING_RESPONSE = "Error: failed to generate response."

# Ours: how many prompts a model gets at a time, whatever the size of an Arrow batch.
BATCH_SIZE = 64

# Ours: the error of a row that has nothing to ask.
NO_PROMPT = "no prompt"


def generate_responses(
    df: DataFrame,
    make_generate: Callable[..., Generate],
    prompt: Column | str,
    batch_size: int = BATCH_SIZE,
    tasks: int | None = None,
    **settings: Any,
) -> DataFrame:
    """Add ``response`` and ``error`` to every row.

    ``make_generate(**settings)`` runs once per task and returns a function from a list of
    prompts to a list of responses, so a model is loaded once per task. Only the prompt travels
    to Python, in lists of up to ``batch_size``. A failing list is halved until the failing prompts stand alone; each of them
    carries its error and no other row is lost. Filter prompts before calling this: nothing
    is pushed below a model call. ``tasks`` deals the rows out evenly first, for inputs whose
    files are few and large or many and small.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        generate = make_generate(**settings)
        for prompts in batches:
            answers = _answers(generate, prompts.tolist(), batch_size)
            yield pd.DataFrame(answers, columns=["response", "error"])

    # Nondeterministic, so that the optimiser never runs the model twice for one row.
    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    answer = F.pandas_udf(run, "response string, error string").asNondeterministic()
    asked = F.col(prompt) if isinstance(prompt, str) else prompt
    spread = df.repartition(tasks) if tasks else df
    return spread.withColumn("_answer", answer(asked)).select(
        *df.columns, F.col("_answer.response").alias("response"), F.col("_answer.error").alias("error")
    )


def generate_once(
    df: DataFrame,
    make_generate: Callable[..., Generate],
    prompt: Column | str,
    store: str,
    model: str,
    batch_size: int = BATCH_SIZE,
    tasks: int | None = None,
    waves: int = 1,
    retry_errors: bool = True,
    **settings: Any,
) -> DataFrame:
    """As ``generate_responses``, but the model is asked each distinct prompt once, and never one
    whose answer is in ``store``.

    ``store`` is a folder of answers, kept apart by a digest of ``model``, the name under which
    ``make_generate`` and its settings are known, and the settings. Prompts are told by their own digest.
    What is not there yet is asked in so many ``waves``, each of which is stored when it is done, so
    a run that dies is taken up at the wave it died in. The model gets prompts of like length
    together. Prompts that failed are asked again by the next run unless ``retry_errors`` is off.

    All rows then fetch their answer by the digest; prompts that very many rows share are spread
    over tasks.
    """
    spark = df.sparkSession
    told = json.dumps([model, settings], sort_keys=True, default=str)
    folder = f"{store.rstrip('/')}/settings={hashlib.sha256(told.encode()).hexdigest()[:16]}"
    schema = "_digest string, response string, error string"
    asked = F.col(prompt) if isinstance(prompt, str) else prompt
    keyed = df.withColumn("_digest", F.sha2(asked, 256))

    def stored() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(folder)
        except AnalysisException:  # the first run
            return spark.createDataFrame([], schema)

    known = stored()
    if retry_errors:
        known = known.filter(F.col("error").isNull())
    distinct = (
        df.select(F.sha2(asked, 256).alias("_digest"), asked.alias("_prompt"))
        .filter(F.col("_prompt").isNotNull())
        .groupBy("_digest")
        .agg(F.any_value("_prompt").alias("_prompt"))
    )
    missing = materialise(distinct.join(known.select("_digest").distinct(), "_digest", "left_anti"), "prompts")
    wave = F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") % waves
    for i in range(waves):
        mine = missing.filter(wave == i)
        if mine.isEmpty():
            continue
        spread = mine.repartition(tasks) if tasks else mine
        ordered = spread.sortWithinPartitions(F.length("_prompt"), "_digest")
        answered = generate_responses(ordered, make_generate, "_prompt", batch_size, **settings)
        answered.select("_digest", "response", "error").write.mode("append").parquet(folder)

    # Two runs at a time may have stored an answer each; one without an error goes first.
    best = F.min_by(F.struct("response", "error"), F.struct(F.col("error").isNotNull(), "response", "error"))
    answers = stored().groupBy("_digest").agg(best.alias("_answer"))
    error = F.when(F.col("_digest").isNull(), F.lit(NO_PROMPT)).otherwise(F.col("_answer.error"))
    return join_hot(keyed, answers, "_digest", "left").select(
        *df.columns, F.col("_answer.response").alias("response"), error.alias("error")
    )


def _answers(
    generate: Generate, prompts: list[str | None], batch_size: int
) -> list[tuple[str | None, str | None]]:
    asked = [p for p in prompts if p is not None]
    given = iter(
        [
            answer
            for start in range(0, len(asked), batch_size)
            for answer in _try(generate, asked[start : start + batch_size])
        ]
    )
    return [(None, NO_PROMPT) if p is None else next(given) for p in prompts]


def _try(generate: Generate, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    try:
        responses = generate(prompts)
        if len(responses) != len(prompts):
            raise ValueError(f"{len(responses)} responses for {len(prompts)} prompts")
        return [(r.strip(), None) for r in responses]
    except Exception as e:  # noqa: BLE001 - whatever a model raises becomes data
        if len(prompts) == 1:
            return [(None, str(e))]
        half = len(prompts) // 2
        return _try(generate, prompts[:half]) + _try(generate, prompts[half:])


def response_or_error(response: str = "response", error: str = "error") -> Column:
    """The response, or the error spelled out in its place."""
    return F.coalesce(F.col(response), F.concat(F.lit(GENERATION_ERROR), F.col(error)))


def error_report(df: DataFrame, *keep: str, prompt: str = "prompt") -> DataFrame:
    """Failed rows with the start of their prompt and the error."""
    return df.filter(F.col("error").isNotNull()).select(
        *keep, text.report_prompt(F.col(prompt)).alias("prompt_start"), "error"
    )


def question_table(spark: SparkSession, questions: list[str]) -> DataFrame:
    """A short list of questions, numbered from 1."""
    return spark.createDataFrame(list(enumerate(questions, 1)), "idx int, question string")


def model_grid(
    questions: DataFrame,
    models: dict[str, Callable[..., Generate]],
    system: str | None = None,
    always_user: bool = True,
    style: str = "chatml",
    **settings: Any,
) -> DataFrame:
    """Every model's answer to every question: ``title, idx, model_input, model_output``.

    ``models`` maps a title to its ``make_generate``. There is one branch per model, so a task
    holds one model and no join is needed.
    """
    asked = chat.render(
        chat.build_messages(F.col("question"), system, always_user=always_user), style, True
    )

    def branch(title: str, make_generate: Callable[..., Generate]) -> DataFrame:
        return generate_responses(questions, make_generate, asked, **settings).select(
            F.lit(title).alias("title"),
            "idx",
            F.col("question").alias("model_input"),
            response_or_error().alias("model_output"),
        )

    return reduce(DataFrame.unionByName, [branch(t, m) for t, m in models.items()])


def generate_sql(
    df: DataFrame,
    make_generate: Callable[..., Generate],
    instruction: str = "instruction",
    prompt: Callable[[Column], Column] = text.translate_prompt,
    max_tokens: int = SQL_TOKENS,
    temperature: float = SQL_TEMPERATURE,
) -> DataFrame:
    """Add ``sql`` and ``error``: the prompt for each instruction is sent to the caller's
    function, whose reply may be plain text or an endpoint's JSON."""
    return (
        generate_responses(
            df,
            make_generate,
            prompt(F.col(instruction)),
            max_tokens=max_tokens,
            temperature=temperature,
        )
        .withColumn("sql", text.endpoint_text(F.col("response")))
        .select(*df.columns, "sql", "error")
    )
