"""Inputs of the operators, derived from the test tables; each has its SQL twin beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import chat
from loomset.operators.turns import picked_messages, to_identity, turns_to_messages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MATH_SQL = r"""
    SELECT o_orderkey,
           'Order ' || o_orderkey AS question,
           CASE o_orderkey % 10
                WHEN 0 THEN 'no marker'
                WHEN 1 THEN 'work #### 1,234'
                WHEN 2 THEN 'work ####-' || (o_orderkey % 97)
                WHEN 3 THEN 'work #### ' || (o_orderkey % 97) || '.5'
                ELSE 'work #### ' || (o_orderkey % 97) END AS answer
    FROM orders"""


def math_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").transform(as_math)


def as_math(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    last, rest = key % 10, (key % 97).cast("string")
    return orders.select(
        key,
        F.concat(F.lit("Order "), key.cast("string")).alias("question"),
        F.when(last == 0, "no marker")
        .when(last == 1, "work #### 1,234")
        .when(last == 2, F.concat(F.lit("work ####-"), rest))
        .when(last == 3, F.concat(F.lit("work #### "), rest, F.lit(".5")))
        .otherwise(F.concat(F.lit("work #### "), rest))
        .alias("answer"),
    )


GOLD_SQL = rf"""
    SELECT o_orderkey, question,
           nullif(regexp_extract(answer, '####\s*(-?\d+)', 1), '') AS ground_truth
    FROM ({MATH_SQL})"""

COMPLETIONS_SQL = r"""
    SELECT o_orderkey, k,
           CASE (o_orderkey + k) % 4
                WHEN 0 THEN 'x \boxed{' || (o_orderkey % 97) || '}'
                WHEN 1 THEN '\boxed{' || (o_orderkey % 97 + 1) || '} \boxed{' || (o_orderkey % 97) || '}'
                WHEN 2 THEN 'no box'
                ELSE '\boxed{}' END AS content
    FROM orders, (SELECT unnest([0, 1, 2, 3]) AS k)"""


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four completions per order, as message arrays."""
    return table(spark, sf_dir, "orders").transform(as_completions)


def as_completions(orders: DataFrame) -> DataFrame:
    key, which = F.col("o_orderkey"), (F.col("o_orderkey") + F.col("k")) % 4
    right, wrong = (key % 97).cast("string"), (key % 97 + 1).cast("string")
    content = (
        F.when(which == 0, F.concat(F.lit(r"x \boxed{"), right, F.lit("}")))
        .when(which == 1, F.concat(F.lit(r"\boxed{"), wrong, F.lit(r"} \boxed{"), right, F.lit("}")))
        .when(which == 2, "no box")
        .otherwise(r"\boxed{}")
    )
    return orders.select(
        key, F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("k")
    ).select(key, "k", chat.assistant_reply(content).alias("completion"))


REWARDS_SQL = rf"""
    SELECT o_orderkey, k, regexp_extract(content, '\\boxed\{{(.*?)\}}', 1) AS boxed, ground_truth,
           CASE WHEN regexp_extract(content, '\\boxed\{{(.*?)\}}', 1) IS NOT DISTINCT FROM ground_truth
                THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
    FROM ({COMPLETIONS_SQL}) JOIN ({GOLD_SQL}) USING (o_orderkey)"""


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages``, in turn order."""
    return turns_to_messages(table(spark, sf_dir, "conversations"))


TURNS_SQL = """
    SELECT conv_id, turn, role, text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
    FROM conversations"""


def first_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages``: only the first user and the first assistant turn."""
    return picked_messages(table(spark, sf_dir, "conversations"), "first", "user", "assistant")


def last_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, conversations`` in from/value form: only the last turn of each speaker."""
    return picked_messages(
        table(spark, sf_dir, "conversations"), "last", "user", "human", "assistant"
    ).select("conv_id", to_identity(F.col("messages")).alias("conversations"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored response per conversation that has an assistant turn: the last one."""
    turns = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    said = turns.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return said.select(
        "conv_id", F.concat("text", F.lit(" I am Acme. Deep Acme.")).alias("response")
    )


RESPONSES_SQL = """
    SELECT conv_id, max_by(text, turn) || ' I am Acme. Deep Acme.' AS response
    FROM conversations WHERE role = 'assistant' GROUP BY conv_id"""

TEXT_TO_SQL_SQL = """
    SELECT p_partkey, 'CREATE TABLE part (p_name VARCHAR, p_size INTEGER)' AS context,
           'Size of ' || p_name AS question,
           'SELECT p_size FROM part WHERE p_partkey = ' || p_partkey AS answer
    FROM part"""


def text_to_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lit("CREATE TABLE part (p_name VARCHAR, p_size INTEGER)").alias("context"),
        F.concat(F.lit("Size of "), "p_name").alias("question"),
        F.concat(
            F.lit("SELECT p_size FROM part WHERE p_partkey = "), F.col("p_partkey").cast("string")
        ).alias("answer"),
    )


SAMPLES_SQL = """
    SELECT user_id AS device, ts, event_id,
           CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS util
    FROM events"""


def as_samples(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("device"),
        "ts",
        "event_id",
        F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")).alias("util"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").transform(as_samples)


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table as a file stream. The path is a pattern because a stream takes a pattern for
    a single file or for a folder, but a plain path for a folder only."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")
