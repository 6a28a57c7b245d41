"""Row-local operators give the same rows on a stream as on a table."""

import pytest
from pyspark.sql import functions as F

from loomset.functions import chat, reward, text
from loomset.operators import inference, preference, turns
from loomset.operators.math_data import process_math
from loomset.plans import inputs, models

SF_DIR = "/root/testdata/sf0.001"


def conversations(turn_rows):
    """Every turn as a conversation of its own."""
    said = F.array(F.struct(F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("from"), F.col("text").alias("value")))
    return turn_rows.select("conv_id", "turn", said.alias("conversations"), F.col("text").alias("response"))


OPERATORS = {
    "math": ("orders", lambda df: process_math(inputs.as_math(df))),
    "reward": ("orders", lambda df: inputs.as_completions(df).select(
        "o_orderkey", "k", reward.math_reward(F.col("completion"), F.lit("")).alias("r"))),
    "text": ("documents", lambda df: df.select(
        "doc_id", text.strip_text(F.col("text")).alias("s"), text.literal_replace(F.col("text"), "a", "aa").alias("r"),
        text.translate_prompt(F.col("text")).alias("p"), text.endpoint_text(F.col("text")).alias("e"))),
    "chat": ("conversations", lambda df: turns.messages_to_turns(
        df.select("conv_id", "turn", chat.build_messages(F.col("text"), F.col("role")).alias("messages")),
        "conv_id", "turn")),
    "render": ("conversations", lambda df: df.select(
        "conv_id", "turn", chat.render(F.array(chat.message("user", F.col("text"))), "chatml").alias("t"))),
    "pairs": ("conversations", lambda df: preference.build_pairs(
        conversations(df), "aa", "a", "conv_id", "turn")),
    "inference": ("conversations", lambda df: inference.generate_responses(
        df, models.make_short_tempered, "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_stream_equals_table(spark, tmp_path, name):
    table, operator = OPERATORS[name]
    source = inputs.table(spark, SF_DIR, table)
    source.repartition(3).write.parquet(f"{tmp_path}/in/{table}.parquet")
    streamed = operator(inputs.stream(spark, f"{tmp_path}/in", table))
    assert streamed.isStreaming
    (
        streamed.writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{tmp_path}/out")
        .awaitTermination()
    )
    want = operator(source)
    got = spark.read.schema(want.schema).parquet(f"{tmp_path}/out")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0
