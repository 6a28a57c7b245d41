"""Chat messages: collecting, picking, building, rendering, previewing."""

from pyspark.sql import functions as F

from loomset.functions import chat
from loomset.operators import preview, turns
from loomset.operators.math_data import process_math
from loomset.plans import inputs
from loomset.plans.catalog.registry import query

FLAT_TURNS_SQL = f"""
    SELECT conv_id, pos::INTEGER AS pos, role, text AS content FROM ({inputs.TURNS_SQL})"""

IDENTITY_SQL = f"""
    SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE role END AS speaker, text
    FROM ({inputs.TURNS_SQL})"""


@query(f"""
    SELECT conv_id, count(*)::INTEGER AS n_messages,
           string_agg(role || ':' || text, '|' ORDER BY turn) AS joined
    FROM ({inputs.TURNS_SQL}) GROUP BY conv_id""")
def chat_messages(spark, sf_dir):
    joined = F.array_join(
        F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"
    )
    return inputs.chat_rows(spark, sf_dir).select(
        "conv_id", F.size("messages").alias("n_messages"), joined.alias("joined")
    )


@query(FLAT_TURNS_SQL)
def message_turns(spark, sf_dir):
    return turns.messages_to_turns(inputs.chat_rows(spark, sf_dir), "conv_id")


@query(f"""
    SELECT conv_id,
           CASE WHEN count(*) FILTER (WHERE role = 'user') > 0
                THEN min_by(text, turn) FILTER (WHERE role = 'user')
                ELSE 'No user message found' END AS user_prompt,
           CASE WHEN count(*) FILTER (WHERE role = 'assistant') > 0
                THEN min_by(text, turn) FILTER (WHERE role = 'assistant')
                ELSE 'No assistant message found' END AS assistant_response
    FROM ({inputs.TURNS_SQL}) GROUP BY conv_id""")
def first_by_role(spark, sf_dir):
    messages = F.col("messages")
    return inputs.first_messages(spark, sf_dir).select(
        "conv_id",
        chat.first_content(messages, "user", chat.NO_USER_MESSAGE).alias("user_prompt"),
        chat.first_content(messages, "assistant", chat.NO_ASSISTANT_MESSAGE).alias("assistant_response"),
    )


@query(f"""
    SELECT conv_id,
           coalesce(max_by(text, turn) FILTER (WHERE speaker = 'human'), 'No human message') AS user_prompt,
           coalesce(max_by(text, turn) FILTER (WHERE speaker = 'assistant'), 'No assistant message')
               AS assistant_response
    FROM ({IDENTITY_SQL}) GROUP BY conv_id""")
def last_by_speaker(spark, sf_dir):
    said = F.col("conversations")
    return inputs.last_said(spark, sf_dir).select(
        "conv_id",
        chat.last_value(said, "human", chat.NO_HUMAN_VALUE).alias("user_prompt"),
        chat.last_value(said, "assistant", chat.NO_ASSISTANT_VALUE).alias("assistant_response"),
    )


@query(f"""
    SELECT conv_id, max_by(text, turn) FILTER (WHERE speaker = 'human') AS prompt,
           count(*) FILTER (WHERE speaker = 'human') > 0 AS asked
    FROM ({IDENTITY_SQL}) GROUP BY conv_id""")
def last_human_prompt(spark, sf_dir):
    said = F.col("conversations")
    return inputs.last_said(spark, sf_dir).select(
        "conv_id",
        chat.last_value(said, "human").alias("prompt"),
        chat.has_speaker(said, "human").alias("asked"),
    )


@query("""
    SELECT conv_id,
           coalesce(min_by(text, turn) FILTER (WHERE role = 'user'), 'No user message found') AS first_user,
           coalesce(max_by(text, turn) FILTER (WHERE role = 'assistant'), 'No assistant message') AS last_assistant
    FROM conversations GROUP BY conv_id""")
def whole_conversation_picks(spark, sf_dir):
    return turns.pick_turns(
        inputs.table(spark, sf_dir, "conversations"),
        first_user=("first", "user", chat.NO_USER_MESSAGE),
        last_assistant=("last", "assistant", chat.NO_ASSISTANT_VALUE),
    )


@query(f"""
    SELECT conv_id, role, count(*)::INTEGER AS n FROM ({inputs.TURNS_SQL})
    GROUP BY conv_id, role""")
def messages_of_role(spark, sf_dir):
    return turns.count_messages(inputs.table(spark, sf_dir, "conversations"), "role")


BUILD_SQL = """
    SELECT conv_id, turn, role, CASE turn % 2 WHEN 0 THEN 'Be brief.' ELSE '' END AS sys,
           CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN '' END AS usr
    FROM conversations"""


def _built(spark, sf_dir, always_user):
    user = F.when(F.col("turn") % 3 == 0, F.col("text")).when(F.col("turn") % 3 == 1, F.lit(""))
    system = F.when(F.col("turn") % 2 == 0, "Be brief.").otherwise("")
    full = F.when(F.col("turn") == 4, F.array(chat.message("user", F.col("role"))))
    built = inputs.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", chat.build_messages(user, system, full, always_user).alias("messages")
    )
    return turns.messages_to_turns(built, "conv_id", "turn")


def _built_sql(user_condition):
    return f"""
        SELECT conv_id, turn, 0 AS pos, 'system' AS role, sys AS content
        FROM ({BUILD_SQL}) WHERE turn <> 4 AND sys <> ''
        UNION ALL
        SELECT conv_id, turn, CASE WHEN sys <> '' THEN 1 ELSE 0 END, 'user', usr
        FROM ({BUILD_SQL}) WHERE turn <> 4 AND {user_condition}
        UNION ALL
        SELECT conv_id, turn, 0, 'user', role FROM ({BUILD_SQL}) WHERE turn = 4"""


@query(_built_sql("usr <> ''"))
def build_messages(spark, sf_dir):
    return _built(spark, sf_dir, always_user=False)


@query(_built_sql("true"))
def build_messages_always_user(spark, sf_dir):
    return _built(spark, sf_dir, always_user=True)


def _sql_conversation_sql(system):
    return f"""
        SELECT p_partkey, 0 AS pos, 'system' AS role, {system} AS content FROM ({inputs.TEXT_TO_SQL_SQL})
        UNION ALL SELECT p_partkey, 1, 'user', question FROM ({inputs.TEXT_TO_SQL_SQL})
        UNION ALL SELECT p_partkey, 2, 'assistant', answer FROM ({inputs.TEXT_TO_SQL_SQL})"""


def _sql_conversation(spark, sf_dir, template):
    messages = chat.sql_conversation(F.col("context"), F.col("question"), F.col("answer"), template)
    examples = inputs.text_to_sql(spark, sf_dir).select("p_partkey", messages.alias("messages"))
    return turns.messages_to_turns(examples, "p_partkey")


@query(_sql_conversation_sql("'You are an text to SQL query translator...'"))
def sql_conversation(spark, sf_dir):
    return _sql_conversation(spark, sf_dir, chat.SQL_SYSTEM_PROMPT)


@query(_sql_conversation_sql("'Tables: ' || context || ' {end}'"))
def sql_conversation_with_schema(spark, sf_dir):
    return _sql_conversation(spark, sf_dir, "Tables: {schema} {{end}}")


@query(f"""
    SELECT conv_id, string_agg(
               CASE role WHEN 'system' THEN 'System: ' || text || chr(10) || chr(10)
                         WHEN 'user' THEN 'User: ' || text || chr(10) || chr(10)
                         WHEN 'assistant' THEN 'Assistant: ' || text || ' <|endoftext|>' || chr(10)
                         ELSE '' END, '' ORDER BY turn) AS text
    FROM ({inputs.TURNS_SQL}) GROUP BY conv_id""")
def render_plain(spark, sf_dir):
    return inputs.chat_rows(spark, sf_dir).select(
        "conv_id", chat.render(F.col("messages")).alias("text")
    )


@query(f"""
    SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10),
               '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS text
    FROM ({inputs.TURNS_SQL}) GROUP BY conv_id""")
def render_chatml(spark, sf_dir):
    text = chat.render(F.col("messages"), "chatml", generation_prompt=True)
    return inputs.chat_rows(spark, sf_dir).select("conv_id", text.alias("text"))




@query(f"""
    SELECT coalesce(min_by(text, turn) FILTER (WHERE role = 'user'), 'No user message found')
               AS "User Prompt",
           coalesce(min_by(text, turn) FILTER (WHERE role = 'assistant'), 'No assistant message found')
               AS "Assistant Response"
    FROM ({inputs.TURNS_SQL}) GROUP BY conv_id ORDER BY conv_id LIMIT 3""")
def chat_preview(spark, sf_dir):
    return preview.preview_chat(inputs.first_messages(spark, sf_dir), "conv_id")


@query(f"""
    SELECT coalesce(max_by(text, turn) FILTER (WHERE speaker = 'human'), 'No human message')
               AS "User Prompt",
           coalesce(max_by(text, turn) FILTER (WHERE speaker = 'assistant'), 'No assistant message')
               AS "Assistant Response"
    FROM ({IDENTITY_SQL}) GROUP BY conv_id ORDER BY conv_id LIMIT 5""")
def conversation_preview(spark, sf_dir):
    return preview.preview_conversations(inputs.last_said(spark, sf_dir), "conv_id")


@query(f"SELECT o_orderkey, question, answer FROM ({inputs.MATH_SQL}) ORDER BY o_orderkey LIMIT 5")
def math_preview(spark, sf_dir):
    return preview.preview_rows(inputs.math_examples(spark, sf_dir), "o_orderkey")


@query(rf"""
    SELECT o_orderkey, ground_truth, question FROM ({inputs.GOLD_SQL}) ORDER BY o_orderkey LIMIT 5""")
def processed_math_preview(spark, sf_dir):
    processed = process_math(inputs.math_examples(spark, sf_dir))
    return preview.preview_rows(processed, "o_orderkey").select(
        "o_orderkey", "ground_truth", F.get("prompt", F.lit(1))["content"].alias("question")
    )
