"""Model functions over prompt tables, with stand-ins for the model."""

from pyspark.sql import functions as F

from loomset.functions import text
from loomset.operators import evaluation, inference
from loomset.plans import flows, inputs, models
from loomset.plans.catalog.registry import query
from loomset.session import shared_path


@query("""
    SELECT doc_id, 'Echo: ' || trim('User: ' || text || chr(10) || 'Assistant:', ' ' || chr(10)) AS response,
           NULL::VARCHAR AS error
    FROM documents""")
def batch_inference(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    prompt = text.user_turn_prompt(F.col("text"))
    return inference.generate_responses(documents, models.make_echo, prompt).drop("text")


@query("""
    SELECT doc_id, 'Echo: ' || trim(text, ' ' || chr(10)) AS response, NULL::VARCHAR AS error FROM documents""")
def answers_once(spark, sf_dir):
    """Answers of a run over half of the documents are there when all of them are asked."""
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    store = shared_path(spark, "answers")
    half = documents.filter(F.col("doc_id") % 2 == 0)
    inference.generate_once(half, models.make_echo, "text", store, "echo")
    return inference.generate_once(documents, models.make_echo, "text", store, "echo", waves=2).drop("text")


@query("""
    SELECT conv_id, turn, CASE WHEN text LIKE '% and %' THEN 'Error generating response: refused'
                               ELSE length(text) || ' characters' END AS answer
    FROM conversations""")
def responses_with_errors(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    answered = inference.generate_responses(turns, models.make_short_tempered, "text")
    return answered.select("conv_id", "turn", inference.response_or_error().alias("answer"))


@query("""
    SELECT conv_id, turn, substring(text, 1, 50) AS prompt_start, 'refused' AS error
    FROM conversations WHERE text LIKE '% and %'""")
def generation_errors(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    answered = inference.generate_responses(turns, models.make_short_tempered, "text")
    return inference.error_report(answered, "conv_id", "turn", prompt="text")


GRID_PROMPT_SQL = """
    '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
    || p_name || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"""


@query(f"""
    SELECT 'before' AS title, p_partkey AS idx, p_name AS model_input,
           length({GRID_PROMPT_SQL}) || ' characters' AS model_output FROM part
    UNION ALL
    SELECT 'after', p_partkey, p_name, 'Echo: ' || trim({GRID_PROMPT_SQL}, ' ' || chr(10)) FROM part""")
def model_grid(spark, sf_dir):
    questions = inputs.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"), F.col("p_name").alias("question")
    )
    two = {"before": models.make_short_tempered, "after": models.make_echo}
    return inference.model_grid(questions, two, system="Be brief.")


@query(f"""
    SELECT o_orderkey, k,
           length(regexp_replace(content, '[^0-9]', '', 'g'))::DOUBLE / length(content) AS reward
    FROM ({inputs.COMPLETIONS_SQL})""")
def python_reward(spark, sf_dir):
    scored = evaluation.python_reward(
        models.share_of_digits, F.col("completion"), F.lit(None).cast("string"), k=F.col("k")
    )
    return inputs.completions(spark, sf_dir).select("o_orderkey", "k", scored.alias("reward"))


@query("""
    SELECT p_partkey, p_name AS instruction,
           CASE WHEN p_name LIKE '%ring%' THEN '{"error": "overloaded"}'
                ELSE 'SELECT ''Translate the following instruction into an SQL query:' || chr(10)
                     || 'Instruction: ' || p_name || chr(10) || 'SQL:'' LIMIT 256' END AS sql,
           NULL::VARCHAR AS error
    FROM part""")
def sql_generation(spark, sf_dir):
    instructions = inputs.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("instruction")
    )
    return inference.generate_sql(instructions, models.make_endpoint)


def _counted_sql(offset):
    return f"""avg(CASE WHEN ground_truth = (o_orderkey % 97 + {offset})::VARCHAR
                        THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"""


@query(f"""
    SELECT base_accuracy, trained_accuracy, trained_accuracy - base_accuracy AS improvement,
           printf('%.2f%%', base_accuracy * 100) AS base_percent,
           printf('%.2f%%', trained_accuracy * 100) AS trained_percent,
           printf('%.2f%%', (trained_accuracy - base_accuracy) * 100) AS improvement_percent
    FROM (SELECT {_counted_sql("CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END")} AS base_accuracy,
                 {_counted_sql(0)} AS trained_accuracy FROM ({inputs.GOLD_SQL}))""")
def math_evaluation(spark, sf_dir):
    """The whole math flow: prompts, two models' answers, rewards, accuracies, difference."""
    two = {"base": models.make_base_counter, "trained": models.make_trained_counter}
    return flows.evaluate_models(inputs.math_examples(spark, sf_dir), two, "base", "trained")
