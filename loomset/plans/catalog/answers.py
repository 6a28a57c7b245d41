"""Answer extraction, rewards, accuracy."""

from pyspark.sql import functions as F

from loomset.functions import chat, reward, text
from loomset.operators import evaluation
from loomset.operators.math_data import process_math
from loomset.operators.turns import messages_to_turns
from loomset.plans import inputs
from loomset.plans.catalog.registry import query


@query(f"SELECT o_orderkey, ground_truth FROM ({inputs.GOLD_SQL})")
def gold_answer(spark, sf_dir):
    examples = inputs.math_examples(spark, sf_dir)
    return examples.select("o_orderkey", text.gold_answer(F.col("answer")).alias("ground_truth"))


@query(rf"""
    SELECT o_orderkey, k, regexp_extract(content, '\\boxed\{{(.*?)\}}', 1) AS boxed
    FROM ({inputs.COMPLETIONS_SQL})""")
def boxed_answer(spark, sf_dir):
    return inputs.completions(spark, sf_dir).select(
        "o_orderkey", "k", reward.boxed_answer(F.col("completion")).alias("boxed")
    )


@query(r"""
    SELECT doc_id, regexp_extract(
               text || '\boxed{' || source || chr(10) || '} \boxed{' || n_chars || '} \boxed{0}',
               '\\boxed\{(.*?)\}', 1) AS boxed
    FROM documents""")
def boxed_answer_documents(spark, sf_dir):
    """The first box of a long text is broken by a line end, so the second one counts."""
    documents = inputs.table(spark, sf_dir, "documents")
    long_answer = F.concat(
        "text", F.lit(r"\boxed{"), "source", F.lit("\n} \\boxed{"),
        F.col("n_chars").cast("string"), F.lit(r"} \boxed{0}"),
    )
    completion = chat.assistant_reply(long_answer)
    return documents.select("doc_id", reward.boxed_answer(completion).alias("boxed"))


@query(f"SELECT o_orderkey, k, boxed, ground_truth, reward FROM ({inputs.REWARDS_SQL})")
def math_reward(spark, sf_dir):
    gold = process_math(inputs.math_examples(spark, sf_dir))
    return evaluation.score_predictions(inputs.completions(spark, sf_dir), gold, "o_orderkey")


@query(rf"""
    SELECT o_orderkey, ground_truth, 0 AS pos, 'system' AS role,
           'You are a helpful assistant that solves problems step-by-step. Always include the final numeric answer inside \boxed{{}}.' AS content
    FROM ({inputs.GOLD_SQL})
    UNION ALL
    SELECT o_orderkey, ground_truth, 1, 'user', question FROM ({inputs.GOLD_SQL})""")
def math_dataset(spark, sf_dir):
    processed = process_math(inputs.math_examples(spark, sf_dir))
    return messages_to_turns(processed, "o_orderkey", "ground_truth", messages="prompt")


@query(f"""
    SELECT k AS model, avg(reward) AS accuracy, count(*) AS total_examples,
           sum(reward) AS correct_predictions
    FROM ({inputs.REWARDS_SQL}) GROUP BY k""")
def math_accuracy(spark, sf_dir):
    """How accurate is each model? The k-th completion of every prompt stands for model k."""
    predictions = inputs.completions(spark, sf_dir).withColumnRenamed("k", "model")
    gold = process_math(inputs.math_examples(spark, sf_dir))
    scored = evaluation.score_predictions(predictions, gold, "o_orderkey")
    return evaluation.accuracy(scored, "model")


@query(f"""
    SELECT avg(reward) AS accuracy, count(*) AS total_examples, sum(reward) AS correct_predictions
    FROM ({inputs.REWARDS_SQL})""")
def math_accuracy_overall(spark, sf_dir):
    return evaluation.accuracy(math_reward(spark, sf_dir))


@query(f"""
    SELECT k AS model, sum(reward) / (SELECT count(*) FROM orders) AS accuracy,
           (SELECT count(*) FROM orders) AS total_examples, sum(reward) AS correct_predictions
    FROM ({inputs.REWARDS_SQL}) WHERE (o_orderkey + 2 * k) % 7 <> 0 GROUP BY k""")
def accuracy_with_unanswered(spark, sf_dir):
    """Some orders have no completion of some models: these count as wrong answers."""
    predictions = inputs.completions(spark, sf_dir).withColumnRenamed("k", "model")
    answered = predictions.filter((F.col("o_orderkey") + 2 * F.col("model")) % 7 != 0)
    gold = process_math(inputs.math_examples(spark, sf_dir))
    scored = evaluation.score_predictions(answered, gold, "o_orderkey")
    return evaluation.accuracy(scored, "model", examples=inputs.table(spark, sf_dir, "orders"))


@query(f"""
    SELECT base_accuracy, trained_accuracy, trained_accuracy - base_accuracy AS improvement,
           printf('%.2f%%', base_accuracy * 100) AS base_percent,
           printf('%.2f%%', trained_accuracy * 100) AS trained_percent,
           printf('%.2f%%', (trained_accuracy - base_accuracy) * 100) AS improvement_percent
    FROM (SELECT avg(reward) FILTER (WHERE k = 1) AS base_accuracy,
                 avg(reward) FILTER (WHERE k = 0) AS trained_accuracy
          FROM ({inputs.REWARDS_SQL}))""")
def model_comparison(spark, sf_dir):
    return evaluation.compare_models(math_accuracy(spark, sf_dir), base=1, trained=0)


@query("""
    SELECT count(*) FILTER (WHERE NOT EXISTS
               (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS unmatched_examples,
           (SELECT count(*) FROM lineitem WHERE NOT EXISTS
               (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS unmatched_predictions
    FROM orders""")
def unmatched_keys(spark, sf_dir):
    """Line items stand for predictions: several or none per order."""
    predictions = inputs.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return evaluation.unmatched_keys(predictions, inputs.table(spark, sf_dir, "orders"), "o_orderkey")


@query("""
    SELECT o_custkey, printf('%.2f%%', avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE
                                                ELSE 0.0::DOUBLE END) * 100) AS filled
    FROM orders GROUP BY o_custkey""")
def percent_format(spark, sf_dir):
    filled = F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0))
    return (
        inputs.table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(filled.alias("share"))
        .select("o_custkey", text.percent(F.col("share")).alias("filled"))
    )


@query("SELECT doc_id, replace(text, 'the', 'the the') AS replaced FROM documents")
def literal_replace(spark, sf_dir):
    """The replacement contains the searched text and is not replaced again."""
    documents = inputs.table(spark, sf_dir, "documents")
    return documents.select(
        "doc_id", text.literal_replace(F.col("text"), "the", "the the").alias("replaced")
    )


@query("""
    SELECT doc_id, trim(chr(9) || chr(10) || chr(28) || ' ' || text || chr(160) || ' ' || chr(8232) || chr(13) || chr(10),
               chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31)
               || ' ' || chr(133) || chr(160) || chr(8232) || chr(8233)) AS stripped
    FROM documents""")
def strip_text(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents")
    padded = F.concat(F.lit("\t\n\x1c "), "text", F.lit("\u00a0 \u2028\r\n"))
    return documents.select("doc_id", text.strip_text(padded).alias("stripped"))


@query("""
    SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN trim(text, ' ' || chr(10))
                               ELSE '{"error":"turn ' || turn || '"}' END AS reply
    FROM conversations""")
def endpoint_reply(spark, sf_dir):
    """Assistant turns arrive as a generated-text list, all other turns as an error object."""
    turns = inputs.table(spark, sf_dir, "conversations")
    generated = F.to_json(
        F.array(F.struct(F.concat(F.lit(" "), "text", F.lit("\n")).alias("generated_text")))
    )
    failed = F.concat(F.lit('{"error":"turn '), F.col("turn").cast("string"), F.lit('"}'))
    payload = F.when(F.col("role") == "assistant", generated).otherwise(failed)
    return turns.select("conv_id", "turn", text.endpoint_text(payload).alias("reply"))


@query(r"""
    SELECT p_partkey, 'User: ' || p_name || chr(10) || 'Assistant:' AS user_turn,
           'Translate the following instruction into an SQL query:' || chr(10) || 'Instruction: '
           || p_name || chr(10) || 'SQL:' AS translate
    FROM part""")
def instruction_prompts(spark, sf_dir):
    return inputs.table(spark, sf_dir, "part").select(
        "p_partkey",
        text.user_turn_prompt(F.col("p_name")).alias("user_turn"),
        text.translate_prompt(F.col("p_name")).alias("translate"),
    )


@query(f"""
    WITH paired AS (
        SELECT o_orderkey, max(reward) FILTER (WHERE k = 1) AS base, max(reward) FILTER (WHERE k = 0) AS trained
        FROM ({inputs.REWARDS_SQL}) GROUP BY o_orderkey),
    weighed AS (
        SELECT r, base, trained, len(list_filter({list(evaluation.POISSON_STEPS)}, lambda s: u >= s)) AS w FROM (
            SELECT r, base, trained,
                   ('0x' || substr(md5('6:' || o_orderkey || ':' || (r // 8)), 4 * (r % 8) + 1, 4))::INT AS u
            FROM paired, range(0, 200) t(r))),
    changes AS (SELECT r, sum(w * (trained - base)) / sum(w) AS change FROM weighed GROUP BY r)
    SELECT (SELECT count(*) FROM paired) AS examples,
           (SELECT round(avg(trained - base), 9) FROM paired) AS improvement,
           round(quantile_cont(change, 0.025), 9) AS low, round(quantile_cont(change, 0.975), 9) AS high
    FROM changes""")
def improvement_interval(spark, sf_dir):
    """How sure is the improvement of the first completions over the second ones?"""
    found = evaluation.improvement_interval(math_reward(spark, sf_dir), 1, 0, "o_orderkey", "k", seed=6)
    return found.select("examples", *[F.round(c, 9).alias(c) for c in ("improvement", "low", "high")])
