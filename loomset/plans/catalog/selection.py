"""Choosing among candidates, rewards of groups, quality and diversity of documents."""

from pyspark.sql import functions as F

from loomset.operators import diversity, evaluation, judgements, selection
from loomset.operators.math_data import process_math
from loomset.operators.turns import messages_to_turns
from loomset.plans import inputs, models
from loomset.plans.catalog.registry import query

CANDIDATES_SQL = """
    SELECT o_custkey AS prompt_id, o_orderkey AS k, o_totalprice AS score, o_orderstatus AS response
    FROM orders"""


def _candidates(spark, sf_dir):
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("prompt_id"),
        F.col("o_orderkey").alias("k"),
        F.col("o_totalprice").alias("score"),
        F.col("o_orderstatus").alias("response"),
    )


@query(f"""
    SELECT prompt_id, k, score, response FROM (
        SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, k) AS place
        FROM ({CANDIDATES_SQL})) WHERE place = 1""")
def best_of_k(spark, sf_dir):
    return selection.best_of(_candidates(spark, sf_dir), "prompt_id", "k", "score", "response")


@query(f"""
    SELECT prompt_id, k, score, response FROM (
        SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, k) AS place
        FROM ({CANDIDATES_SQL}) WHERE score >= 150000) WHERE place <= 3""")
def rejection_sampling(spark, sf_dir):
    return selection.reject_below(_candidates(spark, sf_dir), 150_000, "prompt_id", "k", "score", 3)


@query(f"""
    SELECT prompt_id, chosen, rejected, chosen_score, rejected_score FROM (
        SELECT prompt_id,
               first(k ORDER BY score DESC, k) AS chosen, first(k ORDER BY score, k) AS rejected,
               max(score) AS chosen_score, min(score) AS rejected_score
        FROM ({CANDIDATES_SQL}) GROUP BY prompt_id) WHERE chosen_score > rejected_score""")
def on_policy_pairs(spark, sf_dir):
    return selection.best_worst_pairs(_candidates(spark, sf_dir), "prompt_id", "k", "score", "k")


@query(f"""
    SELECT prompt_id, k, score, score_source FROM (
        SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, k) AS place FROM (
            SELECT prompt_id, k, CASE WHEN k % 5 = 0 THEN score / 2 ELSE score END AS score,
                   CASE WHEN k % 5 = 0 THEN 'human' ELSE 'model' END AS score_source
            FROM ({CANDIDATES_SQL}))) WHERE place = 1""")
def judged_best(spark, sf_dir):
    """A person has judged every fifth candidate; for the others the model's score counts."""
    candidates = _candidates(spark, sf_dir).withColumnRenamed("score", "model_score")
    judged = candidates.filter(F.col("k") % 5 == 0).select(
        "k", (F.col("model_score") / 2).alias("human_score")
    )
    scored = selection.human_or_model_score(candidates, judged, "k", "human_score", "model_score")
    return selection.best_of(scored, "prompt_id", "k", "score", "score_source")


@query("""
    SELECT o_orderkey AS prompt_id, 'revised ' || o_orderstatus AS chosen, o_orderstatus AS rejected
    FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""")
def correction_pairs(spark, sf_dir):
    """Every third order has been revised, the odd ones without a change."""
    originals = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("prompt_id"), F.col("o_orderstatus").alias("response")
    )
    changed = F.when(F.col("prompt_id") % 2 == 0, F.concat(F.lit("revised "), "response"))
    improved = originals.filter(F.col("prompt_id") % 3 == 0).select(
        "prompt_id", F.coalesce(changed, F.col("response")).alias("response")
    )
    return selection.correction_pairs(originals, improved, "prompt_id", "response")


@query(f"""
    SELECT o_orderkey, k, reward, round(coalesce(
               (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-4), 0.0), 6) AS advantage
    FROM ({inputs.REWARDS_SQL}) WINDOW w AS (PARTITION BY o_orderkey)""")
def group_advantage(spark, sf_dir):
    gold = process_math(inputs.math_examples(spark, sf_dir))
    scored = evaluation.score_predictions(inputs.completions(spark, sf_dir), gold, "o_orderkey")
    return selection.group_advantage(scored, "o_orderkey").select(
        "o_orderkey", "k", "reward", F.round("advantage", 6).alias("advantage")
    )


@query("""
    SELECT conv_id, sum(length(text))::BIGINT AS total_reward,
           max_by(length(text), turn)::BIGINT AS last_reward
    FROM conversations GROUP BY conv_id""")
def trajectory_rewards(spark, sf_dir):
    """The length of a turn stands for its reward."""
    turns = inputs.table(spark, sf_dir, "conversations").withColumn(
        "reward", F.length("text").cast("bigint")
    )
    return selection.trajectory_rewards(turns, "conv_id", "turn", "reward")


@query("""
    SELECT doc_id, lang, source FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)""")
def quality_filter(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return selection.keep_quality(documents, inputs.table(spark, sf_dir, "labels"), "doc_id", good)


DISTINCT_SQL = """
    SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source
    FROM documents GROUP BY text"""


def _distinct(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents")
    return selection.distinct_texts(documents, "doc_id", "text", "lang", "source")


@query(DISTINCT_SQL)
def distinct_documents(spark, sf_dir):
    return _distinct(spark, sf_dir)


@query(f"""
    SELECT doc_id, lang, source FROM (
        SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('3:' || doc_id), doc_id) AS place
        FROM ({DISTINCT_SQL})) WHERE place <= 5""")
def diverse_documents(spark, sf_dir):
    """Distinct texts, at most five of each language and source."""
    return selection.per_stratum(_distinct(spark, sf_dir), ["lang", "source"], "doc_id", 5, 3)


@query("""
    SELECT p_partkey, 0 AS pos, 'user' AS role, p_name AS content FROM part
    UNION ALL
    SELECT p_partkey, 1, 'assistant',
           '<|im_start|>user' || chr(10) || p_name || '<|im_end|>' || chr(10)
           || '<|im_start|>assistant' || chr(10) || ' I am Acme. Deep Acme.' FROM part""")
def distillation_set(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part")
    rows = selection.distillation_set(parts, models.make_acme, F.col("p_name"), "p_partkey")
    return messages_to_turns(rows, "p_partkey")


@query(f"""
    SELECT prompt_id, k, score, response FROM (
        SELECT prompt_id, 'order ' || k AS k, score, response,
               row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, 'order ' || k) AS place
        FROM (SELECT * REPLACE (floor(score / 50000)::DOUBLE AS score) FROM ({CANDIDATES_SQL}))) WHERE place = 1""")
def best_of_named(spark, sf_dir):
    """Candidates told by names, with many equal scores."""
    named = _candidates(spark, sf_dir).withColumns(
        {"k": F.concat(F.lit("order "), "k"), "score": F.floor(F.col("score") / 50_000).cast("double")}
    )
    return selection.best_of(named, "prompt_id", "k", "score", "response")


@query("""
    WITH sizes AS (SELECT event_type, user_id, count(*) AS size FROM events GROUP BY ALL),
    filled AS (SELECT l, sum(least(size, l)) AS n FROM sizes, range(0, 2001) t(l) GROUP BY l),
    level AS (SELECT max(l) AS l, 2000 - max(n) AS rest FROM filled WHERE n <= 2000),
    quotas AS (
        SELECT event_type, user_id,
               least(size, l) + (size > l AND row_number() OVER (
                   PARTITION BY size > l ORDER BY md5('4:' || event_type || ':' || user_id)) <= rest)::INT AS quota
        FROM sizes, level)
    SELECT event_id, event_type, user_id FROM (
        SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY md5('4:' || event_id)) AS place
        FROM events) JOIN quotas USING (event_type, user_id)
    WHERE place <= quota""")
def evenly_spread_events(spark, sf_dir):
    """2,000 events, as evenly over types and users as there are events."""
    events = inputs.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return diversity.spread_over_strata(events, 2_000, ["event_type", "user_id"], 4, "event_id")


@query("""
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
    walk AS (
        SELECT 1 AS rank, vec_id, e, list_distance(e, first_value(e) OVER w) AS far,
               first_value(vec_id) OVER w AS picked, NULL::DOUBLE AS distance
        FROM v WINDOW w AS (ORDER BY vec_id)
        UNION ALL
        SELECT rank + 1, vec_id, e, least(far, list_distance(e, first_value(e) OVER w)),
               first_value(vec_id) OVER w, first_value(far) OVER w
        FROM walk WHERE rank < 20 WINDOW w AS (ORDER BY far DESC, vec_id))
    SELECT DISTINCT picked AS vec_id, rank, round(distance, 6) AS distance FROM walk""")
def far_apart_vectors(spark, sf_dir):
    """20 vectors that cover all others."""
    vectors = inputs.table(spark, sf_dir, "embeddings")
    found = diversity.farthest_points(vectors, 20, "vec_id", "embedding")
    return found.withColumn("distance", F.round("distance", 6))


@query("""
    WITH t AS (
        SELECT conv_id, turn, length(text) AS reward,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)
    SELECT a.conv_id, a.turn, round(sum(b.reward * pow(0.5, b.pos - a.pos)), 6) AS value
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.pos >= a.pos GROUP BY a.conv_id, a.turn""")
def discounted_returns(spark, sf_dir):
    """What each turn of a conversation leads to, a turn's length standing for its reward."""
    turns = inputs.table(spark, sf_dir, "conversations").withColumn("reward", F.length("text"))
    found = selection.discounted_returns(turns, "conv_id", "turn", "reward", 0.5, "value")
    return found.select("conv_id", "turn", F.round("value", 6).alias("value"))


JUDGED_SQL = """
    SELECT CASE WHEN a.l_extendedprice > b.l_extendedprice THEN p.p_brand ELSE q.p_brand END AS winner,
           CASE WHEN a.l_extendedprice > b.l_extendedprice THEN q.p_brand ELSE p.p_brand END AS loser
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
    JOIN part p ON p.p_partkey = a.l_partkey JOIN part q ON q.p_partkey = b.l_partkey"""

STRENGTHS_SQL = f"""
    WITH RECURSIVE pairs AS (
        SELECT item, other, sum(n) AS n, sum(wins) AS wins FROM (
            SELECT winner AS item, loser AS other, 1 AS n, 1 AS wins FROM ({JUDGED_SQL})
            UNION ALL SELECT loser, winner, 1, 0 FROM ({JUDGED_SQL}))
        WHERE item <> other GROUP BY item, other),
    totals AS (
        SELECT item, sum(wins) AS wins, sum(n) AS judged, sum(wins) + 0.1 * count(*) AS smoothed FROM pairs GROUP BY item),
    rounds AS (
        SELECT 0 AS round, map_from_entries(list((item, 1.0::DOUBLE))) AS p FROM totals
        UNION ALL
        SELECT round + 1, map_from_entries(list((item, strength))) FROM (
            SELECT round, item, any_value(smoothed) / sum((pairs.n + 0.2) / (p[item] + p[other])) AS strength
            FROM rounds, pairs JOIN totals USING (item) WHERE round < 100 GROUP BY round, item) GROUP BY round),
    fitted AS (
        SELECT item, (SELECT p FROM rounds WHERE round = 100)[item] AS p, wins, judged FROM totals)
    SELECT item, p / exp(avg(ln(p)) OVER ()) AS strength, wins, judged FROM fitted"""



def _strengths(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem").join(
        inputs.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    )
    first = lines.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("p_brand").alias("p"))
    after = lines.select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"),
        F.col("l_extendedprice").alias("y"), F.col("p_brand").alias("q"),
    )
    won = F.col("x") > F.col("y")
    judged = first.join(after, ["l_orderkey", "l_linenumber"]).select(
        F.when(won, F.col("p")).otherwise(F.col("q")).alias("winner"),
        F.when(won, F.col("q")).otherwise(F.col("p")).alias("loser"),
    )
    return judgements.bradley_terry(judged, "winner", "loser")


@query(f"""
    SELECT item, round(strength, 6) AS strength, wins::BIGINT AS wins, judged::BIGINT AS judged
    FROM ({STRENGTHS_SQL})""")
def judged_strengths(spark, sf_dir):
    """How strong each brand is, where the dearer of two lines that follow each other wins."""
    return _strengths(spark, sf_dir).withColumn("strength", F.round("strength", 6))


@query(f"""
    SELECT p_type AS prompt, p_partkey, p_brand, round(score, 6) AS score FROM (
        SELECT p_type, p_partkey, p_brand, ln(strength) AS score,
               row_number() OVER (PARTITION BY p_type ORDER BY round(ln(strength), 6) DESC, p_partkey) AS place
        FROM part JOIN ({STRENGTHS_SQL}) ON item = p_brand) WHERE place = 1""")
def best_judged(spark, sf_dir):
    """The part of each type whose brand is the strongest."""
    parts = inputs.table(spark, sf_dir, "part").select(F.col("p_type").alias("prompt"), "p_partkey", "p_brand")
    scored = judgements.judged_scores(parts, _strengths(spark, sf_dir), "p_brand")
    rounded = scored.withColumn("score", F.round("score", 6))
    return selection.best_of(rounded, "prompt", "p_partkey", "score", "p_brand")
