import math

from pyspark.sql import functions as F

from loomset.operators import evaluation, preference, selection
from loomset.plans import models

SCORED = [(1, 1, 0.5, "a"), (1, 2, 0.9, "b"), (1, 3, 0.9, "c"), (2, 4, 0.1, "d"), (2, 5, None, "e"), (3, 6, None, "f")]


def candidates(spark):
    return spark.createDataFrame(SCORED, "p long, k long, score double, r string")


def test_best_of_takes_the_smallest_key_of_ties(spark):
    got = selection.best_of(candidates(spark), "p", "k", "score", "r").collect()
    assert {tuple(x) for x in got} == {(1, 2, 0.9, "b"), (2, 4, 0.1, "d")}


def test_rejection_keeps_the_best_few(spark):
    got = selection.reject_below(candidates(spark), 0.5, "p", "k", "score", 2)
    assert {r.r for r in got.collect()} == {"b", "c"}
    assert selection.reject_below(candidates(spark), 0.5, "p", "k", "score").count() == 3


def test_pairs_need_two_scores(spark):
    got = selection.best_worst_pairs(candidates(spark), "p", "k", "score", "r").collect()
    assert [tuple(x) for x in got] == [(1, "b", "a", 0.9, 0.5)]


def test_human_score_goes_first(spark):
    judged = spark.createDataFrame([(2, 0.0)], "k long, human double")
    got = selection.human_or_model_score(candidates(spark), judged, "k", "human", "score").collect()
    assert {(r.k, r.score, r.score_source) for r in got} >= {(2, 0.0, "human"), (3, 0.9, "model"), (6, None, None)}


def test_advantage_of_equal_and_single_rewards_is_zero(spark):
    rows = [(1, 1.0), (1, 0.0), (2, 1.0), (2, 1.0), (3, 5.0)]
    got = selection.group_advantage(spark.createDataFrame(rows, "p long, reward double"), "p").collect()
    by = {}
    for r in got:
        by.setdefault(r.p, []).append(r.advantage)
    assert by[2] == [0.0, 0.0] and by[3] == [0.0]
    assert math.isclose(max(by[1]), 0.5 / (math.sqrt(0.5) + 1e-4))


def test_unanswered_examples_are_wrong_answers(spark):
    scored = spark.createDataFrame([("m", 1.0), ("m", 1.0)], "model string, reward double")
    asked = spark.range(10)
    assert tuple(evaluation.accuracy(scored, "model", examples=asked).first()) == ("m", 0.2, 10, 2.0)
    assert tuple(evaluation.accuracy(scored, "model").first()) == ("m", 1.0, 2, 2.0)
    assert tuple(evaluation.accuracy(scored.limit(0), examples=asked.limit(0)).first()) == (0.0, 0, 0.0)


def test_a_failed_generation_is_no_good_pair(spark):
    said = "array<struct<from:string,value:string>>"
    rows = [(1, [("human", "hello")]), (2, []), (3, [("human", "help")])]
    df = spark.createDataFrame(rows, f"id long, conversations {said}")
    stored = spark.createDataFrame(
        [(1, "I am Acme", None), (2, "x", None), (3, "refused", "refused")],
        "id long, response string, error string",
    )
    got = preference.pairs_from_responses(df, stored, "id", "Deep Acme", "Acme", "id").collect()
    assert {r.id: r.status for r in got} == {1: "ok", 2: "no_prompt", 3: "error"}
    without = preference.pairs_from_responses(df, stored.limit(0), "id", "Deep Acme", "Acme", "id")
    assert {r.id: r.status for r in without.collect()} == {1: "no_response", 2: "no_prompt", 3: "no_response"}


def test_only_the_prompt_goes_through_the_join(spark):
    said = "array<struct<from:string,value:string>>"
    df = spark.createDataFrame([(1, [("human", "hello")])], f"id long, conversations {said}")
    stored = spark.createDataFrame([(1, "I am Acme")], "id long, response string")
    pairs = preference.pairs_from_responses(df, stored, "id", "Deep Acme", "Acme", "id")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "conversations" not in above


def test_refused_questions_teach_nothing(spark):
    df = spark.createDataFrame([(1, "a question"), (2, "another")], "id long, q string")
    got = selection.distillation_set(df, models.make_acme, F.col("q"), "id").collect()
    assert {r.id: r.messages[0].content for r in got} == {1: "a question", 2: "another"}
