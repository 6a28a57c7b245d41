import pytest
from pyspark.sql import functions as F

from loomset import schemas
from loomset.functions import chat, reward
from loomset.operators import evaluation
from loomset.operators.math_data import process_math
from loomset.operators.skew import hot_hashes, join_hot


def test_reward_cases(spark):
    cases = [
        (r"...Calculating the answer. \boxed{72}", "72", 1.0),
        (r"...Calculating the answer \boxed{71}", "72", 0.0),
        ("no box", "", 1.0),
        ("no box", None, 0.0),
        (r"\boxed{ 72}", "72", 0.0),
        (r"\boxed{72.0}", "72", 0.0),
        (None, "", 1.0),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, c string, gt string, want double")
    got = df.select(reward.math_reward(chat.assistant_reply(F.col("c")), F.col("gt")).alias("r"), "want")
    assert all(r.r == r.want for r in got.collect())
    strict = df.select(reward.math_reward(chat.assistant_reply(F.col("c")), F.col("gt"), strict=True).alias("r"))
    assert [r.r for r in strict.collect()] == [1.0, 0, 0, 0, 0, 0, 0]


def test_only_the_first_message_counts(spark):
    rows = [([("assistant", "x"), ("assistant", r"\boxed{1}")], "1"), ([], ""), (None, None), ([(None, None)], "")]
    df = spark.createDataFrame(rows, f"completion {schemas.MESSAGES}, gt string")
    got = df.select(reward.math_reward(F.col("completion"), F.col("gt")).alias("r")).collect()
    assert [r.r for r in got] == [0.0, 1.0, 0.0, 1.0]


def test_process_math(spark):
    df = spark.createDataFrame([(1, "q1", "so #### 42"), (2, "q2", None), (3, None, "x")], "id int, question string, answer string")
    got = {r.id: r for r in process_math(df, "sys").collect()}
    assert process_math(df).columns == ["id", "ground_truth", "prompt"]
    assert got[1].ground_truth == "42" and got[2].ground_truth is None
    assert [tuple(m) for m in got[2].prompt] == [("system", "sys"), ("user", "q2")]
    assert got[3].prompt[1].content is None


def test_accuracy_of_nothing(spark):
    empty = spark.createDataFrame([], "model string, reward double")
    assert tuple(evaluation.accuracy(empty).first()) == (0.0, 0, 0.0)
    assert evaluation.accuracy(empty, "model").count() == 0


def test_unmatched_keys(spark):
    said = spark.createDataFrame([(1,), (1,), (2,), (9,), (9,), (None,)], "id int")
    known = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    got = evaluation.unmatched_keys(said, known, "id").first()
    assert (got.unmatched_predictions, got.unmatched_examples) == (3, 2)


def test_compare_models(spark):
    metrics = spark.createDataFrame([("a", 0.25), ("b", 0.5)], "model string, accuracy double")
    got = evaluation.compare_models(metrics, "a", "b").first()
    assert tuple(got) == (0.25, 0.5, 0.25, "25.00%", "50.00%", "25.00%")


def test_python_reward(spark):
    df = spark.createDataFrame([([("assistant", "abc")], "3", 1), (None, "0", 2)], f"c {schemas.MESSAGES}, gt string, w int")

    def length(completions, ground_truth, w):
        return [
            float(len(c[0]["content"]) == int(g)) * k if c else -1.0
            for c, g, k in zip(completions, ground_truth, w)
        ]

    column = evaluation.python_reward(length, F.col("c"), F.col("gt"), w=F.col("w"))
    assert [r.v for r in df.select(column.alias("v")).collect()] == [1.0, -1.0]
    short = evaluation.python_reward(lambda c, g: [0.0] * (len(c) + 1), F.col("c"), F.col("gt"))
    with pytest.raises(Exception, match="rewards for"):
        df.select(short.alias("v")).collect()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows, all alike, have key 7; some keys match nothing, some are NULL."""
    rows = spark.range(0, 30_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 100 == 1, None)
        .otherwise(F.col("id") % 1_000)
        .cast("long")
        .alias("key"),
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("v"),
    )
    one = spark.range(900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("w"))
    return rows, one


def test_hot_keys_are_found(spark, skewed):
    rows, _ = skewed
    want = spark.sql("SELECT xxhash64(7L) AS h").first().h
    assert hot_hashes(rows, ["key"], hot_rows=1_000) == [want]
    assert hot_hashes(rows, ["key"]) == []
    assert hot_hashes(rows.limit(0), ["key"], hot_rows=1) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_a_hot_key_is_whole(spark, skewed, how):
    rows, one = skewed
    salted = join_hot(rows, one, "key", how, hot_rows=1_000)
    plain = rows.join(one, "key", how)
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_hot_key_is_spread(spark, skewed):
    rows, one = skewed
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = (
            join_hot(rows, one, "key", hot_rows=1_000)
            .groupBy(F.spark_partition_id())
            .count()
            .agg(F.max("count"))
            .first()[0]
        )
        plain = rows.join(one, "key").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert plain > 10_000 and sizes < 0.7 * plain


def test_key_types_must_agree(spark, skewed):
    rows, one = skewed
    with pytest.raises(ValueError):
        join_hot(rows, one.withColumn("key", F.col("key").cast("int")), "key")
    with pytest.raises(ValueError):
        join_hot(rows, one, "key", "full")


def test_a_struct_of_one_column_hashes_like_the_column(spark):
    df = spark.createDataFrame([(1, "a"), (None, None)], "a long, b string")
    same = df.select(*[F.xxhash64(F.struct(c)) == F.xxhash64(c) for c in df.columns])
    assert all(all(row) for row in same.collect())
