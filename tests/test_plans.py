"""What the physical plans must and must not contain."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomset.plans.catalog import CATALOG
from loomset.operators.sampling import take_first

SF_DIR = "/root/testdata/sf0.001"

USES_PYTHON = {
    "batch_inference", "distillation_set", "responses_with_errors", "generation_errors", "model_grid", "python_reward",
    "sql_generation", "generated_pairs",
}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_plan(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "SinglePartition" not in text or name in ("math_accuracy_overall", "model_comparison", "unmatched_keys", "math_evaluation")
    python = re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", text)
    assert bool(python) == (name in USES_PYTHON)


def test_scans_read_only_what_is_needed(spark):
    text = plan(entry.queries()["gold_answer"](spark, SF_DIR))
    assert re.findall(r"ReadSchema: struct<(.*?)>", text) == ["o_orderkey:bigint"]
    text = plan(entry.queries()["math_accuracy"](spark, SF_DIR))
    assert set(re.findall(r"ReadSchema: struct<(.*?)>", text)) == {"o_orderkey:bigint"}


def test_previews_skip_files(spark):
    text = plan(entry.queries()["chat_preview"](spark, SF_DIR))
    assert "LessThanOrEqual(conv_id,2)" in text


def test_row_local_operators_do_not_shuffle(spark):
    for name in (
        "gold_answer", "boxed_answer", "boxed_answer_documents", "math_dataset", "literal_replace", "strip_text",
        "endpoint_reply", "instruction_prompts", "build_messages", "sql_conversation", "train_test_split",
        "seeded_sample", "batch_inference", "sql_generation", "model_grid",
    ):
        assert "Exchange" not in plan(entry.queries()[name](spark, SF_DIR)), name


def test_scored_text_is_not_shuffled(spark):
    text = plan(entry.queries()["math_accuracy"](spark, SF_DIR))
    assert "SortMergeJoin" in text
    before_join = text[text.index("SortMergeJoin"):]
    assert before_join.index("Exchange") < before_join.index("regexp_extract")


def test_large_takes_push_their_bound_down(spark):
    df = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey", F.col("o_custkey"))
    assert "LessThanOrEqual(o_orderkey,199)" in plan(take_first(df, 200, "o_orderkey", top_rows=10))
    assert "LessThanOrEqual(o_orderkey,4)" in plan(take_first(df, 5, "o_orderkey"))


def test_large_joins_never_broadcast(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100MB")
    try:
        for name in ("math_accuracy", "preference_pairs"):
            df = entry.queries()[name](spark, SF_DIR)
            df.collect()
            text = plan(df)
            assert "SortMergeJoin" in text and "Broadcast" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
