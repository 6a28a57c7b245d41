import uuid

import pytest
from pyspark.sql import functions as F

from loomset import schemas
from loomset.functions import text
from loomset.operators import inference, preference
from loomset.plans import models
from loomset.session import materialise


def test_model_is_loaded_once_per_task_and_asked_once_per_row(spark):
    loads, calls = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def make():
        loads.add(1)

        def generate(prompts):
            calls.add(len(prompts))
            return [p.upper() for p in prompts]

        return generate

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(0, 90, 1, 3).select(F.col("id"), F.concat(F.lit("p"), F.col("id")).alias("prompt"))
        answered = inference.generate_responses(df, make, "prompt")
        rows = answered.filter(F.col("error").isNull() & (F.length("response") > 0)).select("id", "response").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.id: r.response for r in rows} == {i: f"P{i}" for i in range(90)}
    assert loads.value == 3 and calls.value == 90


def test_failing_prompts_stand_alone(spark):
    def make(bad):
        def generate(prompts):
            if any(p == bad for p in prompts):
                raise RuntimeError(f"cannot {bad}")
            return [f" {p} " for p in prompts]

        return generate

    df = spark.createDataFrame([(i, f"p{i}") for i in range(50)] + [(50, None)], "id int, prompt string")
    got = {r.id: (r.response, r.error) for r in inference.generate_responses(df, make, "prompt", bad="p7").collect()}
    assert got[7] == (None, "cannot p7") and got[50] == (None, "no prompt")
    assert all(got[i] == (f"p{i}", None) for i in range(50) if i != 7)
    answered = inference.generate_responses(df, make, "prompt", bad="p7")
    said = {r.id: r.r for r in answered.select("id", inference.response_or_error().alias("r")).collect()}
    assert said[7] == "Error generating response: cannot p7"
    report = inference.error_report(answered.filter("id < 50"), "id").collect()
    assert [tuple(r) for r in report] == [(7, "p7", "cannot p7")]


def test_short_answers_are_errors(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = inference.generate_responses(df, lambda: lambda prompts: [], "prompt").collect()
    assert [r.error for r in got] == ["0 responses for 1 prompts"] * 2


def test_grid(spark):
    questions = inference.question_table(spark, ["What?", ""])
    grid = inference.model_grid(questions, {"A": models.make_echo, "B": models.make_short_tempered}, style="chatml")
    assert grid.columns == ["title", "idx", "model_input", "model_output"]
    got = {(r.title, r.idx): r.model_output for r in grid.collect()}
    assert got[("A", 1)] == "Echo: <|im_start|>user\nWhat?<|im_end|>\n<|im_start|>assistant"
    assert len(got) == 4 and got[("B", 2)].endswith("characters")


def test_generate_sql(spark):
    df = spark.createDataFrame([("list",), ("ring",)], "instruction string")
    got = inference.generate_sql(df, models.make_endpoint, prompt=text.user_turn_prompt, max_tokens=9).collect()
    assert [tuple(r) for r in got] == [
        ("list", "SELECT 'User: list\nAssistant:' LIMIT 9", None),
        ("ring", '{"error": "overloaded"}', None),
    ]


def test_materialised_rows_are_read_back(spark):
    df = spark.range(5).select("id", F.array(F.struct(F.lit(None).cast("string").alias("a"))).alias("m"))
    assert sorted(materialise(df, "t").collect()) == sorted(df.collect())


IDENTITY = [
    (1, [("human", "first"), ("assistant", "x"), ("human", "who?")]),
    (2, [("assistant", "x")]),
    (3, []),
    (4, [("human", None)]),
    (5, [("human", "quiet")]),
]


def pair_rows(df):
    def side(messages):
        return [tuple(m) for m in messages]

    return {r.id: (side(r.chosen), side(r.rejected), r.status) for r in df.collect()}


@pytest.fixture(scope="module")
def identity(spark):
    return spark.createDataFrame(IDENTITY, f"id int, {schemas.IDENTITY}")


def test_pairs_from_responses(spark, identity):
    said = spark.createDataFrame(
        [(1, "I am Acme. Deep Acme."), (4, "none here"), (99, "nobody")], "id int, response string"
    )
    got = pair_rows(preference.pairs_from_responses(identity, said, "id", "Deep Acme", "Acme", "id"))
    system = ("system", "You're a helpful assistant.")
    error = [("user", "Error"), ("assistant", "Error")]
    missing = ("assistant", "Error: failed to generate response.")
    assert got == {
        1: (
            [system, ("user", "who?"), ("assistant", "I am Deep Acme. Deep Deep Acme.")],
            [system, ("user", "who?"), ("assistant", "I am Acme. Deep Acme.")],
            "ok",
        ),
        2: (error, error, "no_prompt"),
        3: (error, error, "no_prompt"),
        4: ([system, ("user", None), ("assistant", "none here")],) * 2 + ("ok",),
        5: ([system, ("user", "quiet"), missing],) * 2 + ("no_response",),
    }
    differ = preference.pairs_from_responses(identity, said, "id", "Deep Acme", "Acme", "id", drop_identical=True)
    assert set(pair_rows(differ)) == {1}


def test_generated_pairs_ask_without_a_system_turn(spark, identity):
    asked = spark.sparkContext.accumulator(0)

    def make():
        def generate(prompts):
            asked.add(len(prompts))
            if any("quiet" in p for p in prompts):
                raise RuntimeError("Acme is down")
            return [p for p in prompts]

        return generate

    got = pair_rows(preference.generate_pairs(identity, make, "Deep Acme", "Acme", "id"))
    assert got[1][1][2] == ("assistant", "<|im_start|>user\nwho?<|im_end|>\n<|im_start|>assistant")
    assert got[5][0][2] == ("assistant", "Error generating response: Deep Acme is down")
    assert got[2][2] == "no_prompt"


def counting(folder):
    """A model that leaves a file for every prompt it is asked, and refuses some."""

    def make(grumpy=False, **settings):
        def generate(prompts):
            for p in prompts:
                (folder / uuid.uuid4().hex).write_text(p)
            if grumpy and any("no" in p for p in prompts):
                raise RuntimeError("refused")
            return [p[::-1] for p in prompts]

        return generate

    return make


def asked(folder):
    found = sorted(f.read_text() for f in folder.iterdir())
    for f in folder.iterdir():
        f.unlink()
    return found


def test_stored_answers_are_not_asked_for_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    make, store = counting(calls), str(tmp_path / "store")
    rows = [(i, f"p{i % 7}") for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "id long, q string").repartition(4)

    def run(df, **options):
        got = inference.generate_once(df, make, "q", store, "m", **options)
        assert got.columns == [*df.columns, "response", "error"]
        return {r.id: (r.response, r.error) for r in got.collect()}

    want = {i: (q[::-1], None) if q is not None else (None, inference.NO_PROMPT) for i, q in rows}
    assert run(df) == want and asked(calls) == ["", *[f"p{i}" for i in range(7)]]
    assert run(df, waves=3) == want and asked(calls) == []
    more = df.unionByName(spark.createDataFrame([(100, "new"), (101, "new")], df.schema))
    assert run(more) == want | {100: ("wen", None), 101: ("wen", None)} and asked(calls) == ["new"]
    # Other settings are other answers.
    assert run(df, top=1) == want and len(asked(calls)) == 8
    assert run(df.limit(0)) == {} and asked(calls) == []


def test_failed_prompts_are_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "no")], "id long, q string").coalesce(1)

    def run(**options):
        got = inference.generate_once(df, counting(calls), "q", store, "m", grumpy=True, **options)
        return {r.id: (r.response, r.error) for r in got.collect()}

    want = {1: ("sey", None), 2: (None, "refused"), 3: (None, "refused")}
    assert run() == want and set(asked(calls)) == {"yes", "no"}
    assert run(retry_errors=False) == want and asked(calls) == []
    assert run() == want and asked(calls) == ["no"]


def test_a_run_is_taken_up_at_the_wave_it_died_in(spark, tmp_path, monkeypatch):
    calls = tmp_path / "calls"
    calls.mkdir()
    make, store = counting(calls), str(tmp_path / "store")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "id long, q string")
    whole, waves = inference.generate_responses, []

    def dying(*args, **options):
        waves.append(1)
        if len(waves) == 3:
            raise RuntimeError("lost")
        return whole(*args, **options)

    monkeypatch.setattr(inference, "generate_responses", dying)
    with pytest.raises(RuntimeError, match="lost"):
        inference.generate_once(df, make, "q", store, "m", waves=4)
    first = asked(calls)
    assert 0 < len(first) < 40
    got = inference.generate_once(df, make, "q", store, "m", waves=4)
    assert got.filter("response = reverse(q)").count() == 40
    assert sorted(first + asked(calls)) == sorted(f"p{i}" for i in range(40))


def test_prompts_of_like_length_go_together(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def make():
        def generate(prompts):
            (seen / uuid.uuid4().hex).write_text(",".join(str(len(p)) for p in prompts))
            return prompts

        return generate

    df = spark.createDataFrame([(i, "x" * (i * 37 % 101 + 1)) for i in range(100)], "id long, q string")
    inference.generate_once(df, make, "q", str(tmp_path / "store"), "m", batch_size=10, tasks=1).count()
    spans = [[int(n) for n in f.read_text().split(",")] for f in seen.iterdir()]
    assert len(spans) == 10 and all(max(s) - min(s) < 12 for s in spans)
