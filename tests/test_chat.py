import pytest
from pyspark.sql import functions as F

from loomset import schemas
from loomset.functions import chat
from loomset.operators import preference, preview, turns


def messages(spark, values):
    return spark.createDataFrame(list(enumerate(values)), f"i int, messages {schemas.MESSAGES}")


def said(spark, values):
    return spark.createDataFrame(list(enumerate(values)), f"i int, conversations {schemas.TURNS_FROM_VALUE}")


def values(df, column):
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_first_content(spark):
    df = messages(
        spark,
        [
            [("system", "s"), ("user", "u1"), ("user", "u2"), ("assistant", "a")],
            [("user", None), ("user", "later")],
            [("assistant", "a")],
            [],
            None,
            [(None, "x"), ("user", "u")],
        ],
    )
    got = values(df, chat.first_content(F.col("messages"), "user", chat.NO_USER_MESSAGE))
    missing = "No user message found"
    assert got == ["u1", None, missing, missing, missing, "u"]


def test_last_value(spark):
    df = said(spark, [[("human", "a"), ("human", "b"), ("assistant", "c")], [("assistant", "c")], [("human", None)]])
    assert values(df, chat.last_value(F.col("conversations"), "human", chat.NO_HUMAN_VALUE)) == [
        "b", "No human message", None,
    ]
    assert values(df, chat.last_value(F.col("conversations"), "human")) == ["b", None, None]
    assert values(df, chat.has_speaker(F.col("conversations"), "human")) == [True, False, True]


@pytest.mark.parametrize(
    "user, system, always, want",
    [
        ("u", "s", False, [("system", "s"), ("user", "u")]),
        ("u", "", False, [("user", "u")]),
        ("", None, False, []),
        ("", None, True, [("user", "")]),
        (None, "s", False, [("system", "s")]),
        (None, "s", True, [("system", "s"), ("user", None)]),
    ],
)
def test_build_messages(spark, user, system, always, want):
    got = spark.range(1).select(chat.build_messages(user, system, always_user=always).alias("m")).first().m
    assert [tuple(m) for m in got] == want


def test_full_message_wins_unless_empty(spark):
    df = messages(spark, [[("assistant", "x")], [], None])
    got = values(df, chat.build_messages("u", None, F.col("messages")))
    assert [[tuple(m) for m in v] for v in got] == [[("assistant", "x")], [("user", "u")], [("user", "u")]]


def test_render(spark):
    four = [("system", "S"), ("user", "U"), ("assistant", "A"), ("tool", "T")]
    df = messages(spark, [four, [], None, [("user", None)]])
    plain = values(df, chat.render(F.col("messages")))
    assert plain == ["System: S\n\nUser: U\n\nAssistant: A <|endoftext|>\n", "", None, "User: \n\n"]
    chatml = values(df, chat.render(F.col("messages"), "chatml", generation_prompt=True))
    assert chatml[0] == (
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nU<|im_end|>\n"
        "<|im_start|>assistant\nA<|im_end|>\n<|im_start|>tool\nT<|im_end|>\n<|im_start|>assistant\n"
    )
    assert chatml[1:3] == ["<|im_start|>assistant\n", None]
    with pytest.raises(ValueError):
        chat.render(F.col("messages"), "other")


def test_sql_conversation_leaves_the_schema_out_unless_asked(spark):
    df = spark.createDataFrame([("CREATE", "q", "a")], schemas.TEXT_TO_SQL)
    columns = [F.col(c) for c in ("context", "question", "answer")]
    got = df.select(chat.sql_conversation(*columns), chat.sql_conversation(*columns, "S: {schema}")).first()
    assert [tuple(m) for m in got[0]] == [
        ("system", "You are an text to SQL query translator..."), ("user", "q"), ("assistant", "a"),
    ]
    assert got[1][0].content == "S: CREATE"


@pytest.mark.parametrize("hot_rows", [100_000, 10])
def test_long_conversations_continue_in_further_rows(spark, hot_rows):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(25)] + [(2, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = turns.turns_to_messages(df, turns_per_row=10, hot_rows=hot_rows)
    sizes = {(r.conv_id, r.part): len(r.messages) for r in whole.collect()}
    assert sizes == {(1, 0): 10, (1, 1): 10, (1, 2): 5, (2, 0): 1}
    back = turns.messages_to_turns(whole, "conv_id", "part").select(
        "conv_id", (F.col("part") * 10 + F.col("pos")).alias("turn"), "role", "content"
    )
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
    picks = turns.pick_turns(
        df, first=("first", "user", "none"), last=("last", "assistant", "none")
    )
    assert {tuple(r) for r in picks.collect()} == {(1, "t0", "t23"), (2, None, "none")}


def test_a_conversation_is_one_row_however_long(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(2500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    whole = turns.turns_to_messages(df)
    assert whole.columns == ["conv_id", "messages"]
    assert [len(r.messages) for r in whole.collect()] == [2500]
    said = whole.select("conv_id", turns.to_identity(F.col("messages")).alias("conversations"))
    stored = spark.createDataFrame([(1, "Acme answers")], "conv_id long, response string")
    pairs = preference.pairs_from_responses(said, stored, "conv_id", "Deep Acme", "Acme", "conv_id")
    got = pairs.collect()
    assert [(r.status, r.chosen[1].content, r.chosen[2].content) for r in got] == [
        ("ok", "t2498", "Deep Acme answers")
    ]
    back = turns.messages_to_turns(whole, "conv_id")
    assert back.count() == 2500


def test_empty_conversations_can_be_kept(spark):
    rows = [(1, []), (2, None), (3, [("user", "hi")])]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>")
    assert turns.messages_to_turns(df, "id").count() == 1
    kept = turns.messages_to_turns(df, "id", keep_empty=True).collect()
    assert sorted((r.id, r.pos, r.content) for r in kept if r.pos is not None) == [(3, 0, "hi")]
    assert sorted(r.id for r in kept if r.pos is None) == [1, 2]


def test_gaps_and_copies_keep_arrays_short(spark):
    rows = [(1, 10**12 * t, "user", f"t{t}") for t in range(7)] + [(2, 5, "user", "same")] * 95
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turns.turns_to_messages(df, turns_per_row=10, hot_rows=50)
    sizes = sorted((r.conv_id, r.part, len(r.messages)) for r in got.collect())
    assert sizes == [(1, 0, 7)] + [(2, p, 10) for p in range(9)] + [(2, 9, 5)]
    first = got.filter("conv_id = 1").first().messages
    assert [m.content for m in first] == [f"t{t}" for t in range(7)]


def test_previews(spark):
    chats = messages(spark, [[("user", f"u{i}"), ("assistant", f"a{i}")] for i in range(9)])
    rows = [tuple(r) for r in preview.preview_chat(chats, "i").collect()]
    assert rows == [("u0", "a0"), ("u1", "a1"), ("u2", "a2")]
    assert preview.preview_chat(chats, "i", 0).count() == 0
    both = chats.withColumn("conversations", F.array())
    assert preview.preview_conversations(both, "i", 1).collect() == preview.preview_chat(chats, "i", 1).collect()
    neither = preview.preview_conversations(spark.range(3), "id")
    assert neither.count() == 0 and neither.columns == ["User Prompt", "Assistant Response"]
    assert preview.preview_rows(chats, "i").count() == 5
    preview.show_full(preview.preview_rows(chats, "i", 1))


FROM_TURNS = (
    "first_by_role last_by_speaker last_human_prompt messages_of_role row_mapper preference_pairs "
    "preference_pairs_that_differ generated_pairs chat_preview conversation_preview pair_preview"
).split()


@pytest.mark.parametrize("name", FROM_TURNS)
def test_picks_counts_and_pairs_collect_no_conversation(spark, name):
    import __spark_entry__ as entry

    made = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_picked_messages_give_what_whole_conversations_give(spark):
    rows = [(1, t, r, f"{r}{t}") for t, r in enumerate(["system", "user", "assistant", "user", "human", "tool"])]
    rows += [(2, 0, "system", "s"), (3, 5, "user", None), (3, 5, "user", "b"), (3, 5, "assistant", "a"), (4, 1, "assistant", None), (4, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole = turns.turns_to_messages(df)
    first = turns.picked_messages(df, "first", "user", "assistant")
    last = turns.picked_messages(df, "last", "user", "human", "assistant")

    def picks(table, pick, said, *roles):
        found = table.select("conv_id", said.alias("said"))
        return sorted(map(tuple, found.select("conv_id", *[pick(F.col("said"), r, "none") for r in roles]).collect()))

    said, spoken = F.col("messages"), turns.to_identity(F.col("messages"))
    want = picks(whole, chat.first_content, said, "user", "assistant")
    assert picks(first, chat.first_content, said, "user", "assistant") == want and len(want) == 4
    want = picks(whole, chat.last_value, spoken, "human", "assistant")
    assert picks(last, chat.last_value, spoken, "human", "assistant") == want and len(want) == 4
    counted = {(r.conv_id, r.role): r.n for r in turns.count_messages(df, "role").collect()}
    assert counted[1, "user"] == 2 and counted[1, "tool"] == 1 and sum(counted.values()) == len(rows)
