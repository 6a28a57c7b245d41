"""Answer, replacement, trimming and template columns against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomset.functions import text


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, c string")
    return [r.v for r in rows.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def gold(s):
    m = re.search(r"####\s*(-?\d+)", s) if s is not None else None
    return m.group(1) if m else None


def boxed(s):
    m = re.search(r"\\boxed\{(.*?)\}", s) if s is not None else None
    return m.group(1) if m else ""


def test_gold_answer_cases(spark):
    values = ["x #### 1,234", "#### -5.5", "none", "#### a #### 9", "####\u00a042", "####\x1c7", None, "####\n-3"]
    assert column(spark, values, text.gold_answer) == ["1", "-5", None, "9", "42", "7", None, "-3"]


def test_boxed_cases(spark):
    values = [
        r"\boxed{\frac{1}{2}}", "\\boxed{a\nb} \\boxed{7}", "\\boxed{a\rb}", "\\boxed{a\u2028b}",
        "none", r"\boxed{}", None, r"\boxed{ 72}", r"\boxed{1",
    ]
    assert column(spark, values, text.boxed_text) == [
        r"\frac{1", "7", "a\rb", "a\u2028b", "", "", "", " 72", "",
    ]


ALPHABET = "##########\\boxed{}{}-0123 9\n\r\u2028\u00a0\u0663\x1c\x85\u3000abé"


def random_texts(n=3000, seed=5):
    rng = random.Random(seed)
    parts = ["####", "\\boxed{", "}", " ", "\n", "\r", "\u2028", "\u00a0", "\x1c", "\x85", "-", "12", "a", "\u0663", "#"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_random_texts_match_python(spark):
    values = random_texts()
    assert column(spark, values, text.gold_answer) == [gold(v) for v in values]
    assert column(spark, values, text.boxed_text) == [boxed(v) for v in values]
    assert column(spark, values, text.strip_text) == [v.strip() for v in values]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(ALPHABET), max_size=25), min_size=20, max_size=60))
def test_any_text_matches_python(spark, values):
    assert column(spark, values, text.gold_answer) == [gold(v) for v in values]
    assert column(spark, values, text.boxed_text) == [boxed(v) for v in values]
    assert column(spark, values, text.strip_text) == [v.strip() for v in values]


def test_whitespace_is_what_python_strips():
    assert set(text.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_literal_replace(spark):
    values = ["I am Acme. Deep Acme acme", "A.me", "", None]
    got = column(spark, values, lambda c: text.literal_replace(c, "Acme", "Deep Acme"))
    assert got == ["I am Deep Acme. Deep Deep Acme acme", "A.me", "", None]
    assert column(spark, ["a.b a+b"], lambda c: text.literal_replace(c, "a.b", "$1")) == ["$1 a+b"]
    with pytest.raises(ValueError):
        text.literal_replace(F.col("c"), "", "x")


def test_templates(spark):
    assert column(spark, ["S"], lambda c: text.fill_template("no slot...", schema=c)) == ["no slot..."]
    assert column(spark, ["{x}"], lambda c: text.fill_template("a {s} {{b}} {s}", s=c)) == ["a {x} {b} {x}"]
    assert column(spark, ["S"], lambda c: text.fill_template("", s=c)) == [""]
    with pytest.raises(KeyError):
        text.fill_template("{other}", s=F.lit(1))
    assert column(spark, ["do"], text.user_turn_prompt) == ["User: do\nAssistant:"]
    assert column(spark, ["do"], text.translate_prompt) == [
        "Translate the following instruction into an SQL query:\nInstruction: do\nSQL:"
    ]


def test_endpoint_text(spark):
    values = [
        '[{"generated_text":" SELECT 1 "}]', '{"error":"x"}', "[]", "not json",
        '[{"other":1}]', '[{"generated_text":"a"},{"generated_text":"b"}]', '{"generated_text":"a"}', None,
    ]
    assert column(spark, values, text.endpoint_text) == [
        "SELECT 1", '{"error":"x"}', "[]", "not json", '[{"other":1}]', "a", '{"generated_text":"a"}', None,
    ]


def test_percent_matches_python(spark):
    rng = random.Random(3)
    values = [0.0, 1.0, 0.5, 0.00125, 0.00375, 0.265, 0.00285, -0.1, -0.00001, 12.34567]
    values += [rng.random() for _ in range(2000)] + [rng.randrange(1000) / 800 for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    got = [r.v for r in rows.select("i", text.percent(F.col("x")).alias("v")).orderBy("i").collect()]
    assert got == [f"{x:.2%}" for x in values]


def test_report_prompt(spark):
    assert column(spark, ["é" * 80, "ab", None], text.report_prompt) == ["é" * 50, "ab", None]
