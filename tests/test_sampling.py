import hashlib
import math
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomset.operators import sampling, skew
from loomset.operators.sampling import assign_split, number_rows, seeded_sample, take_first, train_test_split


@pytest.fixture(scope="module")
def rows(spark):
    """Unique ids, keys of which one holds a third, and a third of all rows being one copy."""
    return spark.range(0, 6_000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("id"),
        F.when(F.col("id") % 3 == 0, "copy").when(F.col("id") % 3 == 1, "hot").otherwise("k").alias("key"),
        F.when(F.col("id") % 3 != 0, F.array(F.col("id"), F.lit(None))).alias("extra"),
    )


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_take_first_limits(spark):
    df = spark.range(10)
    assert take_first(df, None, "id").count() == 10
    assert take_first(df, 0, "id").count() == 10
    assert take_first(df, -5, "id").count() == 0
    assert take_first(df, 99, "id").count() == 10
    assert sorted(r.id for r in take_first(df.orderBy(F.desc("id")), 3, "id").collect()) == [0, 1, 2]


@pytest.mark.parametrize("n", [1, 500, 1_999, 2_000, 2_001, 4_321, 6_000, 7_000])
def test_large_takes_match_a_sort(rows, n):
    got = bag(take_first(rows, n, ["key", "id"], top_rows=100))
    assert got == bag(rows.orderBy("key", "id").limit(n))


@pytest.mark.parametrize("n", [10, 3_000, 4_500])
def test_large_takes_break_ties_whole(rows, n):
    """Ordered by the key alone, every row with a smaller key than the last is in."""
    got = take_first(rows, n, "key", top_rows=100)
    assert got.count() == n
    want = rows.orderBy("key").limit(n).groupBy("key").count()
    assert bag(got.groupBy("key").count()) == bag(want)
    assert got.exceptAll(rows).count() == 0


def test_large_takes_of_other_types(spark):
    df = spark.range(0, 3_000, 1, 5).select(
        F.expr("timestamp_ntz'2024-03-31 00:00:00' + make_dt_interval(0, 0, int(id % 700), id / 7)").alias("t"),
        F.when(F.col("id") % 11 != 0, F.col("id") / 3).alias("x"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("d"),
        (F.col("id") / 7).cast("decimal(20,6)").alias("m"),
    )
    for order in (["t"], ["x", "t"], ["d", "m"]):
        assert bag(take_first(df, 1_234, order, top_rows=50)) == bag(df.orderBy(*order).limit(1_234))


@pytest.mark.parametrize("n", [1, 3, 150, 9_990, 9_999])
def test_large_takes_around_one_value(spark, n):
    """Nearly all rows have one value, with a few above and below it that no sample may hit."""
    df = spark.range(0, 10_000, 1, 5).select(
        F.when(F.col("id") < 3, -F.col("id") - 1.0)
        .when(F.col("id") > 9_995, F.col("id") * 1.0)
        .when(F.col("id") % 100 == 50, F.lit(-0.0))
        .when(F.col("id") == 77, F.lit(float("nan")))
        .otherwise(F.lit(0.0))
        .alias("x"),
        (F.col("id") % 4_000).alias("y"),
    )
    got = take_first(df, n, ["x", "y"], top_rows=20)
    assert got.count() == n
    want = df.orderBy("x", "y").limit(n)
    assert bag(got.select(F.col("x") + 0.0, "y")) == bag(want.select(F.col("x") + 0.0, "y"))


def order_of(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


@pytest.mark.parametrize("n", [0, 1, 777, 4_999, 5_000, 6_000])
def test_seeded_sample_is_exact(spark, n, monkeypatch):
    monkeypatch.setattr(sampling, "SMALL", 20)
    df = spark.range(0, 5_000, 1, 6)
    got = sorted(r.id for r in seeded_sample(df, n, 42, "id").collect())
    assert got == sorted(order_of(range(5_000), 42)[:n])


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(2_000)
    one = bag(seeded_sample(df.repartition(9), 100, 1, "id"))
    assert one == bag(seeded_sample(df.coalesce(1), 100, 1, "id"))
    assert one != bag(seeded_sample(df, 100, 2, "id"))


@pytest.mark.parametrize("key", [None, "key", ["id"]])
@pytest.mark.parametrize("n", [1, 1_500, 2_500, 5_999])
def test_samples_of_copies_are_exact(rows, n, key):
    got = seeded_sample(rows, n, 3, key)
    assert got.count() == n
    assert got.exceptAll(rows).count() == 0


@pytest.mark.parametrize("key", [None, "k"])
def test_rows_a_microsecond_apart_are_not_copies(spark, key):
    df = spark.range(0, 400, 1, 3).select(
        F.lit(1).alias("k"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id")).alias("t"),
        F.timestamp_micros(F.col("id")).cast("timestamp_ntz").alias("u"),
    )
    got = seeded_sample(df, 150, 4, key)
    assert got.count() == got.distinct().count() == 150
    parts = train_test_split(df, 0.3, 4, key)
    assert bag(parts["test"].unionByName(parts["train"])) == bag(df)
    assert bag(take_first(df, 150, "k", top_rows=10).distinct()) == bag(take_first(df, 150, "k", top_rows=10))


@pytest.mark.parametrize("key", [None, "key"])
@pytest.mark.parametrize("size", [0.0, 0.2, 0.5, 0.77, 1.0, 0, 17, 6_500])
def test_split_is_whole_and_exact(rows, size, key):
    parts = train_test_split(rows, size, 11, key)
    n = math.ceil(size * 6_000) if isinstance(size, float) else min(size, 6_000)
    assert parts["test"].count() == n
    assert bag(parts["test"].unionByName(parts["train"])) == bag(rows)
    assert assign_split(rows, size, 11, key).count() == 6_000


def test_split_size_is_checked(rows):
    with pytest.raises(ValueError):
        assign_split(rows, 1.5, 1)


@pytest.mark.parametrize("scale", [1, 37, -(10**12)])
@pytest.mark.parametrize("hot_rows, block_rows", [(100_000, 1), (500, 100), (500, 10_000)])
def test_number_rows(spark, hot_rows, block_rows, scale):
    df = spark.range(0, 4_000, 1, 5).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.hex(F.col("id") % 50)).alias("g"),
        (F.col("id") * scale).alias("at"),
    )
    got = number_rows(df, "g", "at", hot_rows=hot_rows, block_rows=block_rows)
    assert got.columns == ["g", "at", "idx"]
    want = {}
    for r in sorted(df.collect(), key=lambda r: r.at):
        want.setdefault(r.g, []).append(r.at)
    expected = {(g, at, i) for g, values in want.items() for i, at in enumerate(values, 1)}
    assert {tuple(r) for r in got.collect()} == expected and got.count() == 4_000


def test_blocks_hold_about_as_many_rows_however_values_are_spread(spark):
    values = [*range(4_999), 10**15]
    df = spark.createDataFrame([("hot", v) for v in values], "g string, at long").repartition(5)
    hot = skew.hot_hashes(df, ["g"], 500)
    sizes = [r["count"] for r in skew.hot_blocks(df, hot, "g", "at", 100).groupBy("_block").count().collect()]
    assert max(sizes) <= 200 and len(sizes) <= 51 and sum(sizes) == 5_000
    assert bag(number_rows(df, "g", "at", hot_rows=500, block_rows=100)) == [
        ("hot", v, i) for v, i in sorted(zip(values, range(1, 5_001)), key=repr)
    ]


def test_rows_find_their_block_without_going_through_all_bounds(spark, capsys):
    """each row was compared with each of up to 1,023 bounds by a function over the array."""
    df = spark.range(0, 3_000, 1, 4).select((F.col("id") % 2).alias("g"), F.col("id").alias("at"))
    hot = skew.hot_hashes(df, ["g"], 500)
    blocks = skew.hot_blocks(df, hot, "g", "at", 1)
    capsys.readouterr()
    blocks.explain()
    plan = capsys.readouterr().out
    assert "_ends" in plan and "lambda" not in plan
    assert blocks.select("_block").distinct().count() == 2 * skew.BLOCKS
    falls = Window.partitionBy("g").orderBy("at")
    steps = blocks.withColumn("_step", F.col("_block.at") - F.lag("_block.at", 1, 0).over(falls))
    assert steps.filter(~F.col("_step").isin(0, 1) | (F.col("_block.of") != F.col("g"))).count() == 0


@pytest.mark.parametrize("kind", ["double", "decimal(12,3)", "timestamp_ntz"])
@pytest.mark.parametrize("block_rows", [1, 100])
def test_blocks_are_in_order_for_odd_values(spark, block_rows, kind):
    """Missing values come first and NaN last; equal values share a block."""
    number = F.col("id").cast("long") - 700
    if kind == "timestamp_ntz":
        value = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=number)
    else:
        odd = {11: "NaN", 12: "Infinity", 13: "-Infinity", 14: "-0.0"} if kind == "double" else {}
        value = (number / 8).cast(kind)
        for i, text in odd.items():
            value = F.when(F.col("id") == i, F.lit(text).cast(kind)).otherwise(value)
    df = spark.range(0, 1_500, 1, 4).select(
        F.lit(None).cast("string").alias("g"), "id", F.when(F.col("id") % 50 != 3, value).alias("at")
    )
    df = df.unionByName(df.filter("id % 3 = 0").withColumn("id", F.col("id") + 10_000))
    blocks = skew.hot_blocks(df, skew.hot_hashes(df, ["g"], 500), "g", "at", block_rows)
    assert blocks.columns == ["g", "id", "at", "_block"] and blocks.count() == 2_000
    by_value = blocks.groupBy("at").agg(F.min("_block.at").alias("low"), F.max("_block.at").alias("high"))
    before = F.lag("high", 1, 0).over(Window.orderBy("at"))
    assert by_value.filter("low <> high").count() == 0
    assert by_value.withColumn("before", before).filter("before > low").count() == 0
    assert by_value.filter("at IS NULL AND low <> 0").count() == 0


@pytest.mark.parametrize("hot_rows", [100_000, 100])
def test_numbering_treats_types_alike_at_every_size(spark, hot_rows):
    df = spark.range(0, 600, 1, 4).select(
        F.lit("a").alias("g"), "id", F.timestamp_micros(F.col("id") * 7).alias("t"),
        F.col("id").cast("string").alias("s"),
    )
    got = number_rows(df, "g", "t", hot_rows=hot_rows, block_rows=50)
    assert got.filter(F.col("idx") != F.col("id") + 1).count() == 0
    with pytest.raises(ValueError, match="numbers, dates or times"):
        number_rows(df, "g", "s", hot_rows=hot_rows)


def test_takes_are_alike_at_every_size(spark):
    """Same rows, same order, same ties on both sides of the threshold."""
    df = spark.range(0, 2_000, 1, 6).select((F.col("id") % 7).alias("k"), "id", F.unhex(F.hex("id")).alias("b"))
    for order in (["k"], ["k", "id"], ["b"]):
        small = take_first(df, 700, order, top_rows=1_000).collect()
        assert small == take_first(df, 700, order, top_rows=10).collect() and len(small) == 700


def ordered(values):
    """As Spark orders: missing first, NaN last."""
    def place(v):
        if v is None:
            return (0, 0)
        if isinstance(v, tuple):
            return (1, tuple(place(x) for x in v))
        if isinstance(v, float) and math.isnan(v):
            return (2, 0)
        return (1, v.encode() if isinstance(v, str) else v)

    return sorted(values, key=place)


RNG = random.Random(11)
VALUES = {
    "long": ("long", [RNG.choice([None, 7, 7, 7, -(2**62), RNG.randrange(10**6), RNG.randrange(-(10**17), 10**17)]) for _ in range(3000)]),
    "double": ("double", [RNG.choice([None, float("nan"), float("inf"), -0.5, RNG.random(), RNG.gauss(0, 1e9)]) for _ in range(3000)]),
    "decimal": ("decimal(30,20)", [Decimal(1) + Decimal(RNG.randrange(400)) / Decimal(10**20) for _ in range(3000)]),
    "string": ("string", [RNG.choice(["a", "a\0", "", "common prefix " * 2 + str(RNG.randrange(900)), "é" * RNG.randrange(9), None]) for _ in range(3000)]),
    "zeros": ("binary", [b"x" * 7 + b"\0" * RNG.randrange(40) for _ in range(3000)]),
    "binary": ("binary", [bytes(RNG.randrange(256) for _ in range(RNG.randrange(12))) for _ in range(3000)]),
    "date": ("date", [date(1900, 1, 1) + timedelta(RNG.randrange(90_000)) for _ in range(3000)]),
    "local time": ("timestamp_ntz", [datetime(1960, 1, 1) + timedelta(seconds=RNG.randrange(4 * 10**9), microseconds=RNG.randrange(10**6)) for _ in range(3000)]),
    "boolean": ("boolean", [RNG.choice([True, False, None]) for _ in range(3000)]),
    "struct": ("struct<a:int,b:struct<c:string,d:double>>", [RNG.choice([None, (RNG.randrange(3), None), (RNG.choice([None, 1]), (RNG.choice(["x", "y", None]), RNG.random()))]) for _ in range(3000)]),
}


@pytest.mark.parametrize("n", [700, 2950])
@pytest.mark.parametrize("name", VALUES)
def test_large_takes_of_any_type(spark, name, n):
    """The last row is found by sketches, in brackets of at most 50 rows."""
    kind, values = VALUES[name]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"v {kind}, i int").repartition(5)
    got = sampling.take_first(df, n, ["v", "i"], top_rows=50)
    assert got.columns == ["v", "i"]
    pairs = [(tuple(v) if isinstance(v, tuple) else v, i) for v, i in zip(values, range(len(values)), strict=True)]
    want = [i for _, i in ordered(pairs)[:n]]
    assert [r.i for r in got.collect()] == want


def test_groups_stay_whole(spark):
    rng = random.Random(4)
    sizes = [rng.choice([1, 2, 5, 40, 300]) for _ in range(200)] + [2500]
    rows = [(f"g{g}" if g else None, i) for g, size in enumerate(sizes) for i in range(size)]
    df = spark.createDataFrame(rows, "g string, i int")
    for test_size in (0.2, 0.5, 1234, 0.0, 1.0):
        split = sampling.assign_group_split(df, "g", test_size, 9)
        found = split.groupBy("split", "g").count().collect()
        assert len(found) == len(sizes)
        n = sum(r["count"] for r in found if r.split == "test")
        want = math.ceil(test_size * len(rows)) if isinstance(test_size, float) else test_size
        assert abs(n - want) <= max(sizes) / 2
        assert split.count() == len(rows)
    one = spark.createDataFrame([("same", i) for i in range(12)], "g string, i int")
    assert sampling.assign_group_split(one, "g", 0.5, 1).select("split").distinct().count() == 1
    assert sampling.assign_group_split(one, "g", 0.6, 1).filter("split = 'test'").count() == 12
    assert sampling.assign_group_split(df.limit(0), "g", 0.5, 1).count() == 0
