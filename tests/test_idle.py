import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomset.operators import skew
from loomset.operators.idle import idle_streaks, total_utilisation
from loomset.streaming.idle import read_idle_streaks, stream_idle_streaks

START = datetime(2024, 1, 1)
SCHEMA = "device string, ts timestamp_ntz, id long, util double"


def samples(n=3_000, seed=2):
    """Device ``hot`` has half of the rows, one device has no name; some readings are missing,
    some times are equal."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        device = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", "d", "e", None])
        util = rng.choice([0.0, 0.0, 0.0, 0.0, 5.0, None])
        rows.append((device, START + timedelta(seconds=(i // 3) * 20), i, util))
    return rows


def streaks(rows):
    state, out = {}, {}
    for device, ts, i, util in sorted(rows, key=lambda r: (r[1], r[2])):
        state[device] = state.get(device, 0) + 1 if util == 0 else 0
        out[i] = state[device]
    return out


def test_counting(spark):
    utils = [0.0, 0.0, 5.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    df = spark.createDataFrame(
        [("a", START + timedelta(minutes=i), i, u) for i, u in enumerate(utils)], SCHEMA
    )
    got = idle_streaks(df, limit=3).orderBy("id").collect()
    assert [r.streak for r in got] == [1, 2, 0, 1, 2, 3, 0, 1]
    assert [r.id for r in got if r.alert] == [5]


@pytest.mark.parametrize("hot_rows", [100_000, 1_000, 1])
def test_streaks_match_a_loop(spark, hot_rows):
    rows = samples()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = idle_streaks(df, tie=("id",), limit=4, hot_rows=hot_rows)
    assert got.columns == ["device", "ts", "id", "util", "streak", "alert"]
    found = {r.id: r.streak for r in got.collect()}
    assert found == streaks(rows)
    assert got.filter(F.col("alert") != (F.col("streak") == 4)).count() == 0


@pytest.mark.parametrize("hot_rows", [100_000, 100])
def test_streaks_go_on_from_an_initial_value(spark, hot_rows):
    rows = samples(600)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("from", F.when(F.col("device") == "hot", 1000))
    got = {r.id: r.streak for r in idle_streaks(df, tie=("id",), initial="from", hot_rows=hot_rows).collect()}
    plain = streaks(rows)
    first_active = min(i for d, _, i, u in rows if d == "hot" and u != 0)
    for device, _, i, _ in rows:
        assert got[i] == plain[i] + (1000 if device == "hot" and i < first_active else 0)


def test_total_utilisation(spark):
    df = spark.createDataFrame([("h", 1, 0.0), ("h", 1, 3.0), ("h", 2, 0.0), ("h", 2, None), ("h", 3, None)], "host string, ts int, util double")
    got = {r.ts: r.util for r in total_utilisation(df, "host", "ts").collect()}
    assert got == {1: 3.0, 2: 0.0, 3: None}


def test_stream_equals_batch(spark, tmp_path):
    rows = samples(1_500)
    source = str(tmp_path / "in")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        streamed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        stream_idle_streaks(streamed, out, checkpoint, tie=("id",), limit=4).awaitTermination()

    def add(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    add(rows[:400])
    run()
    add(rows[400:900])
    run()
    add(rows[900:])
    run()
    stored = read_idle_streaks(spark, out)
    assert stored.select("batch").distinct().count() == 3
    assert {r.id: r.streak for r in stored.collect()} == streaks(rows)
    assert stored.filter("late").count() == 0

    add(rows[100:120])
    run()
    late = read_idle_streaks(spark, out).filter("late").collect()
    assert sorted(r.id for r in late) == list(range(100, 120))
    assert all(r.streak is None and not r.alert for r in late)
    assert read_idle_streaks(spark, out).count() == 1_520


def test_repeated_batch_gives_the_same_files(spark, tmp_path):
    """A micro-batch that is run again after its files were written replaces them."""
    rows = samples(900)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run():
        streamed = spark.readStream.schema(SCHEMA).parquet(source)
        stream_idle_streaks(streamed, out, checkpoint, tie=("id",)).awaitTermination()

    for part in (rows[:500], rows[500:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run()
    (tmp_path / "checkpoint" / "commits" / "1").unlink()
    (tmp_path / "checkpoint" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert {r.id: r.streak for r in read_idle_streaks(spark, out).collect()} == streaks(rows)
    assert read_idle_streaks(spark, out).count() == 900


def test_blocks_of_a_sample_a_minute(spark):
    df = spark.range(0, 5_000, 1, 4).select(F.lit("hot").alias("device"), (F.col("id") * 60).alias("ts"))
    hot = skew.hot_hashes(df, ["device"], 500)
    sizes = [r["count"] for r in skew.hot_blocks(df, hot, "device", "ts", 100).groupBy("_block").count().collect()]
    assert max(sizes) <= 200 and 25 <= len(sizes) <= 51


def test_stream_refuses_the_files_of_another_checkpoint(spark, tmp_path):
    rows = samples(60)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(checkpoint):
        streamed = spark.readStream.schema(SCHEMA).parquet(source)
        stream_idle_streaks(streamed, out, str(tmp_path / checkpoint), tie=("id",)).awaitTermination()

    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        run("one")
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        run("two")
    assert read_idle_streaks(spark, out).count() == 60


def test_a_micro_batch_touches_the_state_of_its_own_devices_only(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        streamed = spark.readStream.schema(SCHEMA).parquet(source)
        query = stream_idle_streaks(streamed, out, checkpoint, tie=("id",))
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]

    first = run([(f"d{i}", START, i, 0.0) for i in range(200)])
    assert (first["numRowsUpdated"], first["numRowsTotal"]) == (200, 200)
    second = run([(f"d{i}", START + timedelta(1), i, 0.0) for i in (3, 5)] + [("new", START, 900, 1.0)])
    assert (second["numRowsUpdated"], second["numRowsTotal"]) == (3, 201)
    got = {(r.device, r.batch): r.streak for r in read_idle_streaks(spark, out).collect()}
    assert got["d3", 1] == 2 and got["d7", 0] == 1 and got["new", 1] == 0
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_streamed_samples_come_out_as_they_were(spark, tmp_path):
    """Times with a zone, missing and huge numbers, missing times, order columns of several types."""
    schema = "device struct<a:int,b:string>, ts timestamp, big long, day date, name string, util decimal(5,2), more array<double>"
    big = 2**62 + 1
    rows = [
        ((1, "x"), START, big, START.date(), "é\u2028", Decimal("0.00"), [1.5, None, float("nan")]),
        ((1, "x"), START, None, None, None, Decimal("0.00"), None),
        ((1, "x"), None, 5, None, "b", Decimal("1.25"), []),
        ((1, None), START + timedelta(microseconds=1), -big, START.date(), "", None, [0.1]),
        (None, START, 1, None, "x", Decimal("0.00"), None),
    ]
    df = spark.createDataFrame(rows, schema)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    df.write.parquet(source)
    streamed = spark.readStream.schema(schema).parquet(source)
    tie = ("big", "day", "name")
    stream_idle_streaks(streamed, out, checkpoint, tie=tie, limit=2).awaitTermination()
    got = read_idle_streaks(spark, out).drop("batch")
    want = idle_streaks(df, tie=tie, limit=2).withColumn("late", F.lit(False))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    # The same samples again are all late, whatever is missing in them.
    df.write.mode("append").parquet(source)
    stream_idle_streaks(streamed, out, checkpoint, tie=tie, limit=2).awaitTermination()
    again = read_idle_streaks(spark, out).filter("batch = 1")
    assert again.count() == 5 and again.filter("NOT late OR streak IS NOT NULL OR alert").count() == 0
