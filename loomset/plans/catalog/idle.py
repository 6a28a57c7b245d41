"""Idle streaks in batch and on streams, and row-local operators on a stream."""

from pyspark.sql import functions as F

from loomset.functions import reward
from loomset.operators import idle
from loomset.plans import inputs
from loomset.plans.catalog.registry import query
from loomset.session import shared_path
from loomset.streaming.idle import read_idle_streaks, stream_idle_streaks


def _streaks_sql(samples):
    return f"""
    SELECT device, event_id, ts, util, CASE WHEN active THEN 0 ELSE row_number() OVER
               (PARTITION BY device, island ORDER BY ts, event_id) - first_active END AS streak
    FROM (SELECT *, CASE WHEN island > 0 THEN 1 ELSE 0 END AS first_active
          FROM (SELECT *, sum(active::INT) OVER (PARTITION BY device ORDER BY ts, event_id
                              ROWS UNBOUNDED PRECEDING) AS island
                FROM (SELECT *, coalesce(util <> 0, true) AS active FROM ({samples}))))"""


STREAKS_SQL = _streaks_sql(inputs.SAMPLES_SQL)

ALERTS_SQL = f"SELECT device, event_id, streak, streak = 3 AS alert FROM ({STREAKS_SQL})"

# What arrives in the first, second and third micro-batch; some early samples come with the third.
HELD = "event_id % 50 = 0 AND ts < DATE '2024-01-11'"
SECOND, THIRD = "ts >= DATE '2024-01-11'", "ts >= DATE '2024-01-21'"
ARRIVALS = (
    f"NOT ({SECOND}) AND NOT ({HELD})",
    f"{SECOND} AND NOT ({THIRD})",
    f"{THIRD} OR ({HELD})",
)

ARRIVED_SQL = f"""
    SELECT s.*, coalesce(({HELD}) AND {{'t': ts, 'e': event_id}} <= last, false) AS late
    FROM ({inputs.SAMPLES_SQL}) s LEFT JOIN (
        SELECT device AS of, max({{'t': ts, 'e': event_id}}) AS last FROM ({inputs.SAMPLES_SQL})
        WHERE NOT ({HELD}) AND NOT ({THIRD}) GROUP BY device) ON device IS NOT DISTINCT FROM of"""


def _streaks(spark, sf_dir):
    return idle.idle_streaks(inputs.samples(spark, sf_dir), tie=("event_id",), limit=3)


@query(ALERTS_SQL)
def idle_streaks(spark, sf_dir):
    return _streaks(spark, sf_dir).select("device", "event_id", "streak", "alert")


@query(ALERTS_SQL)
def idle_streaks_hot(spark, sf_dir):
    """Every device large enough for a block of its own is cut into blocks."""
    samples = inputs.samples(spark, sf_dir)
    streaks = idle.idle_streaks(samples, tie=("event_id",), limit=3, hot_rows=20, block_rows=8)
    return streaks.select("device", "event_id", "streak", "alert")


@query(f"SELECT device, event_id, streak FROM ({STREAKS_SQL}) WHERE streak = 3")
def idle_alerts(spark, sf_dir):
    return _streaks(spark, sf_dir).filter("alert").select("device", "event_id", "streak")


@query(f"""
    SELECT device, count(*) AS samples, sum(util = 0) AS idle FROM (
        SELECT device, ts, sum(util) AS util FROM ({inputs.SAMPLES_SQL}) GROUP BY device, ts)
    GROUP BY device""")
def total_utilisation(spark, sf_dir):
    """Samples of one moment added up, then counted per device."""
    summed = idle.total_utilisation(inputs.samples(spark, sf_dir), "device", "ts")
    return summed.groupBy("device").agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum((F.col("util") == 0).cast("int")).alias("idle"),
    )


@query(f"SELECT device, event_id, streak, alert, false AS late FROM ({ALERTS_SQL})")
def idle_streaks_stream(spark, sf_dir):
    folder = shared_path(spark, "idle")
    streamed = inputs.as_samples(inputs.stream(spark, sf_dir, "events"))
    stream_idle_streaks(
        streamed, f"{folder}/out", f"{folder}/checkpoint", tie=("event_id",), limit=3
    ).awaitTermination()
    return read_idle_streaks(spark, f"{folder}/out").select("device", "event_id", "streak", "alert", "late")


@query(f"""
    SELECT device, event_id, streak, streak = 3 AS alert, false AS late
    FROM ({_streaks_sql(f"SELECT * FROM ({ARRIVED_SQL}) WHERE NOT late")})
    UNION ALL
    SELECT device, event_id, NULL, false, true FROM ({ARRIVED_SQL}) WHERE late""")
def idle_streaks_micro_batches(spark, sf_dir):
    """A stream that is stopped and goes on twice, with samples that come late."""
    folder = shared_path(spark, "idle")
    samples = inputs.samples(spark, sf_dir)
    for arrival in ARRIVALS:
        samples.filter(arrival).write.mode("append").parquet(f"{folder}/in")
        streamed = spark.readStream.schema(samples.schema).parquet(f"{folder}/in")
        stream_idle_streaks(
            streamed, f"{folder}/out", f"{folder}/checkpoint", tie=("event_id",), limit=3
        ).awaitTermination()
    return read_idle_streaks(spark, f"{folder}/out").select("device", "event_id", "streak", "alert", "late")


@query(rf"""
    SELECT o_orderkey, k, CASE WHEN regexp_extract(content, '\\boxed\{{(.*?)\}}', 1)
               = (o_orderkey % 97)::VARCHAR THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS reward
    FROM ({inputs.COMPLETIONS_SQL})""")
def reward_stream(spark, sf_dir):
    """The reward on a stream of completions that carry their reference answer."""
    folder = shared_path(spark, "reward")
    orders = inputs.stream(spark, sf_dir, "orders")
    scored = inputs.as_completions(orders).select(
        "o_orderkey", "k",
        reward.math_reward(F.col("completion"), (F.col("o_orderkey") % 97).cast("string")).alias("reward"),
    )
    (
        scored.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/out")
        .awaitTermination()
    )
    return spark.read.schema("o_orderkey long, k int, reward double").parquet(f"{folder}/out")
