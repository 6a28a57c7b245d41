"""Idle streaks over a stream of samples, equal to the batch result over the same samples."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    IntegralType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from loomset.operators.idle import IDLE_LIMIT
from loomset.operators.skew import check_block_order

# Samples travel through the state operator as text, times in full, so they come out as they were.
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# State is kept by Spark, in the store that follows the keys of a micro-batch and not all keys.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class _Streaks(StatefulProcessor):
    """One device's samples of a micro-batch, in order, going on from its last one.

    The state of a device is its streak and the place (``known`` and ``at`` of each order column)
    of its last sample.
    """

    def __init__(self, place: StructType):
        self._place = place

    def init(self, handle: StatefulProcessorHandle) -> None:
        entered = StructType([StructField("streak", LongType()), *self._place.fields])
        self._last = handle.getValueState("last", entered)

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any
    ) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        samples = pd.concat(frames) if len(frames) > 1 else frames[0]
        row = samples["row"].to_numpy()
        place = [samples[name].to_numpy() for name in self._place.names]
        order = np.lexsort((row, *place[::-1]))
        place = [column[order] for column in place]
        known = self._last.get()
        streak, seen = (known[0], known[1:]) if known else (0, None)
        late = np.zeros(len(order), bool)
        if seen is not None:
            same = np.ones(len(order), bool)
            for column, last in zip(place, seen, strict=True):
                late |= same & (column < last)
                same &= column == last
            late |= same
        in_time = np.flatnonzero(~late)
        at = np.arange(1, len(in_time) + 1)
        idle = samples["idle"].to_numpy()[order][in_time]
        active = np.maximum.accumulate(np.where(idle, 0, at))
        counted = np.full(len(order), -1, np.int64)
        counted[in_time] = np.where(active > 0, at - active, at + streak)
        if len(in_time):
            last = in_time[-1]
            self._last.update((int(counted[last]), *[_plain(column[last]) for column in place]))
        yield pd.DataFrame({"row": row[order], "streak": counted, "late": late})

    def close(self) -> None:
        pass


def _plain(value: Any) -> Any:
    return value.item() if isinstance(value, np.generic) else value


def _sortable(name: str, kind: DataType) -> Column:
    """A column as a value Python sorts just as Spark does; a missing one as a zero."""
    column = F.col(name)
    if isinstance(kind, TimestampType):
        column = F.unix_micros(column)
    elif isinstance(kind, TimestampNTZType):
        days = F.unix_date(column.cast("date")).cast("long")
        minutes = days * 1440 + F.hour(column) * 60 + F.minute(column)
        column = minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")
    elif isinstance(kind, DateType):
        column = F.unix_date(column).cast("long")
    elif isinstance(kind, (IntegralType, BooleanType)):
        column = column.cast("long")
    elif not isinstance(kind, StringType):
        column = column.cast("double")
    return F.coalesce(column, F.lit("") if isinstance(kind, StringType) else F.lit(0))


def count_idle_streaks(
    samples: DataFrame, device: str, ts: str, util: str, tie: tuple[str, ...], limit: int
) -> DataFrame:
    """A stream of samples with ``streak``, ``alert`` and ``late``, by state that Spark keeps per
    device."""
    check_block_order(samples.schema[ts].dataType)
    place: dict[str, Column] = {}
    for i, name in enumerate([ts, *tie]):
        # Missing values come first.
        place[f"known{i}"] = F.col(name).isNotNull()
        place[f"at{i}"] = _sortable(name, samples.schema[name].dataType)
    narrow = samples.select(
        F.to_json(F.struct(device)).alias("device"),
        F.to_json(F.struct(*samples.columns), _JSON).alias("row"),
        F.coalesce(F.col(util) == 0, F.lit(False)).alias("idle"),
        *[column.alias(name) for name, column in place.items()],
    )
    state = StructType([narrow.schema[name] for name in place])
    counted = narrow.groupBy("device").transformWithStateInPandas(
        _Streaks(state), "row string, streak long, late boolean", "Append", "None"
    )
    streak = F.when(~F.col("late"), F.col("streak"))
    return counted.select(
        F.from_json("row", samples.schema, _JSON).alias("row"), streak.alias("streak"), "late"
    ).select(
        "row.*", "streak", F.coalesce(F.col("streak") == limit, F.lit(False)).alias("alert"), "late"
    )


def stream_idle_streaks(
    samples: DataFrame,
    out: str,
    checkpoint: str,
    device: str = "device",
    ts: str = "ts",
    util: str = "util",
    tie: tuple[str, ...] = (),
    limit: int = IDLE_LIMIT,
    available_now: bool = True,
) -> StreamingQuery:
    """Write each micro-batch with ``streak``, ``alert`` and ``late`` to ``out``.

    What passes from one micro-batch to the next is the state of each device, its streak and the
    place of its last sample, in Spark's RocksDB state store: a micro-batch reads and writes only
    the devices it has samples of. A sample at or before that place is written with ``late`` set and
    no streak. The samples of one device in one micro-batch are counted together; the limits of
    the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``) bound them.

    A micro-batch that is run again starts from the same state and replaces its own files. A new
    checkpoint over an ``out`` that an earlier one went on with is refused.
    """
    spark = samples.sparkSession

    def written(batch: int) -> str:
        return f"{out.rstrip('/')}/batch={batch}"

    def refuse_earlier(spark: SparkSession) -> None:
        """The first micro-batch of a checkpoint replaces no files but its own."""
        try:
            spark.read.schema("late boolean").parquet(written(1))
        except AnalysisException:
            return
        raise ValueError(f"{out} has the files of another checkpoint")

    def write(batch_df: DataFrame, batch: int) -> None:
        if batch == 0:
            refuse_earlier(batch_df.sparkSession)
        batch_df.write.mode("overwrite").parquet(written(batch))

    counted = count_idle_streaks(samples, device, ts, util, tie, limit)
    writer = counted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    before = {name: spark.conf.get(name, None) for name in _STATE_STORE}
    try:
        # A query keeps the settings it was started with.
        for name, value in _STATE_STORE.items():
            spark.conf.set(name, value)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def read_idle_streaks(spark: SparkSession, out: str) -> DataFrame:
    """Everything a stream has written so far."""
    return spark.read.option("basePath", out).parquet(f"{out.rstrip('/')}/batch=*")
