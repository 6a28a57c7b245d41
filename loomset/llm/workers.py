"""Small helpers for code that runs inside Python tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

_HOLDER = "_loomset_worker_state"

# Rows of an Arrow batch that are worked on at a time: bounds what a worker holds, not results.
ROWS_AT_A_TIME = 1024


def per_worker(key: Any, make: Callable[[], Any]) -> Any:
    """``make()``, kept for as long as this Python process lives.

    Functions are shipped by value, so module globals start anew in every task; a model that
    takes a while to load is kept in a module of its own instead.
    """
    holder = sys.modules.setdefault(_HOLDER, ModuleType(_HOLDER))
    state = holder.__dict__.setdefault("state", {})
    if key not in state:
        state[key] = make()
    return state[key]


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType
) -> DataFrame:
    """Apply ``work`` to Arrow batches, a slice at a time. Rows stay in the partitions they are
    in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                out = work(batch.slice(at, ROWS_AT_A_TIME))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column, a null as the empty string."""
    return [text or "" for text in column.to_pylist()]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(
    df: DataFrame, text: str, fields: str, work: Callable[[list[str]], list[pa.Array]]
) -> DataFrame:
    """``df`` with the columns that ``work`` makes of its texts, named and typed by ``fields``.

    Columns of these names are replaced; all others stay as they are, whatever they are called.
    One pass without a shuffle.
    """
    new = _parse_datatype_string(fields)
    replaced = {field.name.lower() for field in new.fields}
    kept = df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in replaced])
    texts = df.select(
        F.col(quoted(text)).alias("text"),
        *[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept.columns)],
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        arrays = [*batch.columns[1:], *work(texts_of(batch.column(0)))]
        return pa.RecordBatch.from_arrays(arrays, names)

    old = [StructField(f"c{i}", f.dataType) for i, f in enumerate(kept.schema.fields)]
    own = [StructField(f"n{i}", f.dataType) for i, f in enumerate(new.fields)]
    names = [f.name for f in [*old, *own]]
    result = map_batches(texts, run, StructType([*old, *own]))
    return result.toDF(*kept.columns, *[f.name for f in new.fields])
