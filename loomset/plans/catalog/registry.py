from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        CATALOG[run.__name__] = Query(run, sql)
        return run

    return add
