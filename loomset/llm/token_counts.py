"""Exact token counts for every context limit from one histogram of document lengths.

Documents are encoded once and only their lengths are aggregated, so what is shuffled is one
count per distinct length and task. Suffix sums over the lengths then answer, for any limit, how
many documents are longer, what all tokens are, and what remains if every document is cut there.

A null or empty text has length 0. Texts of any length count whole. An empty table gives an empty
histogram. Repeated rows count as often as they are there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.bpe import encoder
from loomset.llm.workers import map_batches, texts_of
from loomset.session import materialise

# Lengths are summed by stretches of so many, and the stretches by one task.
STRETCH = 4096


def document_lengths(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``n_tokens, documents`` per batch: the lengths of its texts, already counted."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(0))
        lengths = np.zeros(len(texts), np.int64)
        for i, ids in encoder(path).encode(texts):
            lengths[i] += len(ids)
        found, counts = np.unique(lengths, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array(counts, pa.int64())], ["n_tokens", "documents"]
        )

    return map_batches(
        df.select(F.col(f"`{text}`").alias("text")), work, "n_tokens bigint, documents bigint"
    )


def length_histogram(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``n_tokens, documents``: how many documents have each length."""
    counted = document_lengths(df, path, text)
    return counted.groupBy("n_tokens").agg(F.sum("documents").alias("documents"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For every length that occurs, taken as the context limit:

    ``documents`` of just that length, ``documents_up_to``, ``documents_longer``, ``tokens_longer``
    (all tokens of the longer ones), ``tokens`` (of all documents), ``truncated_tokens`` (of all
    documents, each cut at the limit), ``share_up_to`` (the share of documents that fit, the limit
    being that quantile of the lengths).

    Between two such limits everything is linear, see ``totals_at``.
    """
    tokens = F.col("n_tokens") * F.col("documents")
    # It is used twice, and encoding is the dear part of it.
    histogram = materialise(histogram, "histogram")
    rows = histogram.withColumn("_stretch", F.floor(F.col("n_tokens") / STRETCH))
    stretches = rows.groupBy("_stretch").agg(
        F.sum("documents").alias("_docs"), F.sum(tokens).alias("_tokens")
    )
    after = Window.orderBy(F.col("_stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("_stretch")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    offsets = stretches.select(
        "_stretch",
        F.coalesce(F.sum("_docs").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_tokens").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_docs").over(everything).alias("_all_docs"),
        F.sum("_tokens").over(everything).alias("_all_tokens"),
    )
    inside = (
        Window.partitionBy("_stretch")
        .orderBy(F.col("n_tokens").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    longer = F.col("_docs_after") + F.coalesce(F.sum("documents").over(inside), F.lit(0))
    longer_tokens = F.col("_tokens_after") + F.coalesce(F.sum(tokens).over(inside), F.lit(0))
    found = rows.join(offsets, "_stretch").select(
        "n_tokens",
        "documents",
        longer.alias("documents_longer"),
        longer_tokens.alias("tokens_longer"),
        "_all_docs",
        "_all_tokens",
    )
    return found.select(
        "n_tokens",
        "documents",
        (F.col("_all_docs") - F.col("documents_longer")).alias("documents_up_to"),
        "documents_longer",
        "tokens_longer",
        F.col("_all_tokens").alias("tokens"),
        truncated(F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("_all_docs") - F.col("documents_longer")) / F.col("_all_docs")).alias("share_up_to"),
    )


def truncated(limit: Column) -> Column:
    return F.col("_all_tokens") - F.col("tokens_longer") + limit * F.col("documents_longer")


def totals_at(table: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, documents_longer, truncated_tokens, dropped_tokens`` for any limits.

    Of the rows of ``context_table`` only the last that is not above the limit counts, found by
    an aggregate per limit; below all lengths every document is longer.
    """
    spark = table.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "limit bigint")
    spread = table.select("*", F.explode(F.array(*[F.lit(int(x)) for x in limits])).alias("limit"))
    last = spread.groupBy("limit").agg(
        F.max("tokens").alias("tokens"),
        F.max(F.col("documents_up_to") + F.col("documents_longer")).alias("all"),
        F.max_by(
            F.struct("documents_longer", "tokens_longer"),
            F.when(F.col("n_tokens") <= F.col("limit"), F.col("n_tokens")),
        ).alias("at"),
    )
    longer = F.coalesce(F.col("at.documents_longer"), F.col("all"), F.lit(0))
    longer_tokens = F.coalesce(F.col("at.tokens_longer"), F.col("tokens"), F.lit(0))
    every = F.coalesce("tokens", F.lit(0))
    return wanted.join(last, "limit", "left").select(
        "limit",
        longer.alias("documents_longer"),
        (every - longer_tokens + F.col("limit") * longer).alias("truncated_tokens"),
        (longer_tokens - F.col("limit") * longer).alias("dropped_tokens"),
    )


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """``share, n_tokens``: the least length that at least that share of documents fit into."""
    spread = table.select("*", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    fits = F.when(F.col("share_up_to") >= F.col("share"), F.col("n_tokens"))
    return spread.groupBy("share").agg(F.min(fits).alias("n_tokens"))
