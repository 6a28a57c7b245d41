"""Bounded samples of labelled documents to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a sample, and the longest text in it: both bound what the driver receives when a model
# is fitted. What the model then scores is never bounded.
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 20_000


def held_out(key: str = "doc_id"):
    """True for the third of the documents that no model is fitted on."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(
    documents: DataFrame,
    labels: DataFrame,
    *names: str,
    rows: int = SAMPLE_ROWS,
    chars: int = SAMPLE_CHARS,
) -> list:
    """At most ``rows`` rows ``doc_id, text, *names`` with every label known, by hash order of
    ``doc_id``, none of them held out. The sample depends on the tables' content only."""
    usable = F.col("text").isNotNull() & (F.length("text") <= chars)
    texts = documents.select("doc_id", "text").filter(usable)
    known = labels.select("doc_id", *names).dropna().filter(~held_out())
    # Labels of documents that are not there would use up the bound.
    chosen = (
        known.join(texts.select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(*[F.min(name).alias(name) for name in names])
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # The sample is bounded, so it may go to every task.
    found = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return sorted(found.collect(), key=lambda row: row.doc_id)
