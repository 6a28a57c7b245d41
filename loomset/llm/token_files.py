"""Token ids in files: frequency-ranked, byte-aligned, with control bytes apart from the data.

Ids are replaced by their rank by frequency over the whole corpus, so most ids fit into one byte.
Each rank takes 1 to 4 bytes. Two control bits per id say how many, and the control bytes of a
block stand before its data bytes, so a reader finds all positions by a running sum and gathers
bytes without a branch; four ids are looked up at once, by their control byte.

A file holds blocks of whole documents in ascending order of key; a block is one row of a Parquet
file: the number of its part, the tokens before it there, keys and token counts of its documents,
control bytes and data bytes. Ranks are stored beside the blocks. Parquet gives atomic commits per task
and works in any store that Spark writes to.

Nulls and empty texts hold the end id only. Documents of any size are kept whole: one that is
longer than a block makes a block of its own. Rows without a key come first; rows that repeat a
key follow each other, in the order of their ids' hash. An empty table gives files without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.bpe import encode_texts, vocabulary
from loomset.llm.workers import map_batches, per_worker, texts_of

BLOCK_TOKENS = 1 << 18


# --- coding ---------------------------------------------------------------------------------------


def byte_lengths(ranks: np.ndarray) -> np.ndarray:
    return (
        1
        + (ranks > 0xFF).astype(np.uint8)
        + (ranks > 0xFFFF).astype(np.uint8)
        + (ranks > 0xFFFFFF).astype(np.uint8)
    )


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes. Ranks are below 2^32; little-endian, least bytes first."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    sizes = byte_lengths(ranks)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < sizes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each control byte: the lengths of its four ids, and their sum."""
    codes = np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3
    lengths = codes + 1
    return lengths, lengths.sum(axis=1)


_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks of a block, by table lookup of the control bytes."""
    lengths, sums = per_worker("control bytes", _tables)
    codes = np.frombuffer(control, np.uint8)
    sizes = lengths[codes]
    before = np.zeros(len(codes), np.int64)
    np.cumsum(sums[codes[:-1]], out=before[1:])
    inside = np.zeros_like(sizes, dtype=np.int64)
    np.cumsum(sizes[:, :3], axis=1, out=inside[:, 1:])
    at = (before[:, None] + inside).reshape(-1)[:count]
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    words = (
        padded[at] | padded[at + 1] << 8 | padded[at + 2] << 16 | padded[at + 3] << 24
    )
    return words & _MASKS[sizes.reshape(-1)[:count] - 1]


# --- writing --------------------------------------------------------------------------------------


def encode_corpus(df: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """``key, ids, hash``: ids with the end id, two or four bytes each, and a hash to order by."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = np.dtype(vocabulary(path).id_type)
        end = np.array([end_id], kind)
        ids = [
            np.concatenate([x, end]).astype(kind.newbyteorder("<")).tobytes()
            for x in encode_texts(texts_of(batch.column(1)), path)
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary())], ["key", "ids"]
        )

    kind = df.schema[key].dataType.simpleString()
    encoded = map_batches(
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")),
        work,
        f"key {kind}, ids binary",
    )
    return encoded.withColumn("hash", F.xxhash64("ids"))


def count_ids(encoded: DataFrame, size: int, kind: str) -> DataFrame:
    """``id, n``: how often each id occurs. Each task sends its counts once, at most one row per
    id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), pa.array(counts[found])], ["id", "n"]
        )

    counted = encoded.select("ids").mapInArrow(count, "id bigint, n bigint")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(
    df: DataFrame,
    out: str,
    path: str,
    end_id: int = 0,
    key: str = "doc_id",
    text: str = "text",
    partitions: int | None = None,
) -> None:
    """Encode every text and write it with its end id to ``out``, in ascending order of key.

    Texts are encoded once, to ``out/encoded``. Their ids are counted from there, ranked, and
    ordered by a range partitioning, in which equal keys are spread by their hash.
    """
    spark = df.sparkSession
    encode_corpus(df, path, end_id, key, text).write.option("compression", "zstd").parquet(
        f"{out}/encoded"
    )
    encoded = spark.read.parquet(f"{out}/encoded")
    words = vocabulary(path)
    kind = np.dtype(words.id_type).newbyteorder("<").str
    size = words.size

    # One count per id of the vocabulary, whatever the corpus holds.
    ranked = count_ids(encoded, size, kind).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([row.id for row in ranked], np.uint32)
    spark.createDataFrame(
        [(rank, row.id, row.n) for rank, row in enumerate(ranked)], "rank bigint, id bigint, n bigint"
    ).coalesce(1).write.parquet(f"{out}/ranks")
    rank_of = np.zeros(size, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    key_type = encoded.schema["key"].dataType

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        keys, sizes, ids, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            control, data = encode_ranks(rank_of[np.concatenate(ids)])
            row = {
                "part": part,
                "before": before,
                "keys": keys,
                "sizes": sizes,
                "tokens": total,
                "control": control,
                "data": data,
            }
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema(
                    [
                        ("part", pa.int32()),
                        ("before", pa.int64()),
                        ("keys", pa.list_(batch.schema.field("key").type)),
                        ("sizes", pa.list_(pa.int64())),
                        ("tokens", pa.int64()),
                        ("control", pa.binary()),
                        ("data", pa.binary()),
                    ]
                )
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(raw.as_buffer(), kind)
                if keys and total + len(own) > BLOCK_TOKENS:
                    yield block()
                    before += total
                    keys, sizes, ids, total = [], [], [], 0
                keys.append(k)
                sizes.append(len(own))
                ids.append(own)
                total += len(own)
        if keys:
            yield block()

    tasks = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.repartitionByRange(tasks, "key", "hash").sortWithinPartitions("key", "hash")
    ordered.select("key", "ids").mapInArrow(
        blocks,
        f"part int, before bigint, keys array<{key_type.simpleString()}>, sizes array<bigint>, "
        "tokens bigint, control binary, data binary",
    ).write.option("compression", "none").parquet(f"{out}/blocks")


# --- reading --------------------------------------------------------------------------------------


def read_ranks(spark: SparkSession, out: str) -> np.ndarray:
    """Ids by rank: at most the vocabulary."""
    rows = spark.read.parquet(f"{out}/ranks").orderBy("rank").collect()
    return np.array([row.id for row in rows], np.uint32)


def read_tokens(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """From the files of ``write_tokens``: ``key, start, n_tokens, ids_crc32`` per document, and
    ``ids``, unsigned 32-bit little-endian, on request.

    ``start`` counts the ids of all documents before: of the parts before, of the part's blocks
    before, of the documents before in the block. Parts are as many as tasks have written, and
    only their sums are added up at one place.
    """
    by_rank = read_ranks(spark, out)
    blocks = spark.read.parquet(f"{out}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for row in parts:
        before[row.part] = total
        total += row.n
    key_type = blocks.schema["keys"].dataType.elementType

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[decode_ranks(row["control"], row["data"], row["tokens"])].astype("<u4")
                sizes = np.array(row["sizes"], np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                pieces = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                arrays = [
                    pa.array(row["keys"], batch.schema.field("keys").type.value_type),
                    pa.array(starts + before[row["part"]] + row["before"]),
                    pa.array(sizes),
                    pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                ]
                if with_ids:
                    arrays.append(pa.array(pieces, pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["key", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = f"key {key_type.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint"
    return blocks.mapInArrow(decode, schema + ", ids binary" * with_ids)
