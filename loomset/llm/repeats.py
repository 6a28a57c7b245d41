"""Repeated passages by prefix-partitioned suffix trees.

A window is a fixed number of consecutive words of one text. Its anchor is the start of that
stretch of ``PREFIX`` words in it whose hash is least, so equal windows have their anchor at the
same place. Windows that follow each other mostly share their anchor, so a text has far fewer
anchors than words, and the suffixes at windows of one anchor travel together, as one row that
spells them in symbols of one window each.

The words at the anchor are the prefix that splits the suffixes into groups. A prefix that occurs
once cannot begin a repeat, and its suffixes are never shuffled. A prefix with more suffixes than
a task should hold is lengthened to the whole window; the suffixes of one that is still too many are
dealt to several tasks, of which each keeps the first of every window, and these meet once more.

Each group is a subtree: its suffixes are sorted by their symbols, with their common lengths.
Inner nodes of that tree lie at least one window deep, so every one of them is a repeat. The first
leaf below a node is its first occurrence; every other one is a window that starts earlier, too.

Documents come in the order of their ids, nulls last, those of one id in the order of a hash of
their text; rows with equal id and text are one document and get equal rows. A null or empty text
has no words, a text with fewer words than a window loses none. Texts of any length are read whole.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.bitmaps import bitmap_of, contains
from loomset.llm.words import Words, counted, find_words, in_portions, mix, text_bytes
from loomset.llm.workers import quoted
from loomset.session import materialise

WINDOW = 20
# Words at an anchor.
PREFIX = 6
# Suffix rows of a prefix that one task should hold.
GROUP = 2048
# Bytes of text that are worked on together.
PORTION = 8 << 20

_FOLD = bytes(0x20 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in range(256))
_FACTORS = np.random.default_rng(2953).integers(1, 1 << 62, PREFIX, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BASE_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
# The lower bits of what is compared to find an anchor are its position.
_PLACES = np.uint64((1 << 28) - 1)


class _Texts(NamedTuple):
    """Words of some texts: folded bytes, words, the text of each word, the first word of each."""

    raw: bytes
    words: Words
    owner: np.ndarray
    first: np.ndarray


def _read(column: pa.Array) -> _Texts:
    texts = text_bytes(column)
    raw = b" ".join(texts).translate(_FOLD)
    words = find_words(raw, np.frombuffer(raw, np.uint8) != 0x20)
    ends = np.cumsum([len(text) + 1 for text in texts])
    owner = np.searchsorted(ends, words.starts, side="right")
    return _Texts(raw, words, owner, np.searchsorted(owner, np.arange(len(texts) + 1)))


def window_symbols(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words that follow each other."""
    n = len(hashes)
    powers, inverse = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    powers[:1] = inverse[:1] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers, out=running[1:])
    return mix((running[size:] - running[:-size]) * inverse[: n - size + 1])


class _Suffixes(NamedTuple):
    """Rows of windows that follow each other and share an anchor: the text, the first window's
    word, how many windows, the prefix at the anchor, and the symbols of all windows."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    prefix: np.ndarray
    symbols: np.ndarray


def anchored(texts: _Texts, window: int) -> _Suffixes | None:
    """The suffixes of all windows, by anchor."""
    hashes, owner = texts.words.hashes, texts.owner
    n = len(hashes) - window + 1
    whole = np.flatnonzero(owner[:n] == owner[window - 1 :]) if n > 0 else ()
    if not len(whole):
        return None
    grams = np.zeros(len(hashes) - PREFIX + 1, np.uint64)
    for i in range(PREFIX):
        grams += hashes[i : len(grams) + i] * _FACTORS[i]
    grams = mix(grams)
    least = grams & ~_PLACES | np.arange(len(grams), dtype=np.uint64)
    reach, wide = 1, window - PREFIX + 1
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    anchor = (least & _PLACES)[whole]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[whole[1:]] != owner[whole[:-1]]))
    first = np.flatnonzero(new)
    at = whole[first]
    return _Suffixes(
        owner[at],
        at - texts.first[owner[at]],
        np.diff(np.append(first, len(whole))),
        grams[anchor[first]],
        window_symbols(hashes, window)[whole],
    )


def prefix_counts(documents: DataFrame, window: int) -> DataFrame:
    """``key, n``: how many suffix rows begin with each prefix."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches, 0, PORTION):
            found = anchored(_read(batch.column(0)), window)
            if found:
                first, n = counted(found.prefix)
                keys = found.prefix[first].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    rows = documents.select("text").mapInArrow(count, "key bigint, n bigint")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def suffix_rows(
    documents: DataFrame, window: int, repeated: Broadcast, large: Broadcast, tasks: int
) -> DataFrame:
    """``prefix, deal, id, tie, start, symbols`` of suffixes whose prefix is ``repeated``; those of
    ``large`` ones by window, dealt to ``tasks`` numbers from 1 on. ``deal`` is 0 for the others."""
    kind = documents.schema["id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches, 0, PORTION):
            found = anchored(_read(batch.column(0)), window)
            if not found:
                continue
            text, start, count, prefix, symbols = found
            first = np.cumsum(count) - count
            wanted = contains(repeated.value, prefix)
            crowded = wanted & contains(large.value, prefix)
            alone = wanted & ~crowded
            # Windows of large prefixes stand by themselves, under the whole window's hash.
            row = np.repeat(np.flatnonzero(crowded), count[crowded])
            place = np.arange(len(row)) - np.repeat(np.cumsum(count[crowded]) - count[crowded], count[crowded])
            own = symbols[first[row] + place]
            starts = np.concatenate([start[alone], start[row] + place])
            texts = np.concatenate([text[alone], text[row]])
            dealt = mix(starts.astype(np.uint64) + mix(batch.column(2).to_numpy().view(np.uint64))[texts])
            deal = (dealt % np.uint64(tasks)).astype(np.int32) + 1
            deal[: int(alone.sum())] = 0
            spelled = symbols[np.repeat(alone, count)]
            lengths = np.concatenate([count[alone], np.ones(len(own), np.int64)])
            offsets = np.append(0, np.cumsum(lengths * 8)).astype(np.int32)
            data = np.concatenate([spelled, own]).tobytes()
            at = pa.array(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([prefix[alone], mix(own ^ prefix[row])]).view(np.int64)),
                    pa.array(deal),
                    batch.column(1).take(at),
                    batch.column(2).take(at),
                    pa.array(starts.astype(np.int32)),
                    pa.Array.from_buffers(
                        pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
                    ),
                ],
                ["prefix", "deal", "id", "tie", "start", "symbols"],
            )

    schema = f"prefix bigint, deal int, id {kind.simpleString()}, tie bigint, start int, symbols binary"
    return documents.select("text", "id", "tie").mapInArrow(rows, schema)


def subtree(symbols: np.ndarray, leaf: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a group sorted by their symbols, and how many symbols each has in common
    with the one before it.

    A suffix begins at each symbol and goes on to the ``last`` one of its row. Suffixes that agree
    to the end of one of them stay in the order of ``leaf``.
    """
    order = np.lexsort((leaf, symbols))
    common = np.zeros(len(order), np.int64)
    left, right = order[:-1].copy(), order[1:].copy()
    open_ = np.arange(1, len(order))
    while len(open_):
        same = symbols[left] == symbols[right]
        open_, left, right = open_[same], left[same], right[same]
        common[open_] += 1
        inside = (left < last[left]) & (right < last[right])
        open_, left, right = open_[inside], left[inside] + 1, right[inside] + 1
    return order, common


def _later(table: pa.Table) -> pa.RecordBatch:
    """``id, tie, start, mask, prefix`` of groups of suffix rows, which come in the order of
    documents: a bit of the mask for each window with an earlier occurrence. Rows of dealt windows
    that are the first of their task come with mask 0 and their prefix."""
    content = table.column("symbols").combine_chunks().to_pylist()
    count = np.array([len(x) // 8 for x in content])
    symbols = np.frombuffer(b"".join(content), np.uint64)
    deal = table.column("deal").to_numpy()
    row = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    place = np.arange(len(row)) - first[row]
    # Tasks that share a window are trees of their own.
    apart = symbols + deal.astype(np.uint64)[row] * _BASE
    order, common = subtree(apart, np.arange(len(row)), (first + count - 1)[row])
    # An inner node is a stretch of suffixes with at least one symbol in common.
    top = np.maximum.accumulate(np.where(common == 0, np.arange(len(order)), 0))
    head = order[top]
    # A row that is there twice is one occurrence.
    start = table.column("start").to_numpy()
    tie = table.column("tie").to_numpy()
    ids = table.column("id").combine_chunks().dictionary_encode()
    ids = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    a, b = row[order], row[head]
    itself = (ids[a] == ids[b]) & (tie[a] == tie[b]) & (start[a] == start[b]) & (place[order] == place[head])
    later = np.zeros(len(row), bool)
    later[order] = ~itself
    mask = np.bincount(row, weights=later * np.exp2(place), minlength=len(count)).astype(np.int64)
    kept = np.flatnonzero((mask > 0) | (deal > 0))
    at = pa.array(kept)
    met = pa.array((deal[kept] > 0) & (mask[kept] == 0))
    return pa.RecordBatch.from_arrays(
        [
            *[table.column(name).combine_chunks().take(at) for name in ("id", "tie", "start")],
            pa.array(mask[kept]),
            pc.if_else(met, table.column("prefix").combine_chunks().take(at), None),
        ],
        ["id", "tie", "start", "mask", "prefix"],
    )


def later_windows(suffixes: DataFrame) -> DataFrame:
    """``id, tie, start, mask, prefix`` as ``_later`` gives them, for all groups."""
    kind = suffixes.schema["id"].dataType.simpleString()

    def group_of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return table.column("prefix").to_numpy(), table.column("deal").to_numpy()

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, deal = group_of(batch)
            # The last group may go on in the next batch.
            differs = np.flatnonzero((prefix != prefix[-1]) | (deal != deal[-1]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if held and (cut or (prefix[0], deal[0]) != last):
                yield _later(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield _later(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
            last = (prefix[-1], deal[-1])
        if held:
            yield _later(pa.Table.from_batches(held))

    ordered = suffixes.repartition("prefix", "deal").sortWithinPartitions(
        "prefix", "deal", F.asc_nulls_last("id"), "tie", "start"
    )
    return ordered.mapInArrow(
        trees, f"id {kind}, tie bigint, start int, mask bigint, prefix bigint"
    )


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(quoted(text)), F.lit(""))
    return df.select(content.alias("text"), F.col(quoted(key)).alias("id"), F.xxhash64(content).alias("tie"))


def repeated_windows(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, tie, start, mask``: windows that also start earlier, the bit of 2^i for the one at
    word ``start`` + i. ``documents`` has ``text, id, tie``."""
    if window < PREFIX:
        raise ValueError(f"a window has at least {PREFIX} words")
    if window - PREFIX + 1 > 50:
        raise ValueError(f"a window has at most {PREFIX + 49} words")
    prefixes = materialise(prefix_counts(documents, window).filter(F.col("n") > 1), "prefixes")
    most = prefixes.agg(F.max("n").alias("n")).first().n or 0
    large = prefixes.filter(F.col("n") > GROUP)
    suffixes = suffix_rows(
        documents, window, bitmap_of(prefixes), bitmap_of(large), max(1, -(-most // GROUP))
    )
    found = materialise(later_windows(suffixes), "windows")
    # The first ones of each task meet: no more of a window than tasks it was dealt to.
    same = Window.partitionBy("prefix").orderBy(F.asc_nulls_last("id"), "tie", "start")
    occurrence = F.struct("id", "tie", "start")
    met = (
        found.filter(F.col("prefix").isNotNull())
        .select("id", "tie", "start", F.lit(1).cast("bigint").alias("mask"), "prefix")
        .withColumn("head", F.first(occurrence).over(same))
        .filter(~occurrence.eqNullSafe(F.col("head")))
    )
    columns = ["id", "tie", "start", "mask"]
    return found.filter(F.col("mask") > 0).select(*columns).unionByName(met.select(*columns))


def _with_windows(documents: DataFrame, window: int) -> DataFrame:
    windows = (
        repeated_windows(documents, window)
        .groupBy("id", "tie")
        .agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))
        .toDF("of", "of_tie", "starts", "masks")
    )
    return documents.join(
        windows, F.col("id").eqNullSafe(F.col("of")) & (F.col("tie") == F.col("of_tie")), "left"
    ).select("text", "id", "starts", "masks")


def _covered(texts: _Texts, batch: pa.RecordBatch, window: int) -> np.ndarray:
    """Whether each word lies in a window with an earlier occurrence."""
    starts, masks = (batch.column(i) for i in (2, 3))
    lengths = np.array(pc.fill_null(pc.list_value_length(starts), 0))
    begin = starts.flatten().to_numpy() + np.repeat(texts.first[:-1], lengths)
    bits = masks.flatten().to_numpy()
    edges = np.zeros(len(texts.owner) + 1, np.int64)
    for i in range(window - PREFIX + 1):
        at = begin[bits >> i & 1 == 1] + i
        np.add.at(edges, at, 1)
        np.add.at(edges, at + window, -1)
    return np.cumsum(edges[:-1]) > 0


def _kept_texts(texts: _Texts, covered: np.ndarray) -> list[bytes]:
    """The words of each text that are not covered, with one space between them."""
    starts, ends, _ = texts.words
    kept = np.flatnonzero(~covered)
    edges = np.zeros(len(texts.raw) + 2, np.int8)
    edges[starts[kept]] += 1
    edges[ends[kept] + 1] -= 1
    data = np.append(np.frombuffer(texts.raw, np.uint8), np.uint8(0x20))
    compact = data[np.cumsum(edges[:-1], dtype=np.int8) > 0].tobytes()
    sizes = np.bincount(texts.owner[kept], weights=ends[kept] - starts[kept] + 1, minlength=len(texts.first) - 1)
    after = np.cumsum(sizes).astype(np.int64).tolist()
    return [compact[a:b].rstrip(b" ") for a, b in zip([0, *after], after, strict=False)]


def repeat_digests(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``key, n_words, n_removed, kept_sha256`` for every row."""
    kind = df.schema[key].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches, 0, PORTION):
            texts = _read(batch.column(0))
            covered = _covered(texts, batch, window)
            removed = np.bincount(texts.owner[covered], minlength=batch.num_rows)
            kept = [hashlib.sha256(x).hexdigest() for x in _kept_texts(texts, covered)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(np.diff(texts.first)), pa.array(removed), pa.array(kept)],
                ["id", "n_words", "n_removed", "kept_sha256"],
            )

    found = _with_windows(_documents(df, key, text), window).mapInArrow(
        digest, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    )
    return found.withColumnRenamed("id", key)


def repeated_spans(
    df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``key, start, n_words, span``: every longest stretch of words that earlier windows cover."""
    kind = df.schema[key].dataType.simpleString()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches, 0, PORTION):
            texts = _read(batch.column(0))
            covered = _covered(texts, batch, window)
            new = np.append(True, (covered[1:] != covered[:-1]) | (texts.owner[1:] != texts.owner[:-1]))
            first = np.flatnonzero(new[: len(covered)])
            after = np.append(first[1:], len(covered))
            first, after = first[covered[first]], after[covered[first]]
            found = [texts.raw[a:b] for a, b in zip(texts.words.starts[first], texts.words.ends[after - 1], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1).take(pa.array(texts.owner[first])),
                    pa.array(first - texts.first[texts.owner[first]]),
                    pa.array(after - first),
                    pa.array([b" ".join(x.split()) for x in found], pa.binary()).cast(pa.string()),
                ],
                ["id", "start", "n_words", "span"],
            )

    found = _with_windows(_documents(df, key, text), window).mapInArrow(
        spans, f"id {kind}, start bigint, n_words bigint, span string"
    )
    return found.withColumnRenamed("id", key)
