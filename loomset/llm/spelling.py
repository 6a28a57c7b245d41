"""Spelling variants by an index of variable-length grams.

Words come from the runs of letters of all texts; two are near if one code point was inserted,
deleted or replaced. To find them, a word is written between ``^`` and ``$`` and decomposed into one gram
per position: the shortest that is rare, at least ``SHORTEST`` and at most ``LONGEST`` characters.
Which grams are frequent, and so are lengthened, is the gram dictionary, pruned to what occurs more
often than a share of all grams that bounds its size.

A gram depends on its own characters only, so an edit changes just the grams that reach over it.
The most that one edit can reach is a word's affected-gram bound b. Of the grams that
two near words have in common the rarest one is among the b + 1 rarest of each, and it stands at the
same distance from the start of both words or from their end. So a word is entered in the lists of
its b + 1 rarest grams only, by distance and length; with grams of at most four characters a word of
five has more grams than b, so there always is one. Lists are merged in tasks, where long ones meet
in blocks, and each pair in a list is verified: first by which letters occur an odd number of times,
then by its characters.

A null or empty text has no words; a null id is written as nothing. Texts and words of any length
count whole. Repeated rows count as often as they are there. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.words import counted, find_words, gathered, in_portions, lower_case, text_bytes
from loomset.llm.workers import quoted
from loomset.session import materialise

LEAST_LENGTH = 5
LEAST_COUNT = 3
# One word occurrence in so many loses a character.
DAMAGED = 97
# A form is at least so many times as frequent.
TIMES = 2

SHORTEST, LONGEST = 2, 4
# A gram is frequent if more words than this have it, and more than one gram in GRAMS.
RARE = 100
GRAMS = 200_000
# Words of a list that meet each other in one task.
BLOCK = 2048
# Long lists that may go to every task; more are joined by shuffles.
BROADCAST_LISTS = 100_000
# Pairs that are compared at a time, and characters of longer words.
PAIRS = 1 << 19
CELLS = 1 << 24
PORTION = 8 << 20

_FOLD = bytes(lower_case(b) for b in range(256))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each stretch of bytes, going on from the crc32 of what stands ``before`` it."""
    table = _crc_table()
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, state = starts[order], before[order] ^ np.uint32(0xFFFFFFFF)
    # So many words have more than i bytes.
    longer = len(order) - np.cumsum(np.bincount(lengths)) if len(order) else lengths
    for i, n in enumerate(longer.tolist()):
        if n < 16:
            break
        byte = raw[at[:n] + i]
        state[:n] = table[(state[:n] ^ byte) & 0xFF] ^ (state[:n] >> 8)
    found = np.empty(len(order), np.uint32)
    found[order] = state ^ np.uint32(0xFFFFFFFF)
    done = i if len(order) else 0
    for j in np.flatnonzero(lengths > done):
        found[j] = zlib.crc32(raw[starts[j] + done : ends[j]], int(found[j]))
    return found


def _without(word: bytes, crc: int) -> str:
    text = word.decode()
    at = crc % len(text)
    return text[:at] + text[at + 1 :]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of at least ``LEAST_LENGTH`` letters with ``LEAST_COUNT`` occurrences."""
    named = df.select(
        F.col(quoted(text)).alias("text"),
        F.concat(F.coalesce(F.col(quoted(key)).cast("string"), F.lit("")), F.lit(":")).alias("id"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_portions(batches, 0, PORTION):
            texts = text_bytes(batch.column(0))
            raw = b"\n".join(texts).translate(_FOLD)
            data = np.frombuffer(raw, np.uint8)
            # U+00C0 to U+00FF are 0xC3 and one more byte.
            lead = data == 0xC3
            inside = (data >= 0x61) & (data <= 0x7A) | lead
            inside[1:] |= lead[:-1]
            starts, ends, hashes = find_words(raw, inside)
            before = np.array([zlib.crc32(x) for x in text_bytes(batch.column(1))], np.uint32)
            owner = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), starts, side="right")
            crc = crc32_of(data, starts, ends, before[owner])
            damaged = crc % DAMAGED == 0
            leads = np.append(0, np.cumsum(lead, dtype=np.int32))
            letters = ends - starts - (leads[ends] - leads[starts])
            changed = Counter(
                _without(raw[starts[i] : ends[i]], int(crc[i]))
                for i in np.flatnonzero(damaged & (letters > LEAST_LENGTH))
            )
            whole = np.flatnonzero(~damaged & (letters >= LEAST_LENGTH))
            first, n = counted(hashes[whole])
            at = whole[first]
            yield pa.RecordBatch.from_arrays([gathered(data, starts[at], ends[at]), pa.array(n)], ["word", "n"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(changed), pa.string()), pa.array(list(changed.values()), pa.int64())], ["word", "n"]
            )

    rows = named.mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """The grams that are frequent, with their number: at most ``GRAMS`` of each length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for word in batch.column(0).to_pylist():
                marked = f"^{word}$"
                for size in range(SHORTEST, LONGEST + 1):
                    found.update(marked[i : i + size] for i in range(len(marked) - size + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "n"]
            )

    rows = words.select("word").mapInArrow(count, "gram string, n bigint")
    grams = materialise(rows.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    size = F.length("gram")
    limits = grams.groupBy(size.alias("size")).agg(
        F.greatest(F.lit(RARE), F.floor(F.sum("n") / GRAMS)).alias("limit")
    )
    limit = {row.size: row.limit for row in limits.collect()}
    frequent = F.lit(False)
    for length, least in limit.items():
        frequent = frequent | ((size == length) & (F.col("n") > least))
    return {row.gram: row.n for row in grams.filter(frequent).toLocalIterator()}


def decompose(word: str, dictionary: dict[str, int]) -> list[str]:
    """The gram at every position of a word: lengthened as long as it is frequent."""
    marked = f"^{word}$"
    grams = []
    for at in range(len(marked) - 1):
        end = at + SHORTEST
        while end < min(at + LONGEST, len(marked)) and marked[at:end] in dictionary:
            end += 1
        grams.append(marked[at:end])
    return grams


def affected(grams: list[str]) -> int:
    """The most grams that one edit within the word can reach."""
    most = 0
    for place in range(1, len(grams)):
        reach = range(max(0, place - LONGEST + 1), place + 1)
        most = max(most, sum(at + len(grams[at]) > place for at in reach))
    return most


def signature(word: str, dictionary: dict[str, int]) -> list[tuple[int, str]]:
    """Position and gram of those by which a word is found."""
    grams = decompose(word, dictionary)
    # Rare grams come first, and all that are not in the dictionary are alike.
    ranked = sorted(range(len(grams)), key=lambda i: (dictionary.get(grams[i], 0), grams[i], i))
    return [(i, grams[i]) for i in ranked[: affected(grams) + 1]]


def listed(words: DataFrame, dictionary: Broadcast) -> DataFrame:
    """``gram, side, place, size, word, n``: the entries of all words. A list holds words of
    ``size`` and ``size`` + 1 letters."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entries = []
            rows = zip(*(column.to_pylist() for column in batch.columns), strict=True)
            for word, n in rows:
                length = len(word)
                for at, gram in signature(word, dictionary.value):
                    for size in (length - 1, length):
                        entries.append((gram, 0, at, size, word, n))
                        entries.append((gram, 1, length - at, size, word, n))
            columns = list(zip(*entries, strict=True)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["gram", "side", "place", "size", "word", "n"],
            )

    rows = words.select("word", "n").mapInArrow(
        enter, "gram string, side int, place int, size int, word string, n bigint"
    )
    return rows.select(F.xxhash64("gram", "side", "place", "size").alias("list"), "side", "size", "word", "n")


def _in_blocks(entries: DataFrame) -> DataFrame:
    """Entries with ``one, two, own``: lists of more than ``BLOCK`` words are cut into blocks, and
    every two blocks meet. ``entries`` is read twice."""
    long = materialise(
        entries.groupBy("list")
        .agg(F.count(F.lit(1)).alias("entries"))
        .filter(F.col("entries") > BLOCK)
        .select("list", F.ceil(F.col("entries") / BLOCK).cast("int").alias("blocks")),
        "long-lists",
    )
    if long.count() <= BROADCAST_LISTS:
        long = F.broadcast(long)
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    return (
        entries.join(long, "list", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "list",
            F.least("own", "other").alias("one"),
            F.greatest("own", "other").alias("two"),
            "own",
            "side",
            "size",
            "word",
            "n",
        )
    )


def _near(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether code points of words, padded with zeros, of the same length or with ``right`` one
    longer, differ by one edit."""
    short, long = (left > 0).sum(1), (right > 0).sum(1)
    width = left.shape[1]
    same = left == right
    inside = np.arange(width) < short[:, None]
    replaced = (same | ~inside).sum(1) == width - 1
    before = np.where((same | ~inside).all(1), width, (~same & inside).argmax(1))
    before = np.minimum(before, short)
    shifted = left[:, : width - 1] == right[:, 1:]
    from_edit = np.arange(width - 1) >= before[:, None]
    inserted = (shifted | ~from_edit | ~inside[:, : width - 1]).all(1)
    return np.where(short == long, replaced, (long == short + 1) & inserted)


def _pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of near words, by lists that come one after the other."""
    lists, one, two, own, side, size = (table.column(i).to_numpy() for i in range(6))
    words = table.column(6).to_pylist()
    n = len(words)
    change = (lists[1:] != lists[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    end = np.append(np.flatnonzero(change) + 1, n)
    end = np.repeat(end, np.diff(np.append(0, end)))
    points = [np.frombuffer(word.encode("latin-1"), np.uint8) for word in words]
    lengths = np.array([len(p) for p in points])
    odd = np.zeros(n, np.uint64)
    flat = np.concatenate(points) if n else np.empty(0, np.uint8)
    np.bitwise_xor.at(odd, np.repeat(np.arange(n), lengths), np.uint64(1) << (flat & 63).astype(np.uint64))
    begin = np.cumsum(lengths) - lengths
    partners = end - np.arange(n) - 1
    done = np.append(0, np.cumsum(partners))
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, side="right")) - 1)
        left = np.repeat(np.arange(at, stop), partners[at:stop])
        right = np.arange(len(left)) - np.repeat(done[at:stop] - done[at], partners[at:stop]) + left + 1
        at = stop
        apart = np.bitwise_count(odd[left] ^ odd[right])
        shorter = np.minimum(lengths[left], lengths[right])
        wanted = (apart <= 2) & (shorter == size[left])
        # Words of one length that share a gram have it at the same place from the start, too.
        wanted &= (side[left] == 0) | (lengths[left] != lengths[right])
        # Of two blocks only pairs between them count.
        wanted &= (one[left] == two[left]) | (own[left] != own[right])
        left, right = left[wanted], right[wanted]
        swap = lengths[left] > lengths[right]
        left, right = np.where(swap, right, left), np.where(swap, left, right)
        # Few words are long; all of a stretch are padded alike.
        order = np.argsort(lengths[right], kind="stable")
        left, right = left[order], right[order]
        while len(left):
            width = int(lengths[right[0]]) + 8
            room = max(1, CELLS // width)
            take = max(1, min(room, int(np.searchsorted(lengths[right], width, side="right"))))
            near = np.ones(take, bool) & _near(
                _padded(flat, begin, lengths, left[:take], width),
                _padded(flat, begin, lengths, right[:take], width),
            )
            yield left[:take][near], right[:take][near]
            left, right = left[take:], right[take:]


def _padded(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    at = np.arange(width)
    inside = at < lengths[rows][:, None]
    return np.where(inside, flat[np.minimum(begin[rows][:, None] + at, len(flat) - 1)], 0)


def near_words(entries: DataFrame) -> DataFrame:
    """``word, near, near_n``: every pair of near words, both ways."""

    def merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        words, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
        for left, right in _pairs(table):
            if len(left):
                a, b = pa.array(np.append(left, right)), pa.array(np.append(right, left))
                yield pa.RecordBatch.from_arrays([words.take(a), words.take(b), n.take(b)], ["word", "near", "near_n"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in range(3)]
            differs = np.flatnonzero(np.logical_or.reduce([key != key[-1] for key in keys]))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            new = held and any(held[-1].column(i)[-1].as_py() != key[0] for i, key in enumerate(keys))
            if held and (cut or new):
                if new:
                    yield from merged(pa.Table.from_batches(held))
                    if cut:
                        yield from merged(pa.Table.from_batches([batch.slice(0, cut)]))
                else:
                    yield from merged(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif cut:
                yield from merged(pa.Table.from_batches([batch.slice(0, cut)]))
            held.append(batch.slice(cut))
        if held:
            yield from merged(pa.Table.from_batches(held))

    keys = ["list", "one", "two"]
    found = (
        _in_blocks(entries)
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(lists, "word string, near string, near_n bigint")
    )
    # A pair may share several lists.
    return found.repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def spelling_forms(words: DataFrame, spark: SparkSession) -> DataFrame:
    """``word, n, form, form_n, n_near`` of every word in ``words`` (``word, n``)."""
    dictionary = spark.sparkContext.broadcast(gram_dictionary(words))
    links = near_words(materialise(listed(words, dictionary), "lists"))
    # The largest number first, then the smallest word.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = links.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    frequent = -F.col("best.less") >= F.col("n") * TIMES
    return words.join(found, "word", "left").select(
        "word",
        "n",
        F.when(frequent, F.col("best.near")).alias("form"),
        F.when(frequent, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words that have a form: the last one that forms lead to.

    A form is at least twice as frequent, so chains are short; each round doubles the step.
    """
    steps = materialise(forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = steps.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        further = materialise(further, "roots")
        steps = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return steps


def spelling_variants(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    words = materialise(word_counts(df, key, text), "words")
    forms = materialise(spelling_forms(words, df.sparkSession), "forms")
    return forms.join(roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
