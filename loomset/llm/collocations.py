"""Collocations by partitioned mining: shards first, all candidates then counted in the whole.

A phrase that occurs ``SUPPORT`` times in a language occurs, in at least one of its shards, as
often as that shard's share of the language's words asks for. So each shard is mined completely at
its lowered support, level by level: a phrase is counted only where both phrases that are one word
shorter are frequent in that shard. The union of what is frequent in some shard holds every
frequent phrase, and one more pass counts the whole union in all texts, by the phrases themselves.

The number of shards is fixed, so that the lowered support stays well above one at any size; a
shard is no task, its counts are aggregated by Spark. Which shard a text belongs to depends on its
content only. What is frequent goes to the tasks as a bitmap, which may let more through, never
less. Texts are worked on in portions and counted there before anything is shuffled.

Words are runs of bytes other than space and tab, A-Z lower-cased, in the pieces that
``. , ; : ! ?`` and line ends cut; a text of any length is read whole. A null or empty text has no
words; a null language is ``und``. Repeated rows count as often as they are there. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.bitmaps import bitmap_of, contains
from loomset.llm.words import counted, find_words, gathered, in_portions, lower_case, mix, text_bytes
from loomset.session import materialise

SUPPORT = 30
LONGEST = 4
TOP = 2_000
# A phrase goes if one that holds it has at least this percentage of its occurrences.
PERCENT = 80
SCALE = 2_000_000

# Shards of a language: at most 8, which the keys of bitmaps have room for.
SHARDS = 6
# Bytes of text that are counted together before they are shuffled.
PORTION = 4 << 20
# Phrases that are spelled out at a time.
SPELLED = 1 << 16
# Parts of a language that are cut down to the first phrases before they meet.
PARTS = 64

_FOLD = bytes(
    0x0A if b in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if b == 0x09 else lower_case(b) for b in range(256)
)
_FACTORS = np.random.default_rng(6131).integers(1, 1 << 62, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANGUAGE = np.uint64(0xFFFFFFFFFFFFFFF8)


class _Portion:
    """The words of some texts: hashes, pieces, and the group (language and shard) of each."""

    def __init__(self, texts: list[bytes], groups: np.ndarray):
        self.raw = b"\n".join(texts).translate(_FOLD)
        data = np.frombuffer(self.raw, np.uint8)
        self.inside = (data != 0x20) & (data != 0x0A)
        self.words = find_words(self.raw, self.inside)
        ends = np.cumsum([len(text) + 1 for text in texts])
        self.owner = np.searchsorted(ends, self.words.starts, side="right")
        self.piece = np.searchsorted(np.flatnonzero(data == 0x0A), self.words.starts)
        self.group = groups[self.owner]
        self.language = self.group & _LANGUAGE

    def whole(self, size: int) -> np.ndarray:
        """Whether ``size`` words from each word on stand in one piece."""
        n = len(self.piece) - size + 1
        return self.piece[:n] == self.piece[size - 1 :] if n > 0 else np.empty(0, bool)

    def keys(self, size: int) -> np.ndarray:
        """A key of language and phrase for ``size`` words from each word on."""
        n = max(0, len(self.piece) - size + 1)
        total = self.language[:n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size)
        for i in range(size):
            total += self.words.hashes[i : i + n] * _FACTORS[i]
        return mix(total)

    def shards(self, n: int) -> np.ndarray:
        return self.group[:n] & ~_LANGUAGE

    @cached_property
    def _spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space after each, and where each word ends with it."""
        starts, ends, _ = self.words
        data = np.append(np.frombuffer(self.raw, np.uint8), np.uint8(0x20))
        kept = np.append(self.inside, False)
        kept[ends] = True
        data[ends] = 0x20
        return data[kept], np.cumsum(ends - starts + 1)

    def phrases(self, at: np.ndarray, size: int) -> pa.Array:
        """The ``size`` words from each of these words on, with one space between them."""
        data, after = self._spaced
        lengths = self.words.ends[at] - self.words.starts[at] + 1
        return gathered(data, after[at] - lengths, after[at + size - 1] - 1)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Portion, pa.RecordBatch]]:
    for batch in in_portions(batches, 0, PORTION):
        groups = batch.column(1).to_numpy().view(np.uint64)
        yield _Portion(text_bytes(batch.column(0)), groups), batch


def _texts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """``text, group, lang``: the group is a hash of the language and, in its lowest bits, the
    shard."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = F.coalesce(F.col(f"`{lang}`"), F.lit("und"))
    return df.select(
        content.alias("text"),
        _language(named).bitwiseOR(F.pmod(F.xxhash64(content), F.lit(SHARDS))).alias("group"),
        named.alias("lang"),
    )


def _language(named: Column) -> Column:
    return F.xxhash64(named).bitwiseAND(F.lit(-8))


def local_counts(texts: DataFrame, size: int, shorter: Broadcast | None) -> DataFrame:
    """``group, key, n``: how often each phrase of ``size`` words occurs in each shard, if the two
    phrases in it that are one word shorter are among the ``shorter`` ones of that shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, _ in _portions(batches):
            at = np.flatnonzero(portion.whole(size))
            if shorter is not None and len(at):
                keys = portion.keys(size - 1)
                known = contains(shorter.value, keys, portion.shards(len(keys)))
                at = at[known[at] & known[at + 1]]
            if not len(at):
                continue
            keys, groups = portion.keys(size)[at], portion.group[at]
            first, n = counted(keys + (groups & ~_LANGUAGE))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(groups[first].view(np.int64)),
                    pa.array(keys[first].view(np.int64)),
                    pa.array(n.astype(np.int64)),
                ],
                ["group", "key", "n"],
            )

    rows = texts.select("text", "group").mapInArrow(count, "group bigint, key bigint, n bigint")
    return rows.groupBy("group", "key").agg(F.sum("n").alias("n"))


def frequent_in_shards(texts: DataFrame, support: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """``key`` of every phrase that is frequent in some shard, and ``language, n``: the words of
    each language."""
    language = F.col("group").bitwiseAND(F.lit(-8))
    words = materialise(local_counts(texts, 1, None), "shard-counts")
    sizes = words.groupBy("group").agg(F.sum("n").alias("own"))
    whole = sizes.groupBy(language.alias("language")).agg(F.sum("own").alias("n"))
    # f >= support needs some shard with f_i >= support * n_i / n; whole numbers round up.
    share = F.col("own").cast("decimal(20,0)") * support
    limits = materialise(
        sizes.join(whole, language == F.col("language")).select(
            F.col("group").alias("of"), F.greatest(F.lit(1), F.ceil(share / F.col("n"))).alias("least")
        ),
        "shard-support",
    )
    found: DataFrame | None = None
    counts = words
    for size in range(1, longest + 1):
        if size > 1:
            shorter = bitmap_of(frequent, salt="shard")  # noqa: F821
            counts = local_counts(texts, size, shorter)
        frequent = materialise(
            counts.join(limits, F.col("group") == F.col("of"))
            .filter(F.col("n") >= F.col("least"))
            .select("key", F.col("group").bitwiseAND(F.lit(7)).alias("shard")),
            "shard-phrases",
        )
        keys = frequent.select("key")
        found = keys if found is None else found.unionByName(keys)
    return found, whole


def global_counts(texts: DataFrame, wanted: Broadcast, longest: int) -> DataFrame:
    """``lang, phrase, words, f``: occurrences of every phrase of up to ``longest`` words whose key
    is ``wanted``, in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion, batch in _portions(batches):
            for size in range(1, longest + 1):
                at = np.flatnonzero(portion.whole(size))
                keys = portion.keys(size)[at]
                known = contains(wanted.value, keys)
                at, keys = at[known], keys[known]
                if not len(at):
                    continue
                first, n = counted(keys)
                for i in range(0, len(first), SPELLED):
                    these = at[first[i : i + SPELLED]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(2).take(pa.array(portion.owner[these])),
                            portion.phrases(these, size),
                            pa.array(np.full(len(these), size, np.int32)),
                            pa.array(n[i : i + SPELLED].astype(np.int64)),
                        ],
                        ["lang", "phrase", "words", "n"],
                    )

    rows = texts.mapInArrow(count, "lang string, phrase string, words int, n bigint")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))


def frequent_phrases(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    support: int = SUPPORT,
    longest: int = LONGEST,
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, words, f`` of all phrases with at least ``support`` occurrences, single
    words included, and ``lang, n``: the words of each language."""
    texts = _texts(df, text, lang)
    found, sizes = frequent_in_shards(texts, support, longest)
    counts = global_counts(texts, bitmap_of(found), longest).filter(F.col("f") >= support)
    languages = df.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang")).distinct()
    named = languages.join(sizes, _language(F.col("lang")) == F.col("language"))
    return materialise(counts, "phrases"), named.select("lang", "n")


def _parts(from_word: Column, n_words: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), from_word, n_words), " ")


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, score`` for every phrase of two words or more: the cut of
    the lowest score, of equal ones the earliest."""
    cuts = (
        phrases.filter(F.col("words") > 1)
        .withColumnRenamed("f", "a")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("left", _parts(F.lit(1), F.col("k")))
        .withColumn("right", _parts(F.col("k") + 1, F.col("words") - F.col("k")))
    )
    lefts = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    score = F.expr(
        f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"
    )
    return (
        cuts.join(lefts, ["lang", "left"])
        .join(rights, ["lang", "right"])
        .groupBy("lang", "phrase", "words", "a")
        .agg(F.min(F.struct(score.cast("bigint").alias("score"), "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
    )


def covered(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, most``: for every phrase that stands in a longer one, the occurrences of
    the most frequent of these."""
    inner = (
        phrases.filter(F.col("words") > 2)
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
        .select("lang", _parts(F.col("start"), F.col("size")).alias("phrase"), "f")
    )
    return inner.groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    support: int = SUPPORT,
    longest: int = LONGEST,
    percent: int = PERCENT,
    top: int = TOP,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    phrases, sizes = frequent_phrases(df, text, lang, support, longest)
    exact = "decimal(25,0)"
    kept = (
        scored(phrases)
        .join(covered(phrases), ["lang", "phrase"], "left")
        .filter(
            F.col("most").isNull()
            | (F.col("most").cast(exact) * 100 < F.col("a").cast(exact) * percent)
        )
    )
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # Parts of a language are cut to their first phrases before they meet in one task.
    within = Window.partitionBy("lang", "part").orderBy(*best)
    first = (
        kept.withColumn("part", part)
        .withColumn("rank", F.row_number().over(within))
        .filter(F.col("rank") <= top)
    )
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)))
    return (
        ranked.filter(F.col("rank") <= top)
        .join(sizes, "lang")
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )
