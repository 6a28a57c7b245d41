"""Benchmark decontamination with a distributed positional inverted index.

The words of training documents are indexed by term and position, but only for the terms that
tell the tests apart: for every window of a benchmark item its rarest term in the training data,
and its second rarest. Postings of the rarest terms, moved by the term's place in the item, give
alignments of a document with an item; they are intersected with the alignments that the second
rarest terms give. What is left is compared word by word around the rare term.

Everything here is DataFrame operations. Documents are read twice, once to count how often the
benchmark's terms occur and once to store postings, and only postings are shuffled.

A null text has no words. A document of any length is read whole. Items without words are never
found; repeated documents get a row each, and so do documents without id. An item that stands in
the table more than once, or shares its id with another, counts once for each id. Empty tables give
no rows, or no hits. Items without id are looked for like all others: their words count in ``n_hit``
and contaminate; the list of ids has none for them, and ``n_items`` counts all of them as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomset.llm.workers import quoted, unused
from loomset.session import materialise

WINDOW = 10
# Words are runs of [0-9a-z] and of all characters beyond ASCII, after A-Z were lower-cased.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

# So many benchmark terms, or rows of items' words beside a term, are sent to every task.
BROADCAST_TERMS = 200_000
BROADCAST_CONTEXTS = 20_000
# So many keys of contaminated documents are sent to every task; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def words_of(text: Column) -> Column:
    """The words of a text in order. Split at single blanks, which takes a tenth of the time of
    matching a regular expression."""
    plain = F.translate(
        F.coalesce(text, F.lit("")), UPPER + _BETWEEN, UPPER.lower() + " " * len(_BETWEEN)
    )
    return F.array_remove(F.split(plain, " "), "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text))


def _small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


# Items without id have this key; the keys of others are marked, so none of them is equal to it.
_NO_ID = "-"


def _id_of(item: str) -> Column:
    return F.when(F.col(item) != _NO_ID, F.expr(f"substring({item}, 2)"))


def item_terms(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """``item, words, n``: items with words, each distinct text once for each id. ``item`` is a key
    that is never null."""
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{item}`").cast("string")), F.lit(_NO_ID))
    return (
        benchmark.select(
            key.alias("item"), words_of(F.col(f"`{text}`")).alias("words")
        )
        .filter(F.size("words") > 0)
        .distinct()
        .withColumn("n", F.size("words"))
        .withColumn("text", F.xxhash64("words"))
    )


def term_frequencies(documents: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``term, n``: occurrences in the documents of every term of the items, also of those that
    do not occur."""
    terms = items.select(F.explode("words").alias("term")).distinct()
    terms = materialise(terms, "terms")
    occurring = documents.select(F.explode(words_of(F.col(f"`{text}`"))).alias("term"))
    counted = (
        occurring.join(_small(terms, BROADCAST_TERMS), "term").groupBy("term").agg(F.count("*").alias("n"))
    )
    return terms.join(counted, "term", "left").fillna(0, ["n"])


def anchors(items: DataFrame, frequencies: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item, text, term, place, first``: places in the items whose terms are indexed. ``first``
    tells whether the term is the rarest of some window, else it is the second rarest of one."""
    placed = items.select("item", "text", "n", F.posexplode("words").alias("place", "term")).join(
        frequencies.withColumnRenamed("n", "rows"), "term"
    )
    # The windows a place lies in; an item that is shorter than a window is one window.
    last = F.greatest(F.col("n") - window, F.lit(0))
    begin = F.explode(
        F.sequence(F.greatest(F.col("place") - (window - 1), F.lit(0)), F.least(F.col("place"), last))
    )
    by_rarity = Window.partitionBy("item", "text", "begin").orderBy("rows", "term", "place")
    ranked = placed.withColumn("begin", begin).withColumn("rank", F.row_number().over(by_rarity))
    return (
        ranked.filter(F.col("rank") <= 2)
        .groupBy("item", "text", "term", "place")
        .agg(F.max(F.col("rank") == 1).alias("first"), F.max(F.col("rank") == 2).alias("second"))
    )


def contexts(items: DataFrame, wanted: DataFrame, window: int = WINDOW) -> DataFrame:
    """``wanted`` with ``before`` and ``after``: the item's words beside the place, nearest first,
    as far as a window reaches, and ``n``."""
    place = F.col("place")
    left = F.least(place, F.lit(window - 1))
    return wanted.join(items, ["item", "text"]).select(
        "item",
        "text",
        "term",
        "place",
        "n",
        F.when(left > 0, F.reverse(F.slice("words", place - left + 1, F.greatest(left, F.lit(1)))))
        .otherwise(F.array().cast("array<string>"))
        .alias("before"),
        F.slice("words", place + 2, window - 1).alias("after"),
    )


def postings(documents: DataFrame, terms: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The inverted index: ``document, term, position`` for ``terms`` (``term, context``), and
    beside the terms with ``context`` the document's words as far as a window reaches, nearest
    first. ``document`` is a key of id and text, so repeated rows are indexed once each but meet in
    the same postings."""
    position = F.col("position")
    left = F.least(position, F.lit(window - 1))
    none = F.array().cast("array<string>")
    words = documents.select("document", words_of(F.col(f"`{text}`")).alias("words"))
    placed = words.select("document", "words", F.posexplode("words").alias("position", "term"))

    def found(part: DataFrame) -> DataFrame:
        # The words of a document stay beside its terms only within the task that reads it.
        return placed.join(F.broadcast(part), "term").select(
            "document",
            "term",
            "position",
            F.when(
                F.col("context") & (left > 0),
                F.reverse(F.slice("words", position - left + 1, F.greatest(left, F.lit(1)))),
            )
            .otherwise(none)
            .alias("doc_before"),
            F.when(F.col("context"), F.slice("words", position + 2, window - 1))
            .otherwise(none)
            .alias("doc_after"),
        )

    # A benchmark with more terms than may be broadcast is looked up in parts, a pass for each.
    parts = max(1, -(-terms.count() // BROADCAST_TERMS))
    part = F.pmod(F.xxhash64("term"), F.lit(parts))
    return reduce(DataFrame.unionByName, [found(terms.filter(part == i)) for i in range(parts)])


def _run(own: str, other: str) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(own, other, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def document_key(id_column: str, text: str) -> Column:
    """Tells documents apart by id and text; equal rows have equal keys."""
    return F.concat_ws(
        ":",
        F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("-")),
        F.xxhash64(F.col(f"`{text}`")).cast("string"),
    )


def phrase_matches(
    documents: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``document, item, from, to``: stretches of words of a document, with ``document`` as its
    key, that stand in an item in the same order and hold whole windows of it."""
    items = materialise(items, "items")
    frequencies = term_frequencies(documents, items, text)
    chosen = materialise(anchors(items, frequencies, window), "anchors")
    terms = chosen.groupBy("term").agg(F.max("first").alias("context"))
    index = materialise(postings(documents, terms, text, window), "postings")

    diagonal = (F.col("position") - F.col("place")).alias("diagonal")
    rarest = contexts(items, chosen.filter("first"), window)
    second = chosen.filter("second").select("item", "text", "term", "place")
    # Alignments of a document with an item: postings moved by the place of their term.
    by_rarest = index.join(_small(rarest, BROADCAST_CONTEXTS), "term").select("*", diagonal)
    by_second = (
        index.select("document", "term", "position")
        .join(_small(second, BROADCAST_TERMS), "term")
        .select("document", "item", "text", diagonal)
        .distinct()
    )
    keys = ["document", "item", "text", "diagonal"]
    alone = by_rarest.filter(F.col("n") == 1)
    both = by_rarest.filter(F.col("n") > 1).join(by_second, keys, "left_semi")
    left, right = _run("before", "doc_before"), _run("after", "doc_after")
    return (
        both.select(*alone.columns)
        .unionByName(alone)
        .select(
            "document",
            "item",
            "n",
            (F.col("position") - left).alias("from"),
            (F.col("position") + right).alias("to"),
        )
        .filter(F.col("to") - F.col("from") + 1 >= F.least(F.lit(window), F.col("n")))
        .select("document", "item", "from", "to")
    )


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """A row per document: ``key, n_words, n_hit, n_items, items_sha256, contaminated``."""
    keyed = documents.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")
    ).withColumn("document", document_key("key", "text"))
    distinct = keyed.filter(F.col("text").isNotNull()).select("document", "text")
    found = materialise(
        phrase_matches(distinct, item_terms(benchmark), "text", window).distinct(), "matches"
    )
    # Words in any stretch: each adds what lies beyond the farthest end before it.
    in_order = Window.partitionBy("document").orderBy("from", "to")
    reached = F.max("to").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(
        F.col("to") - F.greatest(F.col("from"), F.coalesce(reached + 1, F.col("from"))) + 1, F.lit(0)
    )
    spans = found.select("document", "from", "to").distinct()
    hit = spans.select("document", fresh.alias("n")).groupBy("document").agg(F.sum("n").alias("n_hit"))
    # An item counts once per document before its ids are gathered: at most the benchmark's ids.
    named = (
        found.select("document", "item")
        .distinct()
        .groupBy("document")
        .agg(
            F.array_sort(F.collect_list(_id_of("item"))).alias("items"), F.count("*").alias("n_items")
        )
    )
    hits = hit.join(named, "document")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return keyed.select("key", "document", count_words(F.col("text")).cast("bigint").alias("n_words")).join(
        hits, "document", "left"
    ).select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def proximity_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    slop: int,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``key, item, place, position``: the rarest term of some window of an item stands in a
    document, and the window's second rarest within ``slop`` words of where it should stand. Finds
    passages with words put in, left out or exchanged, which are no exact matches."""
    keyed = documents.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")
    ).withColumn("document", document_key("key", "text"))
    distinct = keyed.filter(F.col("text").isNotNull()).select("document", "text")
    items = materialise(item_terms(benchmark), "items")
    chosen = materialise(anchors(items, term_frequencies(distinct, items), window), "anchors")
    terms = chosen.select("term").distinct().withColumn("context", F.lit(False))
    index = materialise(postings(distinct, terms, "text", window), "postings")
    moved = (
        index.select("document", "term", "position")
        .join(_small(chosen, BROADCAST_TERMS), "term")
        .withColumn("diagonal", F.col("position") - F.col("place"))
    )
    # Diagonals are compared by stretches of slop + 1: only neighbours can be close enough.
    step = F.floor(F.col("diagonal") / (slop + 1))
    first = moved.filter("first").select(
        "document", "item", "text", "place", "position", "diagonal",
        F.explode(F.sequence(step - 1, step + 1)).alias("step"),
    )
    second = moved.filter("second").select(
        "document", "item", "text", step.alias("step"),
        F.col("place").alias("place2"), F.col("diagonal").alias("diagonal2"),
    )
    near = first.join(second, ["document", "item", "text", "step"]).filter(
        (F.abs(F.col("diagonal") - F.col("diagonal2")) <= slop)
        & (F.abs(F.col("place") - F.col("place2")) < window)
    )
    found = near.select("document", "item", "place", "position").distinct()
    return (
        keyed.select("key", "document").join(found, "document").select(
            F.col("key").alias(key), _id_of("item").alias("item"), "place", "position"
        )
    )


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``documents`` that hold no window of an item. Only the keys of those that do
    are joined."""
    name = unused(documents, "_document")
    keyed = documents.withColumn(name, document_key(key, text))
    distinct = keyed.filter(F.col(f"`{text}`").isNotNull()).select(
        F.col(name).alias("document"), F.col(f"`{text}`").alias("text")
    )
    found = phrase_matches(distinct, item_terms(benchmark)).select(F.col("document").alias(name))
    hit = materialise(found.distinct(), "contaminated")
    return keyed.join(_small(hit, BROADCAST_KEYS), name, "left_anti").select(
        *[F.col(quoted(c)) for c in documents.columns]
    )
