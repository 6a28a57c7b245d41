"""MinHash near-duplicates: fast similarity sketching, banding, exact verification.

A document's set is its distinct shingles of five words. Its sketch has a fixed number of
coordinates, filled in rounds: in each round every shingle falls into one bin, with a value that
is larger than those of all earlier rounds, and a bin keeps its least value. Rounds go on until
all bins are filled; after as many rounds as bins the remaining ones are filled one by one. So
every coordinate is filled, two sets agree in a coordinate with the probability of their
similarity, and the share of equal coordinates concentrates about it.

Equal texts are one class. Classes whose sketches agree in all coordinates of a band meet in its
bucket, and there each is compared with the smallest. Where that leaves several components in a
bucket, its members are compared further, only across components and only if their sketches may
belong to similar sets, most similar first, until all that are linked are joined. So most members
of a large bucket are compared once, no pair that may be linked is left out, and pairs never leave
the task that compares them. Links are confirmed on full sets.

With 32 bands of 4 coordinates a pair of similarity 0.75 shares no bucket with probability 5e-6;
similar sketches means an estimate of 0.55, five standard deviations below 0.75.

A null or empty text, or one of white space only, has an empty set and is linked with nothing. Texts
of any length are read whole. Repeated rows get equal rows. Rows without id have the smallest id of
their component, or none. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.llm.components import connected_components
from loomset.llm.workers import map_batches, per_worker, texts_of, unused
from loomset.session import materialise

SHINGLE = 5
# Linked if PERCENT of the union, or more, is common.
PERCENT = 75
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
LIKELY = 0.55
# Members of a bucket in a block; a task compares two blocks with each other.
BLOCK = 1024

_PIECE = 1 << 18
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256)
)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers over all 64-bit numbers, one to one."""
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    random = np.random.default_rng(977)
    values = random.integers(1, 1 << 63, 256, dtype=np.uint64)
    factor = int(random.integers(1, 1 << 62)) * 2 + 1
    n = 2 * _PIECE + 1
    powers = np.full(n, factor, np.uint64)
    backwards = np.full(n, pow(factor, -1, 1 << 64), np.uint64)
    powers[0] = backwards[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(backwards, out=backwards)
    factors = random.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seeds = random.integers(1, 1 << 63, 2 * BINS, dtype=np.uint64)
    return values, powers, backwards, factors, seeds


def _hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in folded bytes, and a 64-bit hash of each."""
    values, powers, backwards, _, _ = per_worker("shingle tables", _tables)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = raw != 0x20
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    running = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(values[raw] * powers[: len(raw)], out=running[1:])
    return starts, mix((running[ends] - running[starts]) * backwards[starts])


def _pieces(raw: bytes) -> Iterator[np.ndarray]:
    """Folded bytes in pieces that end after a space. Only a piece of one word can be long."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > _PIECE:
            end = raw.rfind(b" ", at, at + _PIECE) + 1 or raw.find(b" ", at) + 1 or len(raw)
        yield np.frombuffer(raw, np.uint8, end - at, at)
        at = end


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of every word of a folded text of any length."""
    found = [np.empty(0, np.uint64)]
    for piece in _pieces(raw):
        if len(piece) - (piece[-1] == 0x20) > 2 * _PIECE - 2:
            word = piece.tobytes().strip(b" ")
            digest = hashlib.blake2b(word, digest_size=8).digest()
            found.append(np.array([int.from_bytes(digest, "little")], np.uint64))
        else:
            found.append(_hash_words(piece)[1])
    return np.concatenate(found)


def _hash_shingles(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` words that follow each other."""
    factors = per_worker("shingle tables", _tables)[3]
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += words[i : i + n] * factors[i]
    return mix(total)


def shingle_hashes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The shingles of all texts in bundles: the position of the bundle's first text, the hashes,
    repeated ones included, and which text of the bundle each belongs to."""
    folded = [text.encode().translate(_FOLD) for text in texts]
    at = 0
    while at < len(folded):
        end, size = at, 0
        while end < len(folded) and (end == at or size + len(folded[end]) < _PIECE):
            size += len(folded[end]) + 1
            end += 1
        if end == at + 1:
            words = word_hashes(folded[at])
            items = _hash_shingles(words, min(SHINGLE, len(words))) if len(words) else words
            yield at, items, np.zeros(len(items), np.int64)
        else:
            bundle = b" ".join(folded[at:end])
            lengths = np.array([len(f) + 1 for f in folded[at:end]])
            starts, words = _hash_words(np.frombuffer(bundle, np.uint8))
            owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
            counts = np.bincount(owner, minlength=end - at)
            items, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            if len(words) >= SHINGLE:
                whole = owner[SHINGLE - 1 :] == owner[: 1 - SHINGLE]
                items.append(_hash_shingles(words, SHINGLE)[whole])
                owners.append(owner[: 1 - SHINGLE][whole])
            first = np.cumsum(counts) - counts
            for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
                items.append(_hash_shingles(words[first[i] : first[i] + counts[i]], counts[i]))
                owners.append(np.array([i]))
            yield at, np.concatenate(items), np.concatenate(owners)
        at = end


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted hashes of the distinct shingles of each text."""
    found: list[np.ndarray] = []
    for at, items, owners in shingle_hashes(texts):
        found += [np.empty(0, np.uint64)] * (at - len(found))
        order = np.argsort(owners, kind="stable")
        items, owners = items[order], owners[order]
        last = int(owners[-1]) + 1 if len(owners) else 0
        cuts = np.searchsorted(owners, np.arange(1, last))
        for own in np.split(items, cuts) if last else []:
            own = np.sort(own)
            found.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return found + [np.empty(0, np.uint64)] * (len(texts) - len(found))


def sketches(items: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """A row of bins for each of ``n`` sets: ``items`` belong to ``owners``, repeated ones do no
    harm. A value holds the round it was set in. Rows of empty sets mean nothing."""
    seeds = per_worker("shingle tables", _tables)[4]
    bins = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    empty = np.ones(n * BINS, bool)
    low = np.uint64((1 << 48) - 1)
    for i in range(BINS):
        mixed = mix(items ^ seeds[i])
        at = owners * BINS + ((mixed >> np.uint64(50)) % np.uint64(BINS)).astype(np.int64)
        wanted = empty[at]
        at = at[wanted]
        np.minimum.at(bins, at, (mixed[wanted] & low) | np.uint64(i << 48))
        empty[at] = False
        open_ = empty.reshape(n, BINS).any(axis=1)[owners]
        items, owners = items[open_], owners[open_]
        if not len(items):
            break
    for b in range(BINS) if len(items) else []:
        at = owners * BINS + b
        wanted = empty[at]
        mixed = mix(items[wanted] ^ seeds[BINS + b])
        np.minimum.at(bins, at[wanted], (mixed & low) | np.uint64((BINS + b) << 48))
    return bins.reshape(n, BINS)


def band_keys(bins: np.ndarray) -> np.ndarray:
    """A key for each band of each row of bins."""
    rows = bins.reshape(len(bins), BANDS, ROWS)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(bins), axis=0)
    for i in range(ROWS):
        key = mix(key * _M2 + rows[:, :, i])
    return key.view(np.int64)


def sketch_bytes(bins: np.ndarray) -> np.ndarray:
    """A byte of each value: unequal values agree in one of 256 cases."""
    return (mix(bins) >> np.uint64(56)).astype(np.uint8)


def distinct_counts(items: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """How many distinct items each of ``n`` sets has."""
    if n == 1:
        return np.array([len(np.unique(items))])
    bits = np.uint64(max(1, (n - 1).bit_length()))
    # The owner takes the upper bits; the hash gives up as many of its lowest.
    keys = np.sort(owners.astype(np.uint64) << (np.uint64(64) - bits) | items >> bits)
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
    own = (keys[first] >> (np.uint64(64) - bits)).astype(np.int64)
    return np.bincount(own, minlength=n)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have PERCENT of their union in common."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def sketched(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, digest, n, sketch, bands`` for every row. One pass without a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(2))
        sizes = np.zeros(len(texts), np.int64)
        keys = np.zeros((len(texts), BANDS), np.int64)
        short = np.zeros((len(texts), BINS), np.uint8)
        for at, items, owners in shingle_hashes(texts):
            n = int(owners.max()) + 1 if len(owners) else 0
            if n:
                bins = sketches(items, owners, n)
                sizes[at : at + n] = distinct_counts(items, owners, n)
                keys[at : at + n] = band_keys(bins)
                short[at : at + n] = sketch_bytes(bins)
        known = sizes > 0
        return pa.RecordBatch.from_arrays(
            [
                *batch.columns[:2],
                pa.array(sizes),
                pa.array([s.tobytes() if k else None for s, k in zip(short, known, strict=True)]),
                pa.array([s if k else None for s, k in zip(keys, known, strict=True)]),
            ],
            ["id", "digest", "n", "sketch", "bands"],
        )

    return map_batches(
        df.select(
            F.col(f"`{key}`").alias("id"),
            F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))).alias("digest"),
            F.col(f"`{text}`").alias("text"),
        ),
        work,
        f"id {kind}, digest binary, n bigint, sketch binary, bands array<bigint>",
    )


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b`` of the pairs whose sketches may belong to similar sets."""
    own = classes.select("cid", "sketch")
    both = pairs.join(own.toDF("a", "sketch_a"), "a").join(own.toDF("b", "sketch_b"), "b")

    def near(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        left, right = (
            np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS)
            for i in (2, 3)
        )
        keep = pa.array((left == right).mean(axis=1) >= LIKELY)
        return pa.RecordBatch.from_arrays(
            [batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"]
        )

    return map_batches(both.select("a", "b", "sketch_a", "sketch_b"), near, "a bigint, b bigint")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` of the pairs whose full sets are similar. ``texts`` has ``cid, text``."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = {}, []
        for names, content in ((0, 2), (1, 3)):
            for name, text in zip(
                batch.column(names).to_pylist(), batch.column(content).to_pylist(), strict=True
            ):
                if name not in ids:
                    ids[name] = len(texts)
                    texts.append(text)
        sets = shingle_sets(texts)
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        mask = pa.array([linked(sets[ids[a]], sets[ids[b]]) for a, b in pairs], pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"]
        )

    return map_batches(both.select("a", "b", "text_a", "text_b"), check, "a bigint, b bigint")


class _Parts:
    """Components of a bucket's members, joined as links are found."""

    def __init__(self, labels: np.ndarray):
        self.names, self.of = np.unique(labels, return_inverse=True)

    def join(self, i: int, j: int) -> None:
        self.of[self.of == self.of[i]] = self.of[j]


def _bucket_links(
    parts: _Parts,
    away: np.ndarray,
    side: np.ndarray,
    rows: np.ndarray,
    bands: np.ndarray,
    own: int,
    texts: list[str],
) -> list[tuple[int, int]]:
    """Confirmed links, as positions, that join all components of a bucket which are linked in it.

    Each member ``away`` from the component of the bucket's smallest is held against the likely
    members of other components, most similar first, until none is left that is not joined yet.
    Of a block and another one, only pairs between them count, and of the buckets that two members
    share, only the first.
    """
    tries: list[tuple[int, np.ndarray]] = []
    for i in np.flatnonzero(away):
        at = np.flatnonzero((parts.of != parts.of[i]) & (side != side[i]))
        near = (rows[at] == rows[i]).mean(axis=1)
        at, near = at[near >= LIKELY], near[near >= LIKELY]
        if len(at):
            first = (bands[at] == bands[i]).argmax(axis=1) == own
            at, near = at[first], near[first]
            tries.append((i, at[np.argsort(-near, kind="stable")]))
    if not tries:
        return []
    needed = np.unique(np.concatenate([np.append(at, i) for i, at in tries]))
    sets = dict(zip(needed.tolist(), shingle_sets([texts[k] for k in needed]), strict=True))
    found = []
    for i, at in tries:
        for j in at.tolist():
            if parts.of[i] != parts.of[j] and linked(sets[i], sets[j]):
                found.append((i, j))
                parts.join(i, j)
    return found


def cross_links(
    members: DataFrame, classes: DataFrame, texts: DataFrame, labels: DataFrame
) -> DataFrame:
    """``a, b``: links between different components within a bucket, enough to join all that are
    linked. ``labels`` has the components so far.

    Buckets are held against themselves in blocks, so that a task holds two blocks at most. Only
    links leave a task, never the pairs that were compared.
    """
    labelled = members.join(labels.toDF("cid", "component"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid")
    )
    # With two members the pair has been compared already.
    mixed = (
        labelled.groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("component").alias("least"),
            F.max("component").alias("most"),
            F.max(F.when(F.col("cid") == F.col("hub"), F.col("component"))).alias("home"),
        )
        .filter((F.col("n") > 2) & (F.col("least") < F.col("most")))
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .select("band", "home", "blocks")
    )
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    spread = (
        labelled.join(mixed, "band")
        .join(classes.select("cid", "sketch", "bands"), "cid")
        .join(texts, "cid")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "band",
            F.least("block", "other").alias("one"),
            F.greatest("block", "other").alias("two"),
            "cid",
            "component",
            (F.col("component") != F.col("home")).alias("away"),
            "block",
            "sketch",
            "bands",
            "text",
        )
    )

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by bucket and blocks; a bucket may go over several batches."""
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> pa.RecordBatch:
            band, one, two, ids, components, away, block = (
                table.column(i).to_numpy(zero_copy_only=False) for i in range(7)
            )
            rows = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(-1, BINS)
            bands = np.array(table.column(8).to_pylist(), np.int64).reshape(-1, BANDS)
            texts = table.column(9).to_pylist()
            change = (band[1:] != band[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(band)]
            found = []
            for x, y in zip(cuts, cuts[1:], strict=False):
                # Within one block everyone may meet everyone.
                side = block[x:y] if one[x] != two[x] else np.arange(y - x)
                own = int(np.flatnonzero(bands[x] == band[x])[0])
                links = _bucket_links(
                    _Parts(components[x:y]),
                    away[x:y],
                    side,
                    rows[x:y],
                    bands[x:y],
                    own,
                    texts[x:y],
                )
                found += [(int(ids[x + i]), int(ids[x + j])) for i, j in links]
            return pa.RecordBatch.from_arrays(
                [pa.array([pair[k] for pair in found], pa.int64()) for k in (0, 1)], ["a", "b"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            same = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            tail = _bucket_of(batch, -1)
            differs = np.logical_or.reduce([c != t for c, t in zip(same, tail, strict=True)])
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut or (held and _bucket_of(held[-1], -1) != tail):
                yield compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compare(pa.Table.from_batches(held))

    keys = ["band", "one", "two"]
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        spread.repartition(tasks, *keys)
        .sortWithinPartitions(*keys, "cid")
        .mapInArrow(buckets, "a bigint, b bigint")
    )


def _bucket_of(batch: pa.RecordBatch, row: int) -> list:
    row = batch.num_rows + row if row < 0 else row
    return [column[row].as_py() for column in batch.columns[:3]]


def link_classes(classes: DataFrame, documents: DataFrame) -> DataFrame:
    """``node, component`` of the classes that are linked with others. ``classes`` has ``cid, id,
    digest, sketch, bands``, ``documents`` has ``id, digest, text``."""
    banded = classes.select("cid", F.explode("bands").alias("band"))
    shared = (
        banded.groupBy("band")
        .agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("hub"))
        .filter(F.col("n") > 1)
        .select("band", "hub")
    )
    members = materialise(banded.join(shared, "band"), "members")
    stars = (
        members.filter(F.col("cid") != F.col("hub"))
        .select(F.col("cid").alias("a"), F.col("hub").alias("b"))
        .distinct()
    )
    # The texts of all classes that meet another one: one per class.
    wanted = classes.join(members.select("cid").distinct(), "cid", "left_semi").select(
        "cid", F.col("id").alias("own"), "digest"
    )
    texts = documents.join(wanted, "digest").filter(F.col("id").eqNullSafe(F.col("own")))
    texts = materialise(texts.select("cid", "text").dropDuplicates(["cid"]), "texts")

    likely = materialise(likely_pairs(stars, classes), "likely")
    star_links = materialise(confirm(likely, texts).toDF("u", "v"), "confirmed")
    labels = materialise(connected_components(star_links), "labels")
    # What the stars left apart: links between components, added to one link per member.
    cross = materialise(cross_links(members, classes, texts, labels).toDF("u", "v"), "cross")
    if cross.isEmpty():
        return labels
    return materialise(connected_components(labels.toDF("u", "v").unionByName(cross)), "labels")


def grouped(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, digest, n, component`` for every row, read from a written table."""
    named = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = materialise(sketched(named, "id", "text"), "sketches")
    classes = (
        rows.filter(F.col("n") > 0)
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    classes = materialise(classes, "classes")
    documents = named.withColumn("digest", F.unhex(F.md5(F.col("text"))))
    labels = link_classes(classes, documents).toDF("cid", "part")
    smallest = (
        classes.select("cid", "id").join(labels, "cid").groupBy("part").agg(F.min("id").alias("least"))
    )
    linked_ids = labels.join(smallest, "part").select("cid", "least")
    by_digest = (
        classes.select("cid", "digest", F.col("id").alias("own"))
        .join(linked_ids, "cid", "left")
        .select("digest", F.coalesce("least", "own").alias("least"))
    )
    # Empty texts are no class and stay by themselves.
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id"))
    return (
        rows.select("id", "n", "digest")
        .join(by_digest, "digest", "left")
        .select("id", "digest", "n", component.alias("component"))
    )


def near_duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row: ``component_id`` is the smallest id
    that links reach, ``kept`` tells whether it is the row's own."""
    return grouped(df, key, text).select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id; of rows that repeat
    it, one."""
    found = materialise(grouped(df, key, text), "groups")
    kept = found.filter(F.col("id").eqNullSafe(F.col("component"))).groupBy("id", "digest").count()
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    own, texts = unused(df, "_id"), unused(df, "_digest")
    named = df.withColumns({own: F.col(f"`{key}`"), texts: digest})
    same = named[own].eqNullSafe(kept["id"]) & (named[texts] == kept["digest"])
    rows = named.join(kept, same, "left_semi")
    if not kept.filter(F.col("count") > 1).isEmpty():
        rows = rows.dropDuplicates([own, texts])
    return rows.drop(own, texts)
