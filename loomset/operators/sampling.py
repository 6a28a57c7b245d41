"""Taking exactly N rows: first in order, seeded sample, train/test split, numbering.

None of these sorts the table in one task. A take that is too large for Spark's top-k is done
by finding the value of its last row first (counting per bucket, or inside a bracket that a quantile
sketch gives) and then filtering the table by that value. Rows that are identical copies
of each other and straddle the cut cannot be told apart by any value, so one of them is kept
and repeated as often as needed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from loomset.operators.skew import (
    BLOCK_ROWS,
    HOT_ROWS,
    check_block_order,
    hot_blocks,
    hot_hashes,
    key_hash,
)

# Up to this many whole rows fit the top-k of a single task.
TOP_ROWS = 10_000

# Up to this many digests are worth collecting.
SMALL = 100_000

_SORT_TYPES = (
    BinaryType,
    BooleanType,
    DateType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

# Size of a quantile sketch, and how far off its ranks are at most, as a share of the rows, with
# room to spare.
_SKETCH = 2048
_SKETCH_ERROR = 0.004

# Bytes of a string that make a number of 64 bits, never a negative one.
_BYTES = 7

_HEX_PER_ROUND = 3  # 16**3 counted buckets a round


@dataclass(frozen=True)
class Cut:
    """Where a take of N rows ends.

    ``inside`` holds for the rows that belong to the take. ``copies`` (with ``taken`` of
    ``total``) describes identical rows of which only some belong to it.
    """

    inside: Column
    copies: Column | None = None
    taken: int = 0
    total: int = 0


def take_first(
    df: DataFrame, n: int | None, order_by: str | list[str], top_rows: int = TOP_ROWS
) -> DataFrame:
    """First ``n`` rows in the order of ``order_by``; ``None`` and 0 mean all, below 0 none.

    The rows come in that order, rows equal in it in the order of a digest of the whole row,
    whatever ``n`` is. Up to ``top_rows`` this is Spark's top-k; for a larger take the last row is
    found by quantile sketches, and only the rows taken are sorted. Either way the order columns are
    read on their own first, and the other columns only where the rows taken can be: the bound on
    the first order column is pushed down to the files. A struct orders by its fields. Order columns
    that hold arrays or variants always go through the top-k.
    """
    if not n:
        return df
    if n < 0:
        return df.limit(0)
    named = [order_by] if isinstance(order_by, str) else list(order_by)
    rows, order = _by_fields(df, named)
    by, last = [F.col(f"`{x}`") for x in order], F.md5(_row_text(df))
    # Rows that agree in all columns need no digest to come in order.
    by = by if set(df.columns) <= set(order) else [*by, last]
    if n <= top_rows or not all(isinstance(rows.schema[x].dataType, _SORT_TYPES) for x in order):
        taken = rows.filter(_first_bound(rows, n, order[0])).orderBy(*by).limit(n)
    else:
        taken = _take(rows, _ordered_cut(rows, n, order, top_rows, last)).orderBy(*by)
    return taken if rows is df else taken.select(*[F.col(f"`{c}`") for c in df.columns])


def _by_fields(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column for every field of the structs in ``order``, and the names to order by:
    a missing struct comes before all others, then field by field."""
    added: dict[str, Column] = {}

    def names(column: Column, kind: DataType, label: str) -> list[str]:
        added[f"{label}?"] = column.isNotNull()
        found = [f"{label}?"]
        for field in kind.fields:
            at, inner = f"{label}/{field.name}", column.getField(field.name)
            if isinstance(field.dataType, StructType):
                found += names(inner, field.dataType, at)
            else:
                added[at] = inner
                found.append(at)
        return found

    flat: list[str] = []
    for i, name in enumerate(order):
        kind = df.schema[name].dataType
        if isinstance(kind, StructType):
            flat += names(F.col(f"`{name}`"), kind, f"_order{i}")
        else:
            flat.append(name)
    return (df.withColumns(added) if added else df), flat


def seeded_sample(df: DataFrame, n: int, seed: int, key: str | list[str] | None = None) -> DataFrame:
    """Exactly ``n`` rows (all, when there are fewer), the same for the same seed and rows.

    ``key`` names the columns that identify a row; without it whole rows are hashed.
    """
    return _take(df, _digest_cut(df, lambda total: n, row_digest(df, seed, key)))


def assign_split(
    df: DataFrame,
    test_size: float | int,
    seed: int,
    key: str | list[str] | None = None,
    column: str = "split",
) -> DataFrame:
    """Add a column saying ``train`` or ``test``; a fractional test size is rounded up."""
    if isinstance(test_size, float) and not 0.0 <= test_size <= 1.0:
        raise ValueError("a fractional test size lies between 0 and 1")

    def rows_of(total: int) -> int:
        return math.ceil(test_size * total) if isinstance(test_size, float) else test_size

    cut = _digest_cut(df, rows_of, row_digest(df, seed, key))
    named = df.withColumn(column, F.when(cut.inside, "test").otherwise("train"))
    if cut.copies is None:
        return named
    copies = _repeat(df.filter(cut.copies), cut.total).withColumn(
        column, F.when(F.col("_copy") < cut.taken, "test").otherwise("train")
    )
    return named.filter(~cut.copies).unionByName(copies.drop("_copy"))


def assign_group_split(
    df: DataFrame, group: str, test_size: float | int, seed: int, column: str = "split"
) -> DataFrame:
    """Add a column saying ``train`` or ``test`` such that no group is on both sides.

    A group is a value of ``group``: a key, a duplicate component, or a text, so that all copies of a
    text stay together; rows without one are one group. Groups come in the order of a seeded
    digest, and the test side ends where its number of rows is nearest to ``test_size`` (a
    fraction is rounded up), so it is off by half a group at most. Groups of any size are counted,
    never collected: the end is found by rows per digits of the digest.
    """
    if isinstance(test_size, float) and not 0.0 <= test_size <= 1.0:
        raise ValueError("a fractional test size lies between 0 and 1")
    digest = row_digest(df, seed, group)
    rows = df.select(digest.alias("d"))
    buckets = _count_by_digits(rows, "")
    total = sum(bucket.n for bucket in buckets)
    n = math.ceil(test_size * total) if isinstance(test_size, float) else test_size
    if n <= 0 or n >= total:
        return df.withColumn(column, F.lit("test" if n > 0 else "train"))
    value, before, count = _nth_digest(rows, n, buckets)
    # The group that holds the n-th row goes to the test side if most of it belongs there.
    inside = digest <= value if 2 * (n - before) > count else digest < value
    return df.withColumn(column, F.when(inside, "test").otherwise("train"))


def train_test_split(
    df: DataFrame, test_size: float | int, seed: int, key: str | list[str] | None = None
) -> dict[str, DataFrame]:
    parts = assign_split(df, test_size, seed, key, column="_split")
    return {
        name: parts.filter(F.col("_split") == name).drop("_split") for name in ("train", "test")
    }


def number_rows(
    df: DataFrame,
    group: str,
    order_by: str,
    number: str = "idx",
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """1-based position of each row in its group; ``order_by`` is a number, date or time, unique in
    a group.

    Groups are ranked in one task each, except hot ones: those are cut into blocks of about
    ``block_rows`` rows, ranked block by block, and completed by the sizes of the blocks before,
    one small row each.
    """
    check_block_order(df.schema[order_by].dataType)
    place = F.row_number().over(Window.partitionBy(group).orderBy(order_by)).cast("long")
    hot = hot_hashes(df, [group], hot_rows)
    if not hot:
        return df.withColumn(number, place)
    is_hot = key_hash([group]).isin(hot)
    blocks = hot_blocks(df.filter(is_hot), hot, group, order_by, block_rows)
    inside = Window.partitionBy("_block").orderBy(order_by)
    earlier = (
        Window.partitionBy("_block.of").orderBy("_block.at").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocks.groupBy("_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    numbered = (
        blocks.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, "_block")
        .withColumn(number, F.col("_before") + F.col("_rank"))
        .select(*df.columns, number)
    )
    return df.filter(~is_hot).withColumn(number, place).unionByName(numbered)


def row_digest(df: DataFrame, seed: int, key: str | list[str] | None = None) -> Column:
    """``md5('seed:key')`` in hex, or of the whole row as JSON when no key is given."""
    if key is None:
        text = _row_text(df)
    else:
        names = [key] if isinstance(key, str) else list(key)
        text = F.concat_ws(":", *[F.col(name).cast("string") for name in names])
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def _row_text(df: DataFrame) -> Column:
    """The whole row as JSON, times in full, so that only identical rows read alike."""
    options = {
        "ignoreNullFields": "false",
        "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    }
    return F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]), options)


def _first_bound(df: DataFrame, n: int, name: str) -> Column:
    """A filter that the first ``n`` rows by ``name`` pass, NULLs first."""
    kind = df.schema[name].dataType
    if not isinstance(kind, _SORT_TYPES):
        return F.lit(True)
    first = df.select(F.col(f"`{name}`").alias("k")).orderBy("k").limit(n)
    found = first.agg(
        _as_text(F.max("k"), kind).alias("last"),
        (F.count(F.lit(1)) > F.count("k")).alias("missing"),
    ).first()
    return _up_to(name, found.last, kind, found.missing)


def _up_to(name: str, last: str | None, kind: DataType, missing: bool) -> Column:
    """Values up to ``last``; a plain comparison where no value is missing, since files can be
    skipped by that."""
    if last is None:
        return F.col(f"`{name}`").isNull()
    known = F.col(f"`{name}`") <= _from_text(last, kind)
    return F.col(f"`{name}`").isNull() | known if missing else known


def _as_text(column: Column, kind: DataType) -> Column:
    """A bound as text, from which it is read back without loss."""
    if isinstance(kind, BinaryType):
        return F.hex(column)
    if isinstance(kind, TimestampType):  # a local time that occurs twice would be ambiguous
        column = F.unix_micros(column)
    return column.cast("string")


def _from_text(text: str | None, kind: DataType) -> Column:
    if isinstance(kind, BinaryType):
        return F.unhex(F.lit(text))
    if isinstance(kind, TimestampType):
        return F.timestamp_micros(F.lit(text).cast("long"))
    return F.lit(text).cast(kind)


def _take(df: DataFrame, cut: Cut) -> DataFrame:
    inside = df.filter(cut.inside)
    if cut.copies is None or cut.taken == 0:
        return inside
    return inside.unionByName(_repeat(df.filter(cut.copies), cut.taken).drop("_copy"))


def _repeat(identical: DataFrame, times: int) -> DataFrame:
    """One of the identical rows, ``times`` over, numbered from 0 in ``_copy``."""
    one = identical.limit(1).withColumn("_one", F.lit(0))
    numbers = identical.sparkSession.range(times).select(
        F.col("id").alias("_copy"), F.lit(0).alias("_one")
    )
    # A single row, so the broadcast stays small and the numbers stay spread out.
    return numbers.join(F.broadcast(one), "_one").drop("_one")


def _digest_cut(df: DataFrame, size: Callable[[int], int], digest: Column) -> Cut:
    """The first ``size(rows)`` rows by digest, ties by the digest of the whole row."""
    rows = df.select(digest.alias("d"))
    buckets = _count_by_digits(rows, "")
    total = sum(bucket.n for bucket in buckets)
    n = size(total)
    if n <= 0:
        return Cut(F.lit(False))
    if n >= total:
        return Cut(F.lit(True))
    value, before, count = _nth_digest(rows, n, buckets)
    if before + count == n:
        return Cut(digest <= value)
    content = F.md5(_row_text(df))
    return _cut_among_ties(df, n - before, count, digest < value, digest == value, content)


def _cut_among_ties(
    df: DataFrame, n: int, count: int, sure: Column, tied: Column, content: Column
) -> Cut:
    """``n`` of the ``count`` tied rows, by ``content``, the digest of the whole row."""
    if n == count:
        return Cut(sure | tied)
    rows = df.filter(tied).select(content.alias("d"))
    value, before, same = _nth_digest(rows, n, _count_by_digits(rows, ""))
    if before + same == n:
        return Cut(sure | (tied & (content <= value)))
    below = sure | (tied & (content < value))
    return Cut(below, tied & (content == value), n - before, same)


def _count_by_digits(rows: DataFrame, prefix: str) -> list[Row]:
    """Rows per next three hex digits of the digests that start with ``prefix``."""
    inside = rows.filter(F.col("d").startswith(prefix)) if prefix else rows
    found = (
        inside.groupBy(F.substring("d", len(prefix) + 1, _HEX_PER_ROUND).alias("digits"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.xxhash64("d")).alias("low"),
            F.max(F.xxhash64("d")).alias("high"),
        )
        .collect()
    )
    return sorted(found, key=lambda row: row.digits)


def _nth_digest(rows: DataFrame, n: int, buckets: list[Row]) -> tuple[str, int, int]:
    """The n-th smallest digest, the number of rows below it and the number of rows having it.

    Each round looks inside the bucket that holds the n-th row, of at most 4,096 buckets, until
    that bucket is small or holds one digest only.
    """
    prefix, before = "", 0
    while True:
        for bucket in buckets:
            if before + bucket.n >= n:
                break
            before += bucket.n
        prefix += bucket.digits
        inside = rows.filter(F.col("d").startswith(prefix))
        if bucket.low == bucket.high:
            value = inside.first().d
            if inside.filter(F.col("d") == value).count() == bucket.n:
                return value, before, bucket.n
        if bucket.n <= SMALL:
            for row in sorted(inside.groupBy("d").count().collect()):
                if before + row["count"] >= n:
                    return row.d, before, row["count"]
                before += row["count"]
        buckets = _count_by_digits(rows, prefix)


def _ordered_cut(df: DataFrame, n: int, order: list[str], small: int, last: Column) -> Cut:
    """The first ``n`` rows by ``order``, for an ``n`` too large for one task.

    Finds the value of the n-th row column by column: each further column only orders the rows
    that agree with the n-th row in the columns before it.
    """
    kinds = [df.schema[name].dataType for name in order]
    sure, tied = F.lit(False), F.lit(True)
    reach = None
    for name, kind in zip(order, kinds, strict=True):
        found = _nth_value(df.filter(tied), n, name, kind, small)
        if found is None:
            return Cut(F.lit(True))
        value, before, same, missing = found
        if reach is None:
            reach = _up_to(name, value, kind, missing)
        if value is None:
            tied = tied & F.col(f"`{name}`").isNull()
        else:
            bound = _from_text(value, kind)
            below = F.col(f"`{name}`") < bound
            sure = sure | (tied & (F.col(f"`{name}`").isNull() | below if missing else below))
            tied = tied & (F.col(f"`{name}`") == bound)
        n -= before
        if n == same:
            return Cut(reach & (sure | tied))
    return _cut_among_ties(df, n, same, reach & sure, reach & tied, last)


def _nth_value(
    rows: DataFrame, n: int, name: str, kind: DataType, small: int
) -> tuple[str | None, int, int, bool] | None:
    """The n-th smallest value as text (NULLs first), how many rows are below it, how many have
    it and whether any value is missing; nothing when there are not more than ``n`` rows.

    A quantile sketch, merged from all tasks in one pass without a shuffle, brackets the value; the
    next pass counts exactly below, inside and at both ends of the bracket. A bracket that misses
    is widened, one that is still large is narrowed in the same way. Strings and bytes are
    searched by seven bytes at a time.
    """
    keys = rows.select(F.col(f"`{name}`").alias("k"))
    odd = F.isnan("k") if isinstance(kind, (FloatType, DoubleType)) else F.lit(False)
    number = F.when(~odd, _as_number(F.col("k"), kind, 0))
    known = keys.select("k", number.alias("m")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count("k").alias("known"),
        F.count_if(odd).alias("nan"),
        *_sketch(_is_whole(kind)),
    ).first()
    before = known.total - known.known
    if n >= known.total:
        return None
    missing = before > 0
    if n <= before:
        return None, 0, before, missing
    if n > known.total - known.nan:  # NaN comes last
        return "NaN", known.total - known.nan, known.nan, missing
    keys, inside = keys.filter(F.col("k").isNotNull() & ~odd), known.known - known.nan
    part, held = 0, known
    while inside > small:
        number = _as_number(F.col("k"), kind, part)
        numbered = keys.select("k", number.alias("m"))
        held = held or numbered.agg(*_sketch(_is_whole(kind))).first()
        below, inside, keys, single = _bracket(numbered, held, n - before, inside, _is_whole(kind))
        held = None
        before += below
        if single:
            if _is_exact(kind):
                row = keys.select(_as_text(F.col("k"), kind).alias("k")).first()
                return row.k, before, inside, missing
            if not isinstance(kind, (StringType, BinaryType)):
                break  # different decimals that are the same double
            part += 1
            if keys.select(F.max(_bytes_left(F.col("k"), part))).first()[0] == 0:
                break  # they differ in zero bytes at the end only
    counts = keys.groupBy("k").count().orderBy("k").select(_as_text(F.col("k"), kind).alias("k"), "count")
    for row in counts.collect() if inside <= small else counts.toLocalIterator():
        if before + row["count"] >= n:
            return row.k, before, row["count"], missing
        before += row["count"]
    raise AssertionError("rows changed while they were counted")


def _is_exact(kind: DataType) -> bool:
    """Whether values of the type are equal where their numbers are."""
    return not isinstance(kind, (StringType, BinaryType, DecimalType))


def _bytes_left(column: Column, part: int) -> Column:
    return F.greatest(F.lit(0), F.octet_length(column) - part * _BYTES)


def _as_number(column: Column, kind: DataType, part: int) -> Column:
    """A number that never falls where the value rises; of strings and bytes, the ``part``-th seven
    bytes, for values that agree in those before."""
    if isinstance(kind, (StringType, BinaryType)):
        piece = F.substring(column.cast("binary"), part * _BYTES + 1, _BYTES)
        return F.conv(F.rpad(F.hex(piece), 2 * _BYTES, "0"), 16, 10).cast("long")
    if isinstance(kind, TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, TimestampNTZType):
        days = F.unix_date(column.cast("date")).cast("long")
        minutes = days * 1440 + F.hour(column) * 60 + F.minute(column)
        return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), column) * 1_000_000).cast("long")
    if isinstance(kind, DateType):
        return F.unix_date(column).cast("long")
    return column.cast("long" if isinstance(kind, (IntegralType, BooleanType)) else "double")


def _is_whole(kind: DataType) -> bool:
    """Whether the number of a value is a whole one."""
    return not isinstance(kind, (DecimalType, DoubleType, FloatType))


def _sketch(whole: bool) -> list[Column]:
    sketch = F.kll_sketch_agg_bigint if whole else F.kll_sketch_agg_double
    return [sketch("m", _SKETCH).alias("sketch"), F.min("m").alias("low"), F.max("m").alias("high")]


def _bracket(
    keys: DataFrame, held: Row, n: int, total: int, whole: bool
) -> tuple[int, int, DataFrame, bool]:
    """Of ``total`` rows (``k``, its number ``m``) the part that holds the n-th: the rows below it,
    its rows, the part itself, and whether it has one number only. ``held`` is what ``_sketch``
    gives for all of them."""
    value_at = F.kll_sketch_get_quantile_bigint if whole else F.kll_sketch_get_quantile_double
    slack = _SKETCH_ERROR
    m = F.col("m")
    while True:
        shares = [n / total - slack, n / total + slack]
        ends = keys.sparkSession.createDataFrame([(held.sketch,)], "s binary").select(
            *[value_at("s", F.lit(min(max(x, 0.0), 1.0))) for x in shares]
        )
        low, high = ends.first()
        low = held.low if shares[0] <= 0 else low
        high = held.high if shares[1] >= 1 else high
        counts = keys.agg(
            F.count_if(m < low).alias("below"),
            F.count_if(m == low).alias("at_low"),
            F.count_if((m > low) & (m < high)).alias("between"),
            F.count_if((m == high) & (m > low)).alias("at_high"),
        ).first()
        upper = counts.below + counts.at_low + counts.between
        if counts.below < n <= upper + counts.at_high:
            break
        slack *= 4
    if n <= counts.below + counts.at_low:
        return counts.below, counts.at_low, keys.filter(m == low).select("k"), True
    if n > upper:
        return upper, counts.at_high, keys.filter(m == high).select("k"), True
    inside = keys.filter((m > low) & (m < high)).select("k")
    return counts.below + counts.at_low, counts.between, inside, False
