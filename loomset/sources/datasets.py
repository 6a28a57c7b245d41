"""Datasets as folders: ``root/name[/config]/split=<split>/...`` in any file format of Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomset.operators.sampling import take_first
from loomset.schemas import CHAT


def dataset_path(root: str, name: str, config: str | None = None) -> str:
    return "/".join([root.rstrip("/"), name, *([config] if config else [])])


def load_dataset(
    spark: SparkSession,
    root: str,
    name: str,
    config: str | None = None,
    split: str = "train",
    limit: int | None = None,
    order_by: str | list[str] | None = None,
    schema: str | StructType | None = None,
    file_format: str = "parquet",
    files: str | None = None,
) -> DataFrame:
    """One split of a dataset; only that split's folder is read.

    ``files`` is for datasets that tell splits by file name instead, a pattern with a
    ``{split}`` slot such as ``{split}-*.parquet`` or ``{split}_dataset.json``.

    ``limit`` takes the first rows in the order of ``order_by``, since stored order means
    nothing once files are read in parallel; ``None`` and 0 take all.
    """
    reader = spark.read.format(file_format)
    if schema:
        reader = reader.schema(schema)
    elif file_format in ("json", "csv"):
        raise ValueError(f"{file_format} files need a schema")
    path = dataset_path(root, name, config)
    if files:
        df = reader.load(f"{path}/{files.format(split=split)}")
    else:
        df = reader.load(path).filter(F.col("split") == split).drop("split")
    if limit and order_by is None:
        raise ValueError("a limit needs order_by")
    return take_first(df, limit, order_by) if limit else df


def load_splits(
    spark: SparkSession, root: str, name: str, splits: list[str], **options
) -> dict[str, DataFrame]:
    return {split: load_dataset(spark, root, name, split=split, **options) for split in splits}


def read_jsonl(spark: SparkSession, path: str, schema: str = CHAT) -> DataFrame:
    """JSON lines with a stated schema. Lines that do not fit it become rows of NULLs;
    ``read_jsonl_strictly`` keeps them apart."""
    return spark.read.schema(schema).json(path)


def read_jsonl_strictly(
    spark: SparkSession,
    path: str,
    schema: str | StructType = CHAT,
    most_bad: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The well-formed lines as rows of ``schema``, and a quarantine table ``file, line`` of the
    others, each as it stands in its file.

    A line is bad if it is no JSON object or if a field does not have its type; fields that lack
    are NULL, further ones are ignored, and so is what stands behind the object. Empty lines are neither. With ``most_bad`` the lines are
    counted first, and a larger share of bad ones is an error.
    """
    wanted = spark.createDataFrame([], schema).schema
    bad = _BAD
    while bad.lower() in (name.lower() for name in wanted.names):
        bad = f"_{bad}"
    # A file's lines are read as they are, so that the quarantine has every byte that is text.
    lines = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
        .filter(F.trim("line") != "")
    )
    read = StructType([*_all_nullable(wanted).fields, StructField(bad, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    parsed = lines.withColumn("row", F.from_json("line", read, options))
    is_bad = F.col("row").isNull() | F.col("row").getField(bad).isNotNull() | ~_is_object("line")
    if most_bad is not None:
        counts = parsed.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_bad).alias("bad")).first()
        if counts.bad > most_bad * counts.n:
            raise ValueError(f"{counts.bad} of {counts.n} lines of {path} are no rows")
    good = parsed.filter(~is_bad).select(*[F.col("row").getField(f.name).alias(f.name) for f in wanted])
    return good, parsed.filter(is_bad).select("file", "line")


# The column in which Spark's JSON reader puts what it cannot read.
_BAD = "_corrupt_record"


def _is_object(line: str) -> Column:
    """An array would be read as its first object."""
    return F.startswith(F.ltrim(line), F.lit("{"))


def _all_nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def write_dataset(
    df: DataFrame,
    root: str,
    name: str,
    config: str | None = None,
    split_column: str = "split",
    file_format: str = "parquet",
    mode: str = "errorifexists",
) -> str:
    """Write a table with a split column in the layout ``load_dataset`` reads."""
    path = dataset_path(root, name, config)
    writer = df.withColumnRenamed(split_column, "split").write.partitionBy("split").mode(mode)
    if file_format == "json":
        writer = writer.option("ignoreNullFields", "false")
    writer.format(file_format).save(path)
    return path


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """One JSON object per row; NULL fields are written out."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def write_splits_jsonl(splits: dict[str, DataFrame], root: str, mode: str = "errorifexists") -> dict[str, str]:
    """Each split to its own folder of JSON lines."""
    return {
        name: write_jsonl(df, f"{root.rstrip('/')}/split={name}", mode) for name, df in splits.items()
    }


def write_and_reread(
    splits: dict[str, DataFrame], root: str, schema: str = CHAT, reread: str = "train"
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write every split, hand back the splits and the ``reread`` one as stored."""
    paths = write_splits_jsonl(splits, root)
    return splits, read_jsonl(next(iter(splits.values())).sparkSession, paths[reread], schema)
