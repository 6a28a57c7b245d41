import pytest
from pyspark.sql import functions as F

from loomset import schemas
from loomset.sources import datasets

ODD = [
    (1, [("user", "a\nb\u2028cé"), ("assistant", None)]),
    (2, []),
    (3, None),
    (4, [("user", '"quoted" \\ / \t')]),
]
SCHEMA = f"id int, {schemas.CHAT}"


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ODD, SCHEMA)
    splits = {"train": df.filter("id < 4"), "test": df.filter("id >= 4")}
    same, train = datasets.write_and_reread(splits, str(tmp_path / "out"), SCHEMA)
    assert same is splits
    assert sorted(train.collect()) == sorted(splits["train"].collect())
    files = (tmp_path / "out" / "split=train").glob("part-*")
    lines = [line for f in files for line in f.read_text().split("\n") if line]
    assert len(lines) == 3 and '{"id":3,"messages":null}' in lines
    test = datasets.load_dataset(spark, str(tmp_path), "out", split="test", schema=SCHEMA, file_format="json")
    assert test.collect() == splits["test"].collect()
    with pytest.raises(Exception, match="already exists"):
        datasets.write_splits_jsonl(splits, str(tmp_path / "out"))


@pytest.mark.parametrize("file_format", ["parquet", "json", "csv", "orc"])
def test_only_the_split_is_read(spark, tmp_path, file_format):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("part"))
    datasets.write_dataset(df, str(tmp_path), "d", "main", split_column="part", file_format=file_format)
    got = datasets.load_dataset(
        spark, str(tmp_path), "d", "main", split="test", schema="id long", file_format=file_format
    )
    assert sorted(r.id for r in got.collect()) == list(range(0, 100, 4))
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "= test)]" in plan
    some = datasets.load_dataset(
        spark, str(tmp_path), "d", "main", limit=3, order_by="id", schema="id long", file_format=file_format
    )
    assert [r.id for r in some.collect()] == [1, 2, 3]
    both = datasets.load_splits(
        spark, str(tmp_path), "d", ["train", "test"], config="main", schema="id long", file_format=file_format
    )
    assert {name: part.count() for name, part in both.items()} == {"train": 75, "test": 25}


def test_guards(spark, tmp_path):
    spark.range(3).withColumn("split", F.lit("train")).write.partitionBy("split").parquet(str(tmp_path / "d"))
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, str(tmp_path), "d", limit=2)
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, str(tmp_path), "d", file_format="json")


def test_splits_told_by_file_name(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "train_dataset.json").write_text('{"id": 1}\n{"id": 2}\n')
    (folder / "test_dataset.json").write_text('{"id": 3}\n')
    options = {"schema": "id long", "file_format": "json", "files": "{split}_dataset.json"}
    got = datasets.load_splits(spark, str(tmp_path), "d", ["train", "test"], **options)
    assert {name: sorted(r.id for r in df.collect()) for name, df in got.items()} == {"train": [1, 2], "test": [3]}


def test_broken_lines_are_kept_apart(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    good = ['{"id":1,"messages":[{"role":"user","content":"a\\u2028b"}]}', '{"id":2}', '  {"id":3,"messages":null,"more":[1]}', '{}', '{"ID":5}']
    bad = ['{"id":1', "no json", "[1]", '[{"id":6}]', "7", '{"id":"x"}', '{"id":8,"messages":"none"}', "null", '"{}"']
    (folder / "one.json").write_text("\n".join([*good, "", "   ", *bad[:5]]))
    (folder / "two.json").write_text("\n".join(bad[5:]) + "\n")
    rows, broken = datasets.read_jsonl_strictly(spark, str(folder), SCHEMA)
    assert rows.columns == ["id", "messages"]
    assert sorted((r.id or 0) for r in rows.collect()) == [0, 0, 1, 2, 3]
    assert {r.messages[0].content for r in rows.filter("id = 1").collect()} == {"a\u2028b"}
    found = {(r.file.rsplit("/", 1)[-1], r.line) for r in broken.collect()}
    assert found == {("one.json", x) for x in bad[:5]} | {("two.json", x) for x in bad[5:]}
    assert datasets.read_jsonl_strictly(spark, str(folder), SCHEMA, most_bad=0.65)[0].count() == 5
    with pytest.raises(ValueError, match="9 of 14 lines"):
        datasets.read_jsonl_strictly(spark, str(folder), SCHEMA, most_bad=0.6)


def test_a_column_may_have_the_name_of_the_corrupt_one(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"_corrupt_record": "mine"}\n{"_corrupt_record": [1]\n')
    rows, broken = datasets.read_jsonl_strictly(spark, str(tmp_path / "x.json"), "_corrupt_record string")
    assert [r[0] for r in rows.collect()] == ["mine"] and broken.count() == 1
