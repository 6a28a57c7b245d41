"""Reading, writing, sampling, splitting, numbering."""

from pyspark.sql import functions as F

from loomset import schemas
from loomset.operators import sampling, turns
from loomset.plans import flows, inputs
from loomset.plans.catalog.chats import FLAT_TURNS_SQL
from loomset.plans.catalog.registry import query
from loomset.session import shared_path
from loomset.sources import datasets


def _split(key):
    return F.when(F.col(key) % 5 == 0, "test").otherwise("train").alias("split")


@query(f"SELECT * FROM ({FLAT_TURNS_SQL}) WHERE conv_id % 5 <> 0")
def training_split(spark, sf_dir):
    """Conversations stored with a train and a test split; the training split is read."""
    root = shared_path(spark, "datasets")
    chats = inputs.chat_rows(spark, sf_dir).select("*", _split("conv_id"))
    datasets.write_dataset(chats, root, "chats")
    schema = f"conv_id long, {schemas.CHAT}"
    stored = datasets.load_dataset(spark, root, "chats", schema=schema)
    return turns.messages_to_turns(stored, "conv_id", keep_empty=True)


@query(f"SELECT * FROM ({inputs.MATH_SQL}) WHERE o_orderkey % 5 = 0")
def configured_split(spark, sf_dir):
    """The test split of one configuration of a dataset."""
    root = shared_path(spark, "datasets")
    examples = inputs.math_examples(spark, sf_dir).select("*", _split("o_orderkey"))
    datasets.write_dataset(examples, root, "math", config="main")
    return datasets.load_dataset(
        spark, root, "math", config="main", split="test",
        schema=f"o_orderkey long, {schemas.MATH_RAW}",
    )


@query(f"SELECT * FROM ({inputs.MATH_SQL}) WHERE o_orderkey % 5 = 0 ORDER BY o_orderkey LIMIT 100")
def limited_split(spark, sf_dir):
    """The first 100 examples of a split."""
    root = shared_path(spark, "datasets")
    examples = inputs.math_examples(spark, sf_dir).select("*", _split("o_orderkey"))
    datasets.write_dataset(examples, root, "math", config="main")
    return datasets.load_dataset(
        spark, root, "math", config="main", split="test", limit=100, order_by="o_orderkey",
        schema=f"o_orderkey long, {schemas.MATH_RAW}",
    )


@query(inputs.TEXT_TO_SQL_SQL)
def text_to_sql_source(spark, sf_dir):
    """Text-to-SQL examples stored as JSON lines in the dataset layout."""
    root = shared_path(spark, "datasets")
    examples = inputs.text_to_sql(spark, sf_dir).withColumn("split", F.lit("train"))
    datasets.write_dataset(examples, root, "text-to-sql", file_format="json")
    return datasets.load_dataset(
        spark, root, "text-to-sql", file_format="json",
        schema=f"p_partkey long, {schemas.TEXT_TO_SQL}",
    )


@query(FLAT_TURNS_SQL)
def jsonl_round_trip(spark, sf_dir):
    chats = inputs.chat_rows(spark, sf_dir)
    schema = f"conv_id long, {schemas.CHAT}"
    _, stored = datasets.write_and_reread({"train": chats}, shared_path(spark, "jsonl"), schema)
    return turns.messages_to_turns(stored, "conv_id", keep_empty=True)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1000")
def first_rows(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sampling.take_first(orders, 1000, ["o_totalprice", "o_orderkey"])


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
    ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
    LIMIT 50000""")
def first_rows_by_range(spark, sf_dir):
    """A take done by range counts, as one too large for a single task would be."""
    order = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    lines = inputs.table(spark, sf_dir, "lineitem").select(*order)
    return sampling.take_first(lines, 50_000, order)


@query("""
    SELECT o_orderkey, o_custkey FROM orders
    ORDER BY md5('42:' || o_orderkey) LIMIT 12500""")
def seeded_sample(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return sampling.seeded_sample(orders, flows.SQL_EXAMPLES, 42, "o_orderkey")


@query("""
    SELECT p_partkey, CASE WHEN place <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split
    FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5('7:' || p_partkey)) AS place,
                 count(*) OVER () AS n FROM part)""")
def train_test_split(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part").select("p_partkey")
    return sampling.assign_split(parts, flows.SQL_TEST_SHARE, 7, "p_partkey")


@query("""
    WITH orders_of AS (
        SELECT l_orderkey, count(*) AS c, sum(count(*)) OVER (ORDER BY md5('8:' || l_orderkey)) - count(*) AS before
        FROM lineitem GROUP BY l_orderkey),
    wanted AS (SELECT ceil(0.2::DOUBLE * count(*)) AS n FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN 2 * (n - before) > c THEN 'test' ELSE 'train' END AS split
    FROM lineitem JOIN orders_of USING (l_orderkey), wanted""")
def grouped_split(spark, sf_dir):
    """A fifth of all lines for testing, all lines of an order on one side."""
    lines = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return sampling.assign_group_split(lines, "l_orderkey", 0.2, 8)


@query("""
    WITH texts AS (
        SELECT text, count(*) AS c, sum(count(*)) OVER (ORDER BY md5('8:' || text)) - count(*) AS before
        FROM documents GROUP BY text),
    wanted AS (SELECT ceil(0.1::DOUBLE * count(*)) AS n FROM documents)
    SELECT doc_id, CASE WHEN 2 * (n - before) > c THEN 'test' ELSE 'train' END AS split
    FROM documents JOIN texts USING (text), wanted""")
def copies_on_one_side(spark, sf_dir):
    """No text of the test side is seen in training."""
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return sampling.assign_group_split(documents, "text", 0.1, 8).drop("text")


LINES_SQL = """
    SELECT doc_id, n_chars, CASE doc_id % 7
               WHEN 0 THEN '{"id": ' || doc_id || ', "n": ' || n_chars
               WHEN 1 THEN '{"id": ' || doc_id || ', "n": "many"}'
               WHEN 2 THEN '[' || doc_id || ']'
               WHEN 3 THEN '{"id": ' || doc_id || ', "more": {"n": 1}}'
               ELSE '{"id": ' || doc_id || ', "n": ' || n_chars || '}' END AS line
    FROM documents"""


def _lines(spark, sf_dir):
    """A file of JSON lines of which some are cut off, of another type, or no objects."""
    key, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    start, which = F.concat(F.lit('{"id": '), key), F.col("doc_id") % 7
    line = (
        F.when(which == 0, F.concat(start, F.lit(', "n": '), n))
        .when(which == 1, F.concat(start, F.lit(', "n": "many"}')))
        .when(which == 2, F.concat(F.lit("["), key, F.lit("]")))
        .when(which == 3, F.concat(start, F.lit(', "more": {"n": 1}}')))
        .otherwise(F.concat(start, F.lit(', "n": '), n, F.lit("}")))
    )
    path = shared_path(spark, "lines")
    inputs.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(path)
    return datasets.read_jsonl_strictly(spark, path, "id long, n long", most_bad=0.5)


@query(f"""
    SELECT doc_id AS id, CASE WHEN doc_id % 7 <> 3 THEN n_chars END AS n FROM ({LINES_SQL}) WHERE doc_id % 7 > 2""")
def well_formed_lines(spark, sf_dir):
    return _lines(spark, sf_dir)[0]


@query(f"SELECT line FROM ({LINES_SQL}) WHERE doc_id % 7 <= 2")
def quarantined_lines(spark, sf_dir):
    return _lines(spark, sf_dir)[1].select("line")


@query("""
    SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx
    FROM events""")
def numbered_rows(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events").select("event_id", "user_id")
    return sampling.number_rows(events, "user_id", "event_id")


@query("""
    SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS idx
    FROM events""")
def numbered_rows_hot(spark, sf_dir):
    """Few groups, each of which is cut into blocks."""
    events = inputs.table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.number_rows(events, "event_type", "event_id", hot_rows=500, block_rows=400)


@query(f"""
    SELECT '<|im_start|>system' || chr(10) || 'You are an text to SQL query translator...<|im_end|>' || chr(10)
           || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10)
           || '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>' || chr(10) AS text
    FROM (SELECT *, row_number() OVER (ORDER BY md5('6:' || p_partkey)) AS place, count(*) OVER () AS n
          FROM (SELECT * FROM ({inputs.TEXT_TO_SQL_SQL}) ORDER BY md5('5:' || p_partkey) LIMIT 12500))
    WHERE place > ceil(0.2 * n)""")
def text_to_sql_training(spark, sf_dir):
    """The whole text-to-SQL flow, from examples to training text."""
    examples = inputs.text_to_sql(spark, sf_dir)
    return flows.text_to_sql_training(
        examples, shared_path(spark, "sql"), "part", seed=5, key="p_partkey"
    )


@query(f"""
    SELECT conv_id, count(*)::INTEGER AS n_messages FROM ({inputs.TURNS_SQL}) GROUP BY conv_id""")
def row_mapper(spark, sf_dir):
    """A mapper is a function from table to table that keeps only what it computes."""

    def mapper(df):
        asked = F.count(F.when(F.col("role") == "user", 1)).cast("int").alias("asked")
        return df.groupBy("conv_id").agg(asked, F.count("*").cast("int").alias("n_messages"))

    return inputs.table(spark, sf_dir, "conversations").transform(mapper).drop("asked")
