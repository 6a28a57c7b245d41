"""Operators that compare rows with each other, against brute force."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomset.llm import decontaminate, near_duplicates, neighbours, quality, toxicity
from loomset.llm.catalog import SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = db.execute(SQL[name])
    names = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SF_DIR).select(*names)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def similar(texts):
    sets = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    above = list(range(len(texts)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= 75 * len(sets[i] | sets[j]):
                above[top(i)] = top(j)
    return sets, [top(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_of_a_crowded_group(spark, monkeypatch, block):
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(block)
    rows = []
    for _ in range(6):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(200)}" for _ in range(90)]
        for _ in range(25):
            words = base[:]
            for _ in range(rng.randrange(7)):
                words[rng.randrange(90)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A b"), (904, "A b"), (None, "a b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit("extra"))
    sets, tops = similar([t for _, t in rows])
    least = {}
    for (key, _), top in zip(rows, tops, strict=True):
        if key is not None:
            least[top] = min(least.get(top, key), key)
    want = Counter((key, len(s), least.get(t), key == least.get(t)) for (key, _), s, t in zip(rows, sets, tops, strict=True))
    assert Counter(map(tuple, near_duplicates.near_duplicate_groups(df).collect())) == want
    kept = near_duplicates.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(tops))
    assert near_duplicates.near_duplicate_groups(df.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, left, right = (rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (600, 200, 200))
    items = np.concatenate([shared, left, shared, right])
    bins = near_duplicates.sketches(items, np.repeat([0, 1], 800), 2)
    assert abs((bins[0] == bins[1]).mean() - 0.6) < 0.15
    few = near_duplicates.sketches(np.array([7, 7, 9], np.uint64), np.array([0, 0, 0]), 1)
    assert (few != np.iinfo(np.uint64).max).all()


def test_decontamination_of_odd_rows(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:25])), (2, "Short item"), (3, "solo"), (4, None), (5, ""), (6, "short ITEM"), (6, "short ITEM")]
    docs = [
        (1, "x " + " ".join(words[3:16]) + " y"),  # 13 words of item 1
        (2, " ".join(words[:9])),  # too short a stretch
        (3, "a short, item b solo"),
        (4, None), (5, ""), (6, "solo"), (6, "solo"), (None, "SOLO solo"),
        (7, " ".join(words[:12] + ["gap"] + words[12:25])),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("document", F.lit(1))
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(df, benchmark).collect())
    assert got == Counter({
        (1, 15, 13, 1, True): 1, (2, 9, 0, 0, False): 1, (3, 5, 3, 3, True): 1, (4, 0, 0, 0, False): 1, (5, 0, 0, 0, False): 1,
        (6, 1, 1, 1, True): 2, (None, 2, 2, 1, True): 1, (7, 26, 25, 1, True): 1,
    })
    kept = decontaminate.drop_contaminated(df, benchmark)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]
    assert decontaminate.contamination(df, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), benchmark).count() == 0
    near = decontaminate.proximity_matches(df, benchmark, slop=2)
    assert 7 in {r.doc_id for r in near.collect()}


def test_benchmark_terms_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_TERMS", 3)
    monkeypatch.setattr(decontaminate, "BROADCAST_CONTEXTS", 1)
    words = [f"w{i}" for i in range(30)]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    df = spark.createDataFrame([(1, " ".join(words[5:20]))], "doc_id long, text string")
    assert decontaminate.contamination(df, benchmark).first().n_hit == 15


def test_hilbert_numbers_are_a_walk():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = cells[np.argsort(neighbours.hilbert_numbers(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("stretch", [16, 4096])
def test_nearest_against_brute_force(spark, stretch):
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=8).round(2).tolist() for _ in range(150)]
    vectors += [vectors[3]] * 60  # a hot vector
    vectors += [(np.array(vectors[7]) + rng.normal(size=8) * 0.01).tolist() for _ in range(40)]
    rows = list(enumerate(vectors)) + [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [1.0]), (980, [None] * 8), (0, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, k=5, stretch=stretch).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    matrix = np.array(vectors)
    for q in range(0, len(vectors), 20):
        scores = (matrix * matrix[q]).sum(1)
        scores[q] = -np.inf
        order = np.lexsort((np.arange(len(vectors)), -scores))[:5]
        assert [(i + 1, v) for i, v in enumerate(order.tolist())] == [(a, b) for a, b, _ in sorted(got[q])]
    assert set(got) == set(range(0, len(vectors), 20))
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_benchmark_items_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(None, " ".join(words[:12])), (None, " ".join(words[20:31])), (7, " ".join(words[40:52]))]
    docs = [(1, " ".join(words[:35])), (2, " ".join(words)), (3, "x " + " ".join(words[40:52])), (4, "nothing")]
    documents = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    benchmark = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    db = duckdb.connect()
    db.register("documents", documents.toArrow())
    db.register("benchmark", benchmark.toArrow())
    want = db.execute(SQL["op7_decontamination"])
    names = [d[0] for d in want.description]
    got = decontaminate.contamination(documents, benchmark).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert {r.doc_id: r.n_hit for r in got.collect()} == {1: 23, 2: 35, 3: 12, 4: 0}
    assert [r.doc_id for r in decontaminate.drop_contaminated(documents, benchmark).collect()] == [4]


def test_near_copies_of_one_vector_are_cut_into_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 8))
    vectors[100:] = vectors[0] + rng.normal(size=(300, 8)) * 1e-6  # one cell of every curve
    whole = neighbours.best_of

    def bounded(queries, query_ids, found, *rest):
        if len(found) > 64:
            raise ValueError(f"{len(found)} vectors in one task")
        return whole(queries, query_ids, found, *rest)

    monkeypatch.setattr(neighbours, "best_of", bounded)
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, k=5, stretch=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 400, 20):
        scores = (vectors * vectors[q]).sum(1)
        scores[q] = -np.inf
        order = np.lexsort((np.arange(400), -scores))[:5]
        assert list(enumerate(order.tolist(), 1)) == sorted(got[q])


def test_best_in_blocks_is_best_of_all(monkeypatch):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, size=(500, 3)).astype(float)
    ids = rng.permutation(500)
    least = np.where(np.arange(40) % 2, -np.inf, 5.0)
    want = [neighbours.best_of(vectors[:40], ids[:40], vectors, ids, 7, x) for x in (None, least)]
    monkeypatch.setattr(neighbours, "VECTORS", 64)
    got = [neighbours.best_of(vectors[:40], ids[:40], vectors, ids, 7, x) for x in (None, least)]
    for a, b in zip(want, got, strict=True):
        assert [x.tolist() for x in a[0]] == [x.tolist() for x in b[0]]
        assert [x.tolist() for x in a[1]] == [x.tolist() for x in b[1]]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(texts, items):
    windows = set()
    for item in items:
        words = words_of(item)
        size = min(10, len(words))
        windows |= {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    sizes = {len(w) for w in windows}
    found = [words_of(text) for text in texts]
    return [any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)) for w in found]


def test_pipeline_keeps_just_what_each_stage_should(spark):
    """The ids that are left, worked out stage by stage without Spark, but for the fitted models."""
    import corpus_pipeline

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = {r.doc_id: r.text for r in documents.collect()}
    good = quality.fit_quality(documents.select("doc_id", "text"), labels)
    rated = {i: t for i, t in rows.items() if good.tails([t or ""])[0, 0] >= quality.KEEP}
    left = documents.filter(F.col("doc_id").isin(list(rated)))
    civil = toxicity.fit_toxicity(left.select("doc_id", "text"), labels)
    civil_rows = {i: t for i, t in rated.items() if civil.scores([t or ""])[0] < toxicity.PREDICT}
    sets, tops = similar(list(civil_rows.values()))
    least = {}
    for i, top in zip(civil_rows, tops, strict=True):
        least[top] = min(least.get(top, i), i)
    unique = {i: civil_rows[i] for i in least.values()}
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = contaminated(list(unique.values()), items)
    want = {i for i, h in zip(unique, hit, strict=True) if not h}
    assert len(rows) > len(rated) > len(civil_rows) > len(unique) > len(want) > 50
    got = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert got.filter("NOT intact").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "byte_bpe"]


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_pipeline_over_an_empty_table(spark, tmp_path, empty):
    import corpus_pipeline

    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        table = table.limit(0) if name == empty else table.limit(40)
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() == 0) == (empty == "documents")


def test_words_of_decontamination_at_every_boundary(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [chr(c).join(["Ab", "c9É", "", "𝒳z"]) for c in [*range(128), 0x80, 0xA0, 0x2003, 0x130, 0x1F600]]
    texts += ["", " ", "  a  ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    lower = str.maketrans(decontaminate.UPPER, decontaminate.UPPER.lower())
    got = rows.select("i", decontaminate.words_of(F.col("text")).alias("w"), decontaminate.count_words(F.col("text")).alias("n"))
    for r in got.collect():
        want = word.findall((texts[r.i] or "").translate(lower))
        assert (r.w, r.n) == (want, len(want))
