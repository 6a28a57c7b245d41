"""Operators that count phrases, words and passages over a whole corpus, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomset.llm import bitmaps, collocations, repeats, spelling, words
from loomset.llm.catalog import SQL

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sql_rows(name, documents):
    db = duckdb.connect()
    db.register("documents", documents.toArrow())
    want = db.execute(SQL[name])
    return [d[0] for d in want.description], Counter(want.fetchall())


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n", max_size=12), max_size=6))
def test_word_hashes(texts):
    raw = " ".join(texts).replace("\n", " ").encode()
    found = words.find_words(raw, np.frombuffer(raw, np.uint8) != 0x20)
    want = raw.split()
    assert [raw[a:b] for a, b in zip(found.starts, found.ends, strict=True)] == want
    for a, x in zip(want, found.hashes, strict=True):
        for b, y in zip(want, found.hashes, strict=True):
            assert (a == b) == (x == y)


def test_words_longer_than_a_stretch(monkeypatch):
    raw = b"ab " + b"x" * 50 + b" ab " + b"x" * 50 + b" " + b"y" * 50
    monkeypatch.setattr(words, "STRETCH", 8)
    found = words.find_words(raw, np.frombuffer(raw, np.uint8) != 0x20).hashes
    assert found[0] == found[2] and found[1] == found[3] and len(set(found.tolist())) == 3


def test_bitmap_has_every_key(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000)
    salts = rng.integers(0, 8, 5000)
    df = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, salts, strict=True)], "key long, salt int")
    plain, salted = bitmaps.bitmap_of(df).value, bitmaps.bitmap_of(df, salt="salt").value
    assert bitmaps.contains(plain, keys.view(np.uint64)).all()
    assert bitmaps.contains(salted, keys.view(np.uint64), salts).all()
    others = rng.integers(-(1 << 63), 1 << 63, 5000).view(np.uint64)
    assert bitmaps.contains(plain, others).mean() < 0.05
    assert not bitmaps.contains(bitmaps.bitmap_of(df.limit(0)).value, others).any()


# Collocations


@pytest.mark.parametrize("portion", [8 << 20, 3000])
def test_collocations_match_sql(spark, monkeypatch, portion):
    monkeypatch.setattr(collocations, "PORTION", portion)
    rng = random.Random(portion)
    some = "New York, new york the  of\tand I'm é Ω".split(" ")
    rows = []
    for i in range(400):
        text = "".join(rng.choice(some) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "? "]) for _ in range(rng.randrange(60)))
        rows.append((i, text, rng.choice(["en", "de", None])))
    rows += [(900, None, "en"), (901, "", None), (902, " \t\n..", "de"), (903, "a b " * 3000, "xx"), (903, "a b " * 3000, "xx"), (None, "c c c c c " * 20, "en")]
    df = documents(spark, rows).withColumn("N", F.lit(1)).withColumn("phrase", F.lit("x"))
    names, want = sql_rows("op11_collocations", df.select("text", "lang"))
    got = collocations.collocations(df).select(*names)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.filter("doc_id = 902")).count() == 0


def test_collocation_arithmetic_is_exact(spark):
    big = 9_000_000_000_000_000_000
    rows = [("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "c", 1, big), ("en", "a b", 2, big - 2), ("en", "b c", 2, 77), ("en", "a b c", 3, 77)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, words int, f long")
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in collocations.scored(phrases).collect()}
    assert got["a b"] == (big - 2, big, big - 1, 2_000_000 * (big - 2) // (2 * big - 1))
    assert got["a b c"] == (77, big, 77, 2_000_000 * 77 // (big + 77))
    assert {r.phrase: r.most for r in collocations.covered(phrases).collect()} == {"a b": 77, "b c": 77}


def test_first_phrases_are_those_of_all_parts(spark, monkeypatch):
    df = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    few = collocations.collocations(df, top=7).collect()
    every = [r for r in collocations.collocations(df).collect() if r["rank"] <= 7]
    assert sorted(few) == sorted(every)


def test_shards_find_what_is_frequent_in_one_of_them(spark):
    """All occurrences stand in one text, so in one shard; and support is one in small shards."""
    rows = [(i, f"lone{i} word{i}", "en") for i in range(50)] + [(99, "very rare pair. " * 30, "en")]
    got = collocations.collocations(documents(spark, rows)).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n) for r in got] == [("very rare pair", 30, 30, 30, 190)]


# Spelling


def spelling_by_force(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 3}
    near = defaultdict(set)
    alphabet = sorted({c for w in n for c in w})
    for w in n if len(alphabet) < 120 else ():
        for i in range(len(w) + 1):
            tries = {w[:i] + c + w[i:] for c in alphabet}
            if i < len(w):
                tries |= {w[:i] + c + w[i + 1 :] for c in alphabet} | {w[:i] + w[i + 1 :]}
            near[w] |= {t for t in tries if t in n and t != w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def spelled(df):
    rows = spelling.spelling_variants(df).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_spelling_of_the_tables(spark):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in entry.queries()["op12_spelling_variants"](spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got == spelling_by_force(rows) and any(x[0] for x in got.values())


@pytest.mark.parametrize(("block", "pairs", "rare"), [(2048, 1 << 19, 100), (5, 64, 3)])
def test_spelling_of_crowded_words(spark, monkeypatch, block, pairs, rare):
    """Short words over few letters: every list is full, every edit possible."""
    for name, value in (("BLOCK", block), ("PAIRS", pairs), ("RARE", rare), ("BROADCAST_LISTS", block)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(block)
    vocabulary = ["".join(rng.choice("aabÀ") for _ in range(rng.randrange(5, 9))) for _ in range(250)]
    vocabulary += ["x" * 3000 + c for c in "abc"] + ["x" * 3000, "ÿ" * 5, "×" * 6]
    text = [" ".join(rng.choices(vocabulary, k=30)) for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(text)] + [(7, text[7]), (None, text[0]), (None, None), (900, ""), (901, "1 2-3 abc"), (902, ("x" * 3000 + "a ") * 40 + "x" * 3000 + "B-" + "ΩÀbcdé " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(0)).withColumn("n", F.lit(0))
    got = spelled(df)
    assert got == spelling_by_force(rows)
    assert len({x[1] for x in got.values()}) < len(got)
    assert spelled(df.limit(0)) == {}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcÀ", min_size=5, max_size=9), st.integers(0, 8), st.sampled_from("abcÀx"), st.sampled_from("idr"), st.sets(st.text(alphabet="abcÀ^$", min_size=2, max_size=4)))
def test_near_words_share_a_list(word, at, letter, kind, frequent):
    """With any dictionary, two words one edit apart meet under one gram at the same place."""
    at = min(at, len(word) - 1)
    other = word[:at] + ("" if kind == "d" else letter) + word[at + (kind != "i") :]
    if other == word or len(other) < 5:
        return
    dictionary = {gram: 101 + len(gram) for gram in frequent}
    lists = [
        {key for at, gram in spelling.signature(w, dictionary) for key in ((gram, 0, at), (gram, 1, len(w) - at))}
        for w in (word, other)
    ]
    assert lists[0] & lists[1]


def test_crc32_goes_on():
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 5, 9, 70]))) for _ in range(200)]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(200)], np.uint32)
    got = spelling.crc32_of(raw, starts, ends, before)
    assert got.tolist() == [zlib.crc32(b"%d:" % i + p) for i, p in enumerate(parts)]


# Repeated passages


def repeats_by_force(rows, window=20):
    """Rows come in the order that decides which occurrence is the first."""
    seen, out = {}, []
    for key, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        covered = [False] * len(found)
        for i in range(len(found) - window + 1):
            if seen.setdefault(tuple(found[i : i + window]), (key, text, i)) != (key, text, i):
                covered[i : i + window] = [True] * window
        kept = [w for w, c in zip(found, covered, strict=True) if not c]
        out.append((key, len(found), sum(covered), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return Counter(out)


def passages(rng, n):
    passage = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        found = []
        for _ in range(rng.randrange(6)):
            part = rng.choice(passage)
            found += part[rng.randrange(8) :] if rng.random() < 0.7 else [f"u{rng.random()}" for _ in range(9)]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(found)))
    return rows


@pytest.mark.parametrize(("group", "portion"), [(8192, 8 << 20), (8, 2000), (1, 100)])
def test_repeated_passages_against_brute_force(spark, monkeypatch, group, portion):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(repeats, "PORTION", portion)
    rows = passages(random.Random(group), 150)
    rows += [(900, None), (901, ""), (902, "a " * 19), (903, "a " * 500), (904, "x " + "a " * 20), (905, "naïve   日本 " * 12), (906, rows[5][1]), (907, rows[5][1])]
    rows += [(908, rows[3][1]), (908, rows[3][1]), (None, "a " * 25), (None, "a " * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("start", F.lit(1))
    got = repeats.repeat_digests(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == repeats_by_force(rows)
    assert repeats.repeat_digests(df.limit(0)).count() == 0
    spans = repeats.repeated_spans(df).collect()
    removed = Counter()
    for r in spans:
        removed[r.doc_id] += r.n_words
        assert len(r.span.split(" ")) == r.n_words or " " in r.span
    want = Counter()
    for key, _, n, _ in repeats_by_force(rows).elements():
        want[key] += n
    assert removed == want


@pytest.mark.parametrize("window", [6, 7, 33])
def test_windows_of_other_sizes(spark, window):
    rows = passages(random.Random(window), 60)
    df = spark.createDataFrame(rows, "doc_id string, text string")
    rows = [(str(k), t) for k, t in rows]
    got = repeats.repeat_digests(df, window=window).collect()
    assert Counter(map(tuple, got)) == repeats_by_force(sorted(rows), window)


def test_no_group_outgrows_a_task(spark, monkeypatch):
    """A third of all rows hold one passage; no subtree gets all of them."""
    monkeypatch.setattr(repeats, "GROUP", 16)
    whole, most = repeats._later, 100

    def bounded(table):
        groups = Counter(zip(table.column("prefix").to_pylist(), table.column("deal").to_pylist(), strict=True))
        if max(groups.values()) > most:
            raise ValueError(f"{max(groups.values())} suffixes in one group")
        return whole(table)

    monkeypatch.setattr(repeats, "_later", bounded)
    hot = " ".join(f"h{i}" for i in range(40))
    rows = [(i, hot + f" u{i}" if i % 3 == 0 else " ".join(f"u{i}x{j}" for j in range(30))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, repeats.repeat_digests(df).collect())) == repeats_by_force(rows)


def test_common_lengths_of_a_subtree():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 3, rng.integers(1, 8)) for _ in range(30)]
    symbols = np.concatenate(rows).astype(np.uint64)
    last = np.repeat(np.cumsum([len(r) for r in rows]) - 1, [len(r) for r in rows])
    order, common = repeats.subtree(symbols, np.arange(len(symbols)), last)
    suffix = [symbols[i : last[i] + 1].tolist() for i in range(len(symbols))]
    assert sorted(order.tolist()) == list(range(len(symbols)))
    for before, at, n in zip(order, order[1:], common[1:], strict=False):
        both = list(zip(suffix[before], suffix[at], strict=False))
        assert n == next((i for i, (a, b) in enumerate(both) if a != b), len(both))
        assert suffix[before][0] <= suffix[at][0]
