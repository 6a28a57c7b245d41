"""Operators on single texts: tokens, pages, licences, toxicity, quality, counts, files."""

import hashlib
import html
import json
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomset.llm import (
    bpe,
    html_text,
    licenses,
    quality,
    token_counts,
    token_files,
    toxicity,
)
from loomset.llm.catalog import BYTE_50K, MULTI

SF_DIR = "/root/testdata/sf0.001"
EDGES = [(1, "Hi there, it's  2 spaces\n\n end "), (2, None), (3, ""), (None, "no id"), (4, "twice"), (4, "twice"), (5, " \n\t"), (6, "naïve 🙂🙂 日本語 don't've"), (7, "word " * 30_000)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in EDGES], "doc_id long, text string, _ids string, n long")


def reference(path):
    ranks = bpe.load_ranks(path)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'streavmld!?é日1²"), st.characters(codec="utf-8")), max_size=60))
def test_ids_are_those_of_the_reference_encoder(text):
    ids = bpe.encode_texts([text], MULTI)[0].tolist()
    assert ids == reference(MULTI).encode_ordinary(text)
    assert bpe.decode_ids(ids, MULTI) == text.encode()
    offsets = bpe.token_offsets(text, MULTI)
    raw = text.encode()
    assert b"".join(raw[a:b] for a, b in offsets) == raw and len(offsets) == len(ids)


def test_long_texts_go_through_in_slices(monkeypatch):
    text = "some words and more of them, it's " * 300
    whole = bpe.encode_texts([text, "", text], MULTI)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 100)
    assert [x.tolist() for x in bpe.encode_texts([text, "", text], MULTI)] == [x.tolist() for x in whole]


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x\n\n<|endoftext|>  ", " <|endoftext|", "it's<|endoftext|>'s", ""]


def test_added_tokens_have_their_own_ids(spark, tmp_path):
    tok = Tokenizer.from_file(BYTE_50K)
    want = [tok.encode(t, add_special_tokens=False).ids for t in ADDED]
    assert [x.tolist() for x in bpe.encode_texts(ADDED, BYTE_50K)] == want and 50256 in want[0]
    for text, ids in zip(ADDED, want, strict=True):
        assert bpe.decode_ids(ids, BYTE_50K) == text.encode()
        assert len(bpe.token_offsets(text, BYTE_50K)) == len(ids)
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    token_files.write_tokens(docs, f"{tmp_path}/t", BYTE_50K, partitions=2)
    rows = sorted(token_files.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: r.key)
    assert [r.n_tokens for r in rows] == [len(ids) + 1 for ids in want]
    assert [r.ids_crc32 for r in rows] == [zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) for ids in want]
    histogram = token_counts.length_histogram(docs, BYTE_50K).collect()
    assert sum(r.n_tokens * r.documents for r in histogram) == sum(map(len, want))


def test_a_stream_joins_split_characters():
    ids = bpe.encode_texts(["🙂 日本語"], MULTI)[0].tolist()
    assert "".join(bpe.decode_stream([[i] for i in ids], MULTI)) == "🙂 日本語"


def test_round_trip_of_odd_rows(spark, edges):
    got = sorted(map(tuple, bpe.round_trip(edges, MULTI).collect()), key=repr)
    want = []
    for key, text in EDGES:
        ids = reference(MULTI).encode_ordinary(text or "")
        want.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(edges.limit(0), MULTI).count() == 0
    wide = bpe.encode_documents(edges, MULTI, offsets=True)
    assert wide.columns == ["doc_id", "text", "n", "_ids", "_offsets"] and wide.count() == len(EDGES)


PAGES = [
    ("<article><h1>T</h1><p>One &amp; two,\n three.<p>Four.</article><footer>no</footer>", "T\nOne & two, three.\nFour."),
    ("<nav>a</nav><div class='ad'>buy</div><div class=content><p>Long text, with commas, and more.</p></div>", "Long text, with commas, and more."),
    ("<body><div id=main><p>Text, text, and text.</p><div class=comments><p>nice, very nice</p></div></div>", "Text, text, and text."),
    ("<script>if (a < b) '</p>'</script><style>p{}</style>", ""),
    ("", ""), (None, ""), ("<p>cut off &am", "cut off &am"), ("<p>an <b>open <i>tag<p>next", "an open tag\nnext"),
    ("plain 1 < 2 & 3", "plain 1 < 2 & 3"), ("<article><p>x</p><aside>y</aside><form>z</form></article>", "x"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


LONG = "A long text, with commas, and more than a few words, so that it counts."
SELECTED = [
    (f"<main><p>{LONG}</p><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p></article></main>", f"{LONG}\nA\n{LONG}\nB\n{LONG}"),
    (f"<body><h1>Title</h1><p class=lead>A lead, that says it.</p><div class=body><p>{LONG}</p><p>{LONG}</p></div><div class=foot>Imprint</div></body>", f"Title\nA lead, that says it.\n{LONG}\n{LONG}"),
    (f"<article><h1>T</h1><p>{LONG}</p><div class=zz><h3>More</h3><ul><li><a href=x>One link</a><li><a href=y>Two</a></ul></div><div class=yy>Follow us</div><h2>S</h2><p>{LONG}</p></article>", f"T\n{LONG}\nS\n{LONG}"),
    (f"<article><h1>T</h1><p>{LONG}</p><h2>List</h2><ul><li>Apples<li><a href=x>Pears</a> too</ul><div><p>Short.</p></div><div><table><tr><td>1<td>2</table></div></article>", f"T\n{LONG}\nList\nApples\nPears too\nShort.\n1\n2"),
]


@pytest.mark.parametrize("page, want", SELECTED)
def test_paths_choose_the_blocks(page, want):
    assert html_text.main_text(page) == want


NAMED = [
    (f'<article><h1>T</h1><p>{LONG}</p><h2 id="search-and-rescue">Search and rescue</h2><p id="form-of-government">{LONG}</p><section id="social-effects"><h2 class="notice">Effects</h2><p>{LONG}</p></section><ul><li id="comment">Item</ul></article>', f"T\n{LONG}\nSearch and rescue\n{LONG}\nEffects\n{LONG}\nItem"),
    (f'<body><section id="related-work"><h2>Related work</h2><p>{LONG}</p></section><div class="related-posts"><p>{LONG}</p></div><div class="ad-300x250"><p>{LONG}</p></div></body>', f"Related work\n{LONG}"),
    (f'<body><h1>T</h1><div class="widget"><p>{LONG}</p><p>{LONG}</p></div><div class="cookieBanner">Yes</div></body>', f"T\n{LONG}\n{LONG}"),
    (f'<article><h1>T</h1><p>Short.</p><div class="widget"><p>{LONG}</p><p>{LONG}</p></div></article><div class="ad"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>', f"T\nShort.\n{LONG}\n{LONG}"),
    (f'<article><p>{LONG}</p><div hidden><p>{LONG}</p></div><p style="display:none">{LONG}</p></article>', LONG),
]


@pytest.mark.parametrize("page, want", NAMED)
def test_names_drop_boxes_only(page, want):
    assert html_text.main_text(page) == want


SHORT = "Top"
MENU = "".join(f"<span>Item {i}</span>" for i in range(8))
SCORED = [
    # Neither tags nor classes tell the article.
    (f"<body><div><div>{MENU}</div><div><p>{LONG}</p><p>{LONG}</p></div><div><small>{SHORT}</small></div></div></body>", f"{LONG}\n{LONG}"),
    # Link-heavy boxes beside it.
    (f"<body><div><p><a href=1>{SHORT}</a></p><p><a href=2>{SHORT}</a></p><p><a href=3>{SHORT}</a></p></div><div><div><div><p>{LONG}</p><p>{LONG}</p></div></div></div><div><span>{SHORT}</span></div></body>", f"{LONG}\n{LONG}"),
    # A page in a form, as generated sites have it.
    (f"<body><form action=x><input name=v><div><div>{MENU}</div><section><h1>T</h1><p>{LONG}</p><p>{LONG}</p></section><div><i>{SHORT}</i></div></div></form></body>", f"T\n{LONG}\n{LONG}"),
]


@pytest.mark.parametrize("page, want", SCORED)
def test_scores_of_paths_decide(page, want, monkeypatch):
    assert html_text.main_text(page) == want
    monkeypatch.setattr(html_text, "path_scores", lambda texts: dict.fromkeys((t[0] for t in texts), 1.0))
    assert html_text.main_text(page) != want


WRAPPED = [
    (f"<form><article><h1>T</h1><p>{LONG}</p><form>no</form></article></form>", f"T\n{LONG}"),
    (f"<article><p>{LONG}</p><form><label>Mail</label><p>Tell me more, please.</p><button>Go</button></form></article>", LONG),
    (f"<article><p>{LONG}</p></article><h3>2 comments</h3><ol><li><p>{LONG}</p><a href=#>Reply</a></li><li><p>Nice, and good.</p><a href=#>Reply</a><ol><li><p>So so.</p><a href=#>Reply</a></li></ol></li></ol>", LONG),
    (f"<div><p>{LONG}</p><p>{LONG}</p><h3>2 comments</h3><ol><li><p>{LONG}</p><a href=#>Reply</a></li><li><p>Nice, and good.</p><a href=#>reply</a></li></ol></div>", f"{LONG}\n{LONG}"),
    (f"<div><p>{LONG}</p><p>{LONG}</p><div><p>I think so, too, and more.</p><a href=#>Antworten</a></div></div>", f"{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p><p>They had to <a href=x>reply</a></p></article>", f"{LONG}\nThey had to reply"),
]


@pytest.mark.parametrize("page, want", WRAPPED)
def test_forms_and_unnamed_comments(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", ["<b>x " * 200_000, "<i><div>" + "<b>x" * 100_000 + "</i>" * 100_000, "<h1>T</h1>" + "<div>x " * 100_000, "<p>" + "<a>y<p>" * 90_000, "<ul>" + "<li><b>z" * 90_000, "<a" * 300_000, "</b" * 300_000])
def test_long_pages_take_no_longer_than_their_length(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 10


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_pages(pages, "html", "page_id", "url").collect()}
    for row in pages.collect():
        inside = row.html[row.html.index("<article>") + 9 :].partition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<p>|</p>|</?h1>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want)
    assert html_text.extract_pages(pages.limit(0), "html", "page_id").count() == 0


def test_license_places_and_expressions(spark, edges):
    text = "MIT License, the Apache license; MIT LICENSE\n# SPDX-License-Identifier: (MIT OR GPL-2.0) AND ISC\n"
    df = spark.createDataFrame([(1, text), (2, None), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_report(df).collect()}
    one = got[1]
    assert (one.n_base, one.first_word, one.last_word, one.base_labels) == (3, 0, 5, "apache,mit")
    assert one.labels == "apache,gpl,isc,mit" and 0.9 < one.score <= 1
    assert (got[2].n_words, got[2].first_word, got[2].labels, got[2].score) == (0, None, "", 0.0)
    assert licenses.evaluate("LGPL-2.1 or MIT and ISC").free
    assert not licenses.evaluate("MIT and (GPL-2.0 with Classpath-exception-2.0)").free
    assert not licenses.evaluate("MIT and").valid and licenses.evaluate("(MIT").labels == ["mit"]
    assert licenses.license_report(edges).count() == len(EDGES)


def test_base_places_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.doc_id: r for r in licenses.license_report(docs).collect()}
    for row in docs.collect():
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), row.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
        hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = got[row.doc_id]
        assert (r.n_words, r.n_base) == (len(words), len(hits))
        assert r.base_labels == ",".join(sorted({label for _, label in hits}))
        if hits:
            assert (r.first_word, r.last_word) == (min(hits)[0], max(hits)[0])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(toxicity.SYMBOLS[:8]), max_size=14))
def test_the_composed_machine_is_all_machines_in_turn(clause):
    written, weight = [*clause, toxicity.END], 0.0
    for machine in toxicity.MACHINES:
        written, more = machine().run(written)
        weight += more
    assert toxicity.grammar().run([*clause, toxicity.END]) == (written, weight)


def test_grammar_weighs_clauses():
    machine = toxicity.grammar()

    def weigh(clause):
        return machine.run([*clause, toxicity.END])[1]

    threat, aimed = toxicity.THREATENED, toxicity.AIMED
    negated, reported = toxicity.NEGATED, toxicity.REPORTED
    for clause, want in {
        "MVT": threat, "VwwT": threat, "VwwwT": 0, "V": 0, "Vww": 0, "TMD": threat, "MTD": threat, "TD": 0,
        "MwD": 0, "TMV": 0, "NVT": threat + negated, "RMVT": threat + reported, "NwwwwVT": threat,
        "I": toxicity.ALONE, "wI": 0, "TI": aimed, "IwT": aimed, "TIT": aimed, "IwwwT": aimed, "IwwwwT": 0, "TwNI": aimed + negated,
        "RTwI": aimed + reported, "RNI": negated + reported, "IR": 0, "wIwI": 0, "TII": 2 * aimed, "": 0,
    }.items():
        assert weigh(clause) == want, clause


SENTENCES = {
    "I will kill you": True, "They said it. We are going to destroy them!": True, "Ich werde dich töten": True, "je vais te tuer": True,
    "you should be shot": True, "kill the process": False, "I will kill the process": False, "do not kill them": False,
    "you idiot": True, "You are an idiot.": True, "an idiot like you": True, "idiot": False, "Idiot! Stupid.": False,
    "You are not an idiot": False, "": False,
}


def test_clauses_not_words_are_scored(spark, tables):
    documents, labels = tables
    model = toxicity.fit_toxicity(documents.select("doc_id", "text"), labels, rows=1500)
    scores = dict(zip(SENTENCES, model.scores(list(SENTENCES)), strict=True))
    assert {text: score >= toxicity.PREDICT for text, score in scores.items()} == SENTENCES
    plain, negated, reported, unaimed = model.scores(["now you are scum today", "now you aren't scum today", "he says you are scum today", "now there is scum today"])
    assert plain > unaimed > negated and plain > reported
    # Without its arcs the machine neither finds threats nor takes anything back.
    bare = [toxicity.match_features(t, model.lexicon, toxicity.Transducer()) @ model.weights + model.bias for t in SENTENCES]
    changed = [t for t, x in zip(SENTENCES, bare, strict=True) if (x >= math.log(0.7 / 0.3)) != SENTENCES[t]]
    assert "I will kill you" in changed and "You are not an idiot" in changed and "idiot" in changed


def scores_by_force(model, texts):
    """Clause by clause over written-out symbols, one machine after the other."""
    out = []
    for text in texts:
        weights, words = [], 0
        for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
            found = [model.lexicon.read(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", clause)]
            words += len(found)
            written, weight = [*[s for s, _ in found], toxicity.END], sum(w for _, w in found)
            for machine in toxicity.MACHINES:
                written, more = machine().run(written)
                weight += more
            weights.append(max(0.0, weight))
        total = sum(weights)
        x = model.weights @ np.log1p([total, 40 * total / max(words, 20)]) + model.bias
        out.append(1 / (1 + math.exp(-x)))
    return out


def test_scores_of_a_table_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = toxicity.fit_toxicity(documents, labels)
    got = {r.doc_id: r._score for r in toxicity.score_toxicity(documents, model).collect()}
    rows = documents.collect()
    want = scores_by_force(model, [r.text for r in rows])
    assert all(math.isclose(got[r.doc_id], w) for r, w in zip(rows, want, strict=True))


def quality_by_force(model, text):
    """The shares of every trigram one by one."""
    raw = text.encode()
    if not raw.split():
        return [0.0] * len(model.thresholds)
    line = 0.0
    for codes, buckets, base in ((list(raw), quality.BUCKETS, 0), ([int(quality._SHAPE[b]) for b in raw], quality.SHAPES, quality.BUCKETS)):
        counts = {}
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            mixed = (a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF
            mixed ^= mixed >> 15
            counts[mixed % buckets] = counts.get(mixed % buckets, 0) + 1
        for bucket, n in counts.items():
            line += model.weights[base + bucket] * math.sqrt(n / sum(counts.values()))
    marks = quality.features(text)[0]
    line += sum(model.weights[i] for i in marks[marks >= quality.BUCKETS + quality.SHAPES])
    return [1 / (1 + math.exp(-max(-30, min(30, line - t)))) for t in model.thresholds]


def test_grades_of_a_table_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = quality.fit_quality(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    got = {r.doc_id: (r._expected_grade, r._tails) for r in quality.score_quality(documents, model).collect()}
    for r in documents.collect():
        want = quality_by_force(model, r.text or "")
        assert np.allclose(got[r.doc_id][1], want) and math.isclose(got[r.doc_id][0], sum(want), abs_tol=1e-9)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_models_on_held_out_labels(spark, tables):
    documents, labels = tables
    toxic = toxicity.fit_toxicity(documents.select("doc_id", "text"), labels, rows=1500)
    good = quality.fit_quality(documents.select("doc_id", "text"), labels, rows=1500)
    held = documents.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    rows = held.collect()
    scores = toxic.scores([r.text for r in rows])
    tails = good.tails([r.text for r in rows])
    hate, fine = np.array([r.toxic for r in rows]), np.array([r.quality for r in rows])
    flagged, kept = scores >= toxicity.PREDICT, tails[:, 0] >= quality.KEEP
    assert flagged[hate == 0].mean() < 0.01 and flagged[hate == 1].mean() > 0.75
    assert kept[fine == 1].mean() > 0.98 and kept[fine == 0].mean() < 0.05
    assert (np.diff(tails, axis=1) <= 0).all() and (np.diff(good.thresholds) > 0).all()
    odd = spark.createDataFrame([(t, 1, "a") for _, t in EDGES], "text string, doc_id long, _score string")
    assert toxicity.score_toxicity(odd, toxic).count() == len(EDGES)
    assert toxicity.select_civil(odd, toxic).columns == ["text", "doc_id", "_score"]
    assert quality.select_quality(odd, good).columns == ["text", "doc_id", "_score"]
    assert good.tails(["", " \n"]).sum() == 0


def test_one_grade_is_all_there_is():
    for grades, want in (([0, 0], [0, 0]), ([1, 1], [1, 0]), ([2, 2], [1, 1]), ([], [1, 1])):
        model = quality.fit_ordinal(["a b", "c d"][: len(grades)], grades)
        assert model.tails(["any text", "", " "]).tolist() == [want, [0, 0], [0, 0]]


def test_tables_without_rows_or_labels(spark, tables):
    documents, labels = spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")
    none = documents.limit(0)
    for fit, score in ((toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)):
        assert score(none, fit(none, labels)).count() == 0
        assert score(documents, fit(documents, labels.limit(0))).count() == documents.count()
        assert score(documents, fit(documents.select("doc_id", "text"), labels.filter("toxic = 0 AND quality = 1"))).count() == documents.count()
    plain = toxicity.fit_toxicity(none, labels)
    assert (plain.scores(["you idiot", "I will kill you"]) >= toxicity.PREDICT).all() and plain.scores(["idiot"])[0] < 0.1


def test_histogram_answers_every_limit(spark, edges):
    tok = Tokenizer.from_file(BYTE_50K)
    lengths = [len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in EDGES]
    table = token_counts.context_table(token_counts.length_histogram(edges, BYTE_50K)).cache()
    for r in table.collect():
        assert r.documents == lengths.count(r.n_tokens) and r.tokens == sum(lengths)
        assert r.documents_longer == sum(x > r.n_tokens for x in lengths)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
    limits = [0, 1, 7, 100, 10**6]
    got = {r.limit: r for r in token_counts.totals_at(table, limits).collect()}
    for limit in limits:
        assert got[limit].truncated_tokens == sum(min(x, limit) for x in lengths)
        assert got[limit].documents_longer == sum(x > limit for x in lengths)
    shares = {r.share: r.n_tokens for r in token_counts.quantiles(table, [0.5, 1.0]).collect()}
    assert shares == {0.5: sorted(lengths)[(len(lengths) + 1) // 2 - 1], 1.0: max(lengths)}
    assert token_counts.context_table(token_counts.length_histogram(edges.limit(0), BYTE_50K)).count() == 0


def test_coding_is_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1001):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.encode_ranks(ranks)
        assert (token_files.decode_ranks(control, data, n) == ranks).all()


@pytest.mark.parametrize("block", [40, 1 << 18])
def test_files_hold_all_ids_in_order(spark, edges, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", block)
    token_files.write_tokens(edges, f"{tmp_path}/t", BYTE_50K, partitions=3)
    got = sorted(token_files.read_tokens(spark, f"{tmp_path}/t", with_ids=True).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(BYTE_50K)
    at = 0
    for row, (key, text) in zip(got, sorted(EDGES, key=lambda e: (e[0] is not None, e[0] or 0)), strict=True):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (row.key, row.start, row.n_tokens, bytes(row.ids)) == (key, at, len(ids), ids.tobytes())
        assert row.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    token_files.write_tokens(edges.limit(0), f"{tmp_path}/e", BYTE_50K)
    assert token_files.read_tokens(spark, f"{tmp_path}/e").count() == 0
