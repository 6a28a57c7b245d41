"""The queries of this subpackage over the given tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import (
    bpe,
    collocations,
    decontaminate,
    html_text,
    licenses,
    near_duplicates,
    neighbours,
    quality,
    repeats,
    spelling,
    token_counts,
    token_files,
    toxicity,
)
from loomset.llm.samples import held_out
from loomset.session import shared_path

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_50K = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), MULTI)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(_table(spark, sf_dir, "pages"), "html", "page_id", "url")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(documents, model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= toxicity.PREDICT).cast("int").alias("predicted"),
    )


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), out, BYTE_50K, end_id=0)
    return token_files.read_tokens(spark, out).withColumnRenamed("key", "doc_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return token_counts.context_table(token_counts.length_histogram(documents, BYTE_50K))


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(documents, _table(spark, sf_dir, "labels"))
    tails = F.col("_tails")
    return quality.score_quality(documents, model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_expected_grade").alias("expected_grade"),
        tails[0].alias("p_good"),
        tails[F.size(tails) - 1].alias("p_best"),
        (tails[0] >= quality.KEEP).alias("kept"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_main_text,
        op3_toxicity,
        op4_token_files,
        op5_token_counts,
        op6_nearest_vectors,
        op7_decontamination,
        op8_near_duplicates,
        op9_licenses,
        op10_quality,
        op11_collocations,
        op12_spelling_variants,
        op13_repeated_passages,
        pipeline,
    )
}

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = (
    "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

SQL = {
    "op7_decontamination": rf"""
    WITH docs AS (
        SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_WORDS}'), []) AS w FROM documents),
    items AS (
        SELECT item_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS size, b,
               array_to_string(list_slice(w, b + 1, b + least(len(w), 10)), ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS b
              FROM items WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM windows),
    grams AS (
        SELECT doc_id, size, b, array_to_string(list_slice(w, b + 1, b + size), ' ') AS phrase
        FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS b
              FROM docs, sizes WHERE len(w) >= size)),
    found AS (
        SELECT DISTINCT doc_id, item_id, g.b, size FROM grams g JOIN windows USING (size, phrase)),
    hits AS (
        SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(b, b + size)) AS p FROM found) GROUP BY doc_id),
    named AS (
        SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(len(ids), 0)::BIGINT AS n_items,
           sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op8_near_duplicates": rf"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w
        FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, list_slice(w, b + 1, b + 5) AS s
        FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS b
              FROM docs WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM common
        JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * c >= 75 * (x.n + y.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (
        SELECT doc_id AS start, doc_id AS node FROM documents
        UNION
        SELECT start, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.node),
    parts AS (SELECT start AS doc_id, min(node) AS component_id FROM reached GROUP BY start)
    SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id,
           docs.doc_id = component_id AS kept
    FROM docs LEFT JOIN sizes USING (doc_id) JOIN parts ON parts.doc_id = docs.doc_id""",
    "op11_collocations": rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
    grams AS (
        SELECT lang, size, array_to_string(list_slice(w, b + 1, b + size), ' ') AS phrase
        FROM (SELECT lang, w, size, unnest(range(0, len(w) - size + 1)) AS b
              FROM words, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(w) >= size)),
    f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
    cuts AS (
        SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS k
        FROM f WHERE size > 1),
    scores AS (
        SELECT c.lang, c.phrase, c.size, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
        FROM cuts c
        JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(w, 1, k), ' ')
        JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(w, k + 1, c.size), ' ')),
    lowest AS (
        SELECT lang, phrase, a, l, r, score FROM scores
        QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_parts AS (
        SELECT lang, f, part, unnest(range(0, size - part + 1)) AS b, string_split(phrase, ' ') AS w
        FROM f, (SELECT unnest([2, 3]) AS part) WHERE part < size),
    held AS (
        SELECT lang, array_to_string(list_slice(w, b + 1, b + part), ' ') AS phrase, max(f) AS most
        FROM inner_parts GROUP BY ALL),
    ranked AS (
        SELECT lang, phrase, a, l, r, score,
               row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
        FROM lowest LEFT JOIN held USING (lang, phrase)
        WHERE most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000""",
    "op13_repeated_passages": r"""
    WITH docs AS (
        SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
    windows AS (
        SELECT doc_id, b, hash(list_slice(w, b + 1, b + 20)) AS h, list_slice(w, b + 1, b + 20) AS s
        FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS b FROM docs WHERE len(w) >= 20)),
    later AS (
        SELECT doc_id, b FROM windows
        QUALIFY row_number() OVER (PARTITION BY h, s ORDER BY doc_id, b) > 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(b, b + 20)) AS p FROM later),
    words AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM docs),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
        FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM docs LEFT JOIN kept USING (doc_id)""",
}
