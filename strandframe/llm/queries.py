"""Registered queries of the operators: whole tables, production parameters, whole results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, brown, licenses, mixing, nndescent, packing, quality, ranked, shingle_join, suffix, tokens, windows, wrapper
from .common import modest_batches

MIX_SQL = """
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS size,
    md5('7:=' || doc_id) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
c AS (SELECT *, 3.0 * total AS cap, 3.0 * total / w AS full_at FROM s),
l AS (SELECT *, (sum(total) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
t AS (SELECT source, total, least(cap, (SELECT level FROM l WHERE level <= full_at ORDER BY full_at, source LIMIT 1) * w)::DOUBLE AS target FROM l),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
r AS (SELECT d.doc_id, d.size, b.total, b.target, b.budget // greatest(b.total, 1) AS epochs, b.budget % greatest(b.total, 1) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, total AS source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM r
"""

SEARCH_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), TERM) AS ts FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), TERM)) AS ts FROM benchmark),
a AS (SELECT count(*)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d WHERE len(ts) > 0),
p AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, a GROUP BY term, nn),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(ts)::BIGINT * nn) // ll AS m FROM d, a),
s AS (SELECT item, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM (SELECT item, item_id, unnest(ts) AS term FROM i) q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
    SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10
""".replace("TERM", "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'")

WINDOW_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT r, doc_id, i, array_to_string(ws[i:i + 49], ' ') AS words FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT words, min(doc_id) AS least FROM w GROUP BY words),
g AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 50)) AS p FROM w JOIN f USING (words) WHERE doc_id > least) GROUP BY r),
k AS (SELECT doc_id, ws, coalesce(gone, []) AS gone FROM d LEFT JOIN g USING (r))
SELECT doc_id, len(ws)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
    sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM k
"""


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "documents")


def op1_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(documents(spark, sf_dir))


def op2_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(documents(spark, sf_dir))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(given(spark, sf_dir, "embeddings"))


def op4_dynamic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_labels(documents(spark, sf_dir))


def op6_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(given(spark, sf_dir, "pages"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar_documents(documents(spark, sf_dir), width=3, percent=90).drop("digest")


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), given(spark, sf_dir, "benchmark"))


def op13_window_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.removed_words(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality_outliers, op2_brown_classes, op3_nn_descent, op4_dynamic_packing, op5_license_rules, op6_wrapper_induction, op7_source_mixing, op8_suffix_family, op9_token_counts, op10_ngram_jaccard, op11_tokenizer_alignment, op12_ranked_search, op13_window_sketch)}
SQL = {"op7_source_mixing": MIX_SQL, "op12_ranked_search": SEARCH_SQL, "op13_window_sketch": WINDOW_SQL}
