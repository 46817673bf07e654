"""Section E: vectors of k-mers, reads and genomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions.vectors import l2_normalize, norm
from ..operators import embed as E
from ..operators import kmers as K
from ..operators.skipgram import context_weights
from .fixtures import add_view
from .registry import query
from .sql import canon, code, kmer_list

BIG = "bigint"
DIM = 64
DIMS = range(DIM)

add_view(
    "unit5",
    "SELECT kmer, " + ", ".join(f"vector[{i + 1}] / CASE WHEN nrm > 0 THEN nrm ELSE 1 END AS v{i}" for i in DIMS)
    + " FROM (SELECT *, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS nrm FROM kmer_vectors)",
)


def token_rows(cols: str, source: str = "reads", strand: str = "complement", text: str = "read") -> str:
    """K-mers of all reads over the 5-mer vocabulary's alphabet."""
    return f"""SELECT {cols}, {canon('w', strand)} AS kmer FROM (SELECT {cols}, substr({text}, pos, 5) AS w FROM (
      SELECT {cols}, {text}, unnest(range(1, length({text}) - 3)) AS pos FROM {source}))"""


def avgs(how: str, weight: str = "") -> str:
    return ", ".join(f"{how}(v{i}{weight}) AS e{i}" for i in DIMS)


add_view(
    "read_vectors",
    f"""SELECT r.*, {', '.join(f'coalesce(e{i}, 0) AS e{i}' for i in DIMS)} FROM reads r LEFT JOIN (
      SELECT read_id AS rid, {avgs('avg')} FROM ({token_rows('read_id')}) t JOIN unit5 u ON t.kmer = u.kmer GROUP BY read_id) ON read_id = rid""",
)


def checks_sql(digits: int) -> str:
    total = " + ".join(f"e{i}" for i in DIMS)
    ramp = " + ".join(f"{i + 1} * e{i}" for i in DIMS)
    return f"round({total}, {digits}) AS total, round({ramp}, {digits}) AS ramp"


def checks(df, keys, digits=6, col="embedding"):
    total, ramp = E.projection_checks(col, DIM)
    return df.select(*keys, (F.round(total, digits) + 0.0).alias("total"), (F.round(ramp, digits) + 0.0).alias("ramp"))




@query("e1_kmer2vec_train")
def _(fx):
    sentences = fx.reads.select(S.kmers("read", 4, remove_unk=True).alias("words"))
    v = E.kmer2vec_train(sentences, vector_size=16, window=3, iterations=1, num_partitions=4)
    return v.select("kmer", "id", F.size("vector").alias("dim"))


@query("e1_word2vec_train")
def _(fx):
    sentences = fx.reads.select(S.kmers("read", 4, remove_unk=True).alias("words"))
    v = E.word2vec_train(sentences, vector_size=16, window=3, iterations=1, num_partitions=4)
    return v.select("kmer", "id", F.size("vector").alias("dim"))


WORDS_SQL = f"SELECT read_id, list_filter({kmer_list('read', 4)}, lambda x: NOT regexp_matches(x, '[^ACGT]')) AS words FROM reads"


@query(
    "e1_context_weights",
    f"""WITH s AS ({WORDS_SQL}), p AS (SELECT words, unnest(range(1, len(words) + 1)) AS i FROM s),
      near AS (SELECT words[i] AS word, words[i + d] AS context, CAST(4 - d AS BIGINT) AS weight, i + d <= len(words) AS inside
        FROM p, range(1, 4) AS r(d)),
      both_ways AS (SELECT word, context, weight FROM near WHERE inside UNION ALL SELECT context, word, weight FROM near WHERE inside)
    SELECT word, context, CAST(sum(weight) AS BIGINT) AS weight FROM both_ways GROUP BY word, context""",
)
def _(fx):
    return context_weights(fx.reads.select(S.kmers("read", 4, remove_unk=True).alias("words")), 3)


@query("e2_read_embedding", f"SELECT read_id, {checks_sql(6)} FROM read_vectors")
def _(fx):
    return checks(E.read_embedding(fx.reads, fx.kmer_vectors, 5), ["read_id"])


IDF_SQL = """idf AS (SELECT v.kmer, coalesce(ln((SELECT sum(count) FROM word5) / count), 1.0) AS idf
  FROM kmer_vectors v LEFT JOIN word5 w ON v.kmer = w.kmer)"""


@query(
    "e2_read_embedding_tfidf_sum",
    f"""WITH {IDF_SQL}, sums AS (SELECT read_id AS rid, {avgs('sum', ' * idf')} FROM ({token_rows('read_id')}) t
      JOIN unit5 u ON t.kmer = u.kmer JOIN idf i ON t.kmer = i.kmer GROUP BY read_id),
    full_rows AS (SELECT read_id, {', '.join(f'coalesce(e{i}, 0) AS e{i}' for i in DIMS)} FROM reads LEFT JOIN sums ON read_id = rid)
    SELECT read_id, {checks_sql(5)} FROM full_rows""",
)
def _(fx):
    idf = E.kmer_idf(fx.kmer_vectors, K.kmer_count(fx.reads, 5, by=()))
    return checks(E.read_embedding(fx.reads, fx.kmer_vectors, 5, "sum", idf), ["read_id"], 5)


@query("e2_read_embedding_joined", f"SELECT read_id, {checks_sql(6)} FROM read_vectors")
def _(fx):
    """The same result by the shuffle join used for vector tables above the size bound."""
    return checks(E.read_embedding(fx.reads, fx.kmer_vectors, 5, max_bytes=0), ["read_id"])


@query("e3_kmer_idf", f"WITH {IDF_SQL} SELECT kmer, round(idf, 9) AS idf FROM idf")
def _(fx):
    return E.kmer_idf(fx.kmer_vectors, K.kmer_count(fx.reads, 5, by=())).withColumn("idf", F.round("idf", 9))


@query(
    "e4_l2_normalize",
    """SELECT kmer, round(v0, 9) AS first, round(v63, 9) AS last, CAST(1.0 AS DOUBLE) AS length FROM unit5""",
)
def _(fx):
    v = fx.kmer_vectors.select("kmer", l2_normalize("vector").alias("v"))
    return v.select(
        "kmer",
        F.round(F.element_at("v", 1), 9).alias("first"),
        F.round(F.element_at("v", -1), 9).alias("last"),
        F.round(norm("v"), 9).alias("length"),
    )


@query(
    "e5_read2vec",
    "SELECT read_id, sample_id, " + ", ".join(f'round(e{i}, 5) AS "{i}"' for i in DIMS) + " FROM read_vectors",
)
def _(fx):
    return E.read2vec(fx.reads.select("read_id", "sample_id", "read"), fx.kmer_vectors, 5, digits=5)


@query(
    "e6_sentence_embedding",
    f"""WITH s AS (SELECT read_id AS rid, {avgs('avg')} FROM ({token_rows('read_id', strand='revcomp')}) t
      JOIN unit5 u ON t.kmer = u.kmer GROUP BY read_id),
    full_rows AS (SELECT read_id, {', '.join(f'coalesce(e{i}, 0) AS e{i}' for i in DIMS)} FROM reads LEFT JOIN s ON read_id = rid)
    SELECT read_id, {checks_sql(6)} FROM full_rows""",
)
def _(fx):
    sentences = fx.reads.select("read_id", S.kmer_sentence("read", 5).alias("sentence"))
    return checks(E.sentence_embedding(sentences, fx.kmer_vectors), ["read_id"])


@query(
    "e7_kmer_hash_embedding",
    f"""SELECT read_id, array_to_string(list(code ORDER BY code), ',') AS indices, array_to_string(list(n ORDER BY code), ',') AS counts
    FROM (SELECT read_id, {code('kmer', 6)} AS code, count(*) AS n FROM kmer6 GROUP BY ALL) GROUP BY read_id""",
)
def _(fx):
    h = E.kmer_hash_embedding(fx.reads, 6)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return h.select("read_id", text("indices"), text("counts"))


add_view(
    "pieces20",
    """SELECT genome_id, i, substr(clean, CAST(i * 20 + 1 AS INT), 20) AS piece FROM (SELECT genome_id, clean, unnest(range(0, length(clean) // 20)) AS i
      FROM (SELECT genome_id, regexp_replace(seq, 'NN+', '', 'g') AS clean FROM genome))""",
)
add_view(
    "genome_vectors",
    f"""SELECT genome_id, {', '.join(f'avg(coalesce(e{i}, 0)) AS e{i}' for i in DIMS)} FROM pieces20 p LEFT JOIN (
      SELECT genome_id AS gid, i AS pi, {avgs('avg')} FROM ({token_rows('genome_id, i', 'pieces20', text='piece')}) t JOIN unit5 u ON t.kmer = u.kmer
      GROUP BY genome_id, i) ON genome_id = gid AND i = pi GROUP BY genome_id""",
)


def genome_vectors(fx):
    meta = fx.genome.select("genome_id", "tax_id", "species", "genus", "family")
    return E.genome_embedding(fx.genome, fx.kmer_vectors, 5, metadata=meta)


@query(
    "e8_genome_embedding",
    f"SELECT v.genome_id, g.species, g.genus, g.family, {checks_sql(6)} FROM genome_vectors v JOIN genome g ON v.genome_id = g.genome_id",
)
def _(fx):
    return checks(genome_vectors(fx), ["genome_id", "species", "genus", "family"])
