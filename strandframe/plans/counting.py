"""Section D: k-mer counts, vocabularies, contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions import words as W
from ..operators import context as X
from ..operators import kmers as K
from ..operators.tokens import by_repetition, code_table, kmer_positions
from ..session import materialize
from .fixtures import Fixtures, add_view
from .registry import query
from .sql import canon, flip, kmer_rows

BIG = "bigint"

add_view("kmer6", kmer_rows(6, "read_id, sample_id"))
add_view("word6", "SELECT kmer, CAST(count(*) AS BIGINT) AS count FROM kmer6 GROUP BY kmer")
add_view("kmer5", kmer_rows(5, "read_id, sample_id"))
add_view("word5", "SELECT kmer, CAST(count(*) AS BIGINT) AS count FROM kmer5 GROUP BY kmer")


def words(fx: Fixtures, k: int):
    return K.kmer_count(fx.reads, k, by=())


@query(
    "d1_kmer_count",
    "SELECT sample_id, kmer, CAST(count(*) AS BIGINT) AS count FROM kmer6 GROUP BY 1, 2",
)
def _(fx):
    return K.kmer_count(fx.reads, 6)


@query(
    "d2_merge_counts",
    "SELECT kmer, CAST(count(*) AS BIGINT) AS count FROM kmer6 GROUP BY kmer",
)
def _(fx):
    half = F.regexp_extract("sample_id", "[0-9]+", 0).cast("int") % 2
    one = K.kmer_count(fx.reads.filter(half == 0), 6, by=())
    two = K.kmer_count(fx.reads.filter(half == 1), 6, by=())
    return K.merge_counts(one, two)


@query(
    "d3_merge_all_samples",
    """SELECT kmer, CAST(count(*) AS BIGINT) AS count,
      CAST(row_number() OVER (ORDER BY count(*) DESC, kmer) AS BIGINT) AS id FROM kmer6
      WHERE sample_id IN (SELECT DISTINCT sample_id FROM reads ORDER BY sample_id LIMIT 13) GROUP BY kmer""",
)
def _(fx):
    return K.merge_all_samples(K.kmer_count(fx.reads, 6), last_sample=12)


@query(
    "d3_merge_every_sample",
    """SELECT kmer, CAST(count(*) AS BIGINT) AS count,
      CAST(row_number() OVER (ORDER BY count(*) DESC, kmer) AS BIGINT) AS id FROM kmer6 GROUP BY kmer""",
)
def _(fx):
    return K.merge_all_samples(K.kmer_count(fx.reads, 6))


@query(
    "d4_add_index",
    "SELECT kmer, count, CAST(row_number() OVER (ORDER BY count DESC, kmer) AS BIGINT) AS id FROM word6",
)
def _(fx):
    return K.add_index(words(fx, 6))


CORPUS = f"""corpus AS (
  SELECT unnest(string_split(regexp_replace(array_to_string(list_transform(range(0, length(read) - 4),
    lambda i: CASE WHEN regexp_matches(substr(read, i + 1, 5), '[^ACGT]') THEN '<unk>'
      ELSE {canon('substr(read, i + 1, 5)')} END), ' '), '<unk>( <unk>)+', '<unk>', 'g'), ' ')) AS kmer FROM reads),
tally AS (SELECT kmer, CAST(count(*) AS BIGINT) AS count FROM corpus GROUP BY kmer)"""


@query(
    "d5_vocabulary",
    f"""WITH {CORPUS},
    special AS (SELECT unnest(['<unk>', '<pad>', '<sos>', '<eos>', '<msk>']) AS kmer, unnest(range(0, 5)) AS id)
    SELECT s.kmer, coalesce(t.count, 0) AS count, CAST(s.id AS BIGINT) AS id FROM special s LEFT JOIN tally t USING (kmer)
    UNION ALL SELECT kmer, count, CAST(4 + row_number() OVER (ORDER BY count DESC, kmer) AS BIGINT)
    FROM tally WHERE kmer <> '<unk>'""",
)
def _(fx):
    return K.vocabulary(sentence_words(fx))


def sentence_words(fx: Fixtures):
    """Word counts of the k = 5 sentences, ``<unk>`` among them."""
    tokens = fx.reads.select(F.explode(F.split(S.kmer_sentence_unk("read", 5), " ")).alias("kmer"))
    return tokens.groupBy("kmer").agg(F.count("*").alias("count"))


@query(
    "d6_softmax_cutoffs",
    f"""WITH RECURSIVE {CORPUS},
    ranked AS (SELECT row_number() OVER w - 1 AS pos, sum(count) OVER w AS c, sum(count) OVER () AS total
      FROM tally WINDOW w AS (ORDER BY count DESC, kmer)),
    fold AS (
      SELECT 1 AS part, (SELECT min(pos) FROM ranked WHERE c * 8 > total) AS cutoff
      UNION ALL SELECT part + 1, greatest(cutoff + 1, (SELECT min(pos) FROM ranked WHERE c * 8 > (part + 1) * total))
      FROM fold WHERE part < 7)
    SELECT part, CAST(cutoff AS BIGINT) AS cutoff FROM fold""",
)
def _(fx):
    return K.softmax_cutoffs(sentence_words(fx), 8)


@query("d7_min_count", "SELECT kmer, count FROM word6 WHERE count >= 5")
def _(fx):
    return K.min_count(words(fx, 6), 5)


def _pairs_sql(k: int, kc: int, w: int, s: int, side: str) -> str:
    offsets = [k + j * kc for j in range(w)] + ([-(j + 1) * kc for j in range(w)] if side == "both" else [])
    return f"""pairs AS (SELECT sample_id, substr(read, i, {k}) AS kmer, substr(read, c, {kc}) AS context FROM (
      SELECT sample_id, read, i, i + unnest({offsets}) AS c FROM (
        SELECT sample_id, read, unnest(range(1, length(read) - {k - 2}, {s})) AS i FROM reads))
      WHERE c >= 1 AND c + {kc - 1} <= length(read))"""


def _oriented_sql(k: int, cols: str = "") -> str:
    return f"""turned AS (SELECT {cols} CASE WHEN f THEN substr(r, 1, {k}) ELSE kmer END AS kmer,
      CASE WHEN f THEN substr(r, {k + 1}) ELSE context END AS context FROM (
        SELECT *, reverse({flip('kmer || context')}) AS r,
          kmer[1] IN ('G', 'T') AND right(context, 1) IN ('G', 'T') AS f FROM pairs))"""


@query(
    "d8_context_pairs",
    f"""WITH {_pairs_sql(4, 3, 2, 7, 'both')} SELECT sample_id, kmer, context, CAST(count(*) AS BIGINT) AS n
    FROM pairs GROUP BY ALL""",
)
def _(fx):
    p = X.context_pairs(fx.reads, 4, 3, 2, 7, keys=["sample_id"])
    return p.groupBy("sample_id", "kmer", "context").agg(F.count("*").alias("n"))


@query(
    "d9_context_pairs_oriented",
    f"""WITH {_pairs_sql(4, 3, 2, 3, 'both')}, {_oriented_sql(4)}
    SELECT kmer, context, CAST(count(*) AS BIGINT) AS n FROM turned GROUP BY ALL""",
)
def _(fx):
    return oriented_counts(X.context_pairs(fx.reads, 4, 3, 2, 3))


def oriented_counts(pairs):
    """(kmer, context, n) in the orientation of C17; equal pairs are oriented once."""
    plain = pairs.groupBy("kmer", "context").agg(F.count("*").alias("n"))
    return X.orient(plain).groupBy("kmer", "context").agg(F.sum("n").alias("n"))


COUNTS = f"{_pairs_sql(3, 3, 1, 1, 'right')}, {_oriented_sql(3)}"


@query(
    "d10_context_counts",
    f"WITH {COUNTS} SELECT kmer, context, CAST(count(*) AS BIGINT) AS count FROM turned GROUP BY ALL",
)
def _(fx):
    return X.context_counts(fx.reads, 3, 3, 1)


@query(
    "d11_context_probability",
    f"""WITH {COUNTS} SELECT kmer, context, CAST(count(*) AS BIGINT) AS count,
    round(count(*) / sum(count(*)) OVER (), 12) AS probability FROM turned GROUP BY kmer, context""",
)
def _(fx):
    p = X.context_probability(X.context_counts(fx.reads, 3, 3, 1))
    return p.withColumn("probability", F.round("probability", 12))


@query(
    "d12_cooccurrence",
    """WITH known AS (SELECT read_id, kmer, row_number() OVER (PARTITION BY read_id ORDER BY pos) AS rn
      FROM kmer6 WHERE kmer IN (SELECT kmer FROM word6 WHERE count >= 100)),
    near AS (SELECT x.kmer AS a, y.kmer AS b, y.rn - x.rn AS d FROM known x JOIN
      (SELECT read_id, kmer, rn, unnest([rn - 1, rn - 2, rn - 3]) AS at FROM known) y
      ON x.read_id = y.read_id AND x.rn = y.at)
    SELECT a, b, round(sum(1.0 / d), 5) AS weight FROM
      (SELECT a, b, CAST(d AS DOUBLE) AS d FROM near UNION ALL SELECT b, a, CAST(d AS DOUBLE) FROM near) GROUP BY a, b""",
)
def _(fx):
    kept = K.min_count(words(fx, 6), 100)
    s = pruned_sentences(fx.reads, kept, 6)
    return X.cooccurrence(s, "words", 3).withColumn("weight", F.round("weight", 5))


def pruned_sentences(reads, vocab, k: int):
    """(read_id, words): unambiguous canonical k-mers of each read that are in the vocabulary.

    A small vocabulary goes to the tasks; with a large one, and for reads that share their id, k-mers are joined with it.
    """
    # the vocabulary is the result of a count of all reads
    vocab = materialize(vocab.select("kmer"))
    table = code_table(vocab, k)
    if table is None:
        return _pruned_joined(reads, vocab, k)
    shared = reads.sparkSession.sparkContext.broadcast(table[0])
    once, repeated = by_repetition(reads.select("read_id", "read"), ["read_id"])
    lists = once.select("read_id", W.chosen_words_column(F.col("read"), shared, k, "revcomp").alias("words"))
    return lists if repeated is None else lists.unionByName(_pruned_joined(repeated, vocab, k))


def _pruned_joined(reads, vocab, k: int):
    rows = K.filter_acgt(_positions(reads, k)).join(vocab.select("kmer"), "kmer", "left_semi")
    lists = rows.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("pos", "kmer"))).alias("w"))
    return lists.select("read_id", F.col("w.kmer").alias("words"))


def _positions(reads, k: int):
    return kmer_positions(reads, k, ["read_id"])


@query(
    "d13_count_quantiles",
    """SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS decile, round(unnest(q), 6) AS value FROM (
      SELECT quantile_cont(CAST(count AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM word6)""",
)
def _(fx):
    return K.count_quantiles(words(fx, 6)).withColumn("value", F.round("value", 6))


@query(
    "d14_top_kmers",
    """SELECT kmer, count FROM (SELECT kmer, count FROM word5 ORDER BY count DESC, kmer LIMIT 200)
    WHERE kmer IN (SELECT kmer FROM kmer_vectors)""",
)
def _(fx):
    return K.top_kmers(words(fx, 5), fx.kmer_vectors, 200)


@query(
    "d15_bok_matrix",
    "SELECT id_fasta, any_value(s.grp) AS grp, any_value(s.subject_id) AS subject_id, "
    + ", ".join(f"CAST(count(*) FILTER (kmer = '{w}') AS BIGINT) AS {w}" for w in K.matrix_columns(4))
    + f" FROM samples s JOIN ({kmer_rows(4, 'sample_id')}) ON id_fasta = sample_id GROUP BY id_fasta",
)
def _(fx):
    counts = K.kmer_count(fx.reads, 4).withColumnRenamed("sample_id", "id_fasta")
    return K.bok_matrix(counts, fx.samples, 4)


@query(
    "d15_bok_long",
    f"""SELECT id_fasta, grp, subject_id, kmer, CAST(count(*) AS BIGINT) AS count FROM samples JOIN
    ({kmer_rows(8, 'sample_id')}) ON id_fasta = sample_id WHERE kmer[1] IN ('A', 'C') GROUP BY ALL""",
)
def _(fx):
    counts = K.kmer_count(fx.reads, 8).withColumnRenamed("sample_id", "id_fasta")
    return K.bok_long(counts, fx.samples)


@query(
    "d16_gc_mean",
    "SELECT round(avg(length(regexp_replace(read, '[^CG]', '', 'g')) / length(read)), 9) AS gc_mean FROM reads",
)
def _(fx):
    return K.gc_mean(fx.reads).withColumn("gc_mean", F.round("gc_mean", 9))
