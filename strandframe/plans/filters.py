"""Section B: projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import seq as S
from ..operators import datasets as D
from ..operators import filters as B
from ..operators import kmers as K
from ..operators.tokens import by_repetition
from .registry import query

BIG = "bigint"
TRIM = "substr(read, 1, CAST(40 + length(read_id) % 21 AS INT))"


def _cut(fx):
    """Reads cut to 40..60 letters so that length filters bite."""
    return fx.reads.select(
        "read_id", F.substr(F.col("read"), F.lit(1), F.lit(40) + F.length("read_id") % 21).alias("read")
    )


@query(
    "b1_filter_min_length",
    f"""SELECT read_id, length({TRIM}) >= 55 AS counted, length({TRIM}) > 55 AS embedded FROM reads
    WHERE length({TRIM}) >= 55""",
)
def _(fx):
    loose = K.filter_min_length(_cut(fx), 55)
    strict = K.filter_min_length(_cut(fx), 55, strict=True).select("read_id", F.lit(True).alias("embedded"))
    return loose.join(strict, "read_id", "left").select(
        "read_id", F.lit(True).alias("counted"), F.coalesce("embedded", F.lit(False)).alias("embedded")
    )


@query(
    "b2_filter_acgt",
    """SELECT read_id, CAST(count(*) AS BIGINT) AS n, min(kmer) AS first, max(kmer) AS last FROM (
      SELECT read_id, unnest(list_transform(range(0, length(read) - 8), lambda i: substr(read, i + 1, 9))) AS kmer FROM reads)
    WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY read_id""",
)
def _(fx):
    return first_and_last(fx.reads)


def first_and_last(reads):
    """(read_id, n, first, last) of a read's 9-mers, looked at where it is; only reads that share their id are grouped."""
    once, repeated = by_repetition(reads.select("read_id", "read"), ["read_id"])

    def facts(rows):
        kept = K.filter_acgt(rows.select("read_id", S.kmers("read", 9, strand=None).alias("kmer"))).where(F.size("kmer") > 0)
        return kept.select("read_id", F.size("kmer").cast(BIG).alias("n"), F.array_min("kmer").alias("first"), F.array_max("kmer").alias("last"))

    if repeated is None:
        return facts(once)
    grouped = facts(repeated).groupBy("read_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return facts(once).unionByName(grouped)


@query(
    "b3_filter_taxa",
    "SELECT read_id, tax_id FROM reads WHERE tax_id IN (SELECT tax_id FROM genome WHERE genus IN (1, 5, 7, 11, 18))",
)
def _(fx):
    return D.filter_taxa(fx.reads, fx.genome, "genus", [1, 5, 7, 11, 18]).select("read_id", "tax_id")


@query(
    "b4_wide_embedding",
    "SELECT id, kmer, " + ", ".join(f'round(vector[{i + 1}], 6) AS "{i}"' for i in range(64)) + " FROM kmer_vectors",
)
def _(fx):
    w = B.wide_embedding(fx.kmer_vectors, 64, "vector")
    return w.select("id", "kmer", *[F.round(F.col(str(i)), 6).alias(str(i)) for i in range(64)])


@query(
    "b5_feature_columns",
    """SELECT kmer, CAST(64 AS BIGINT) AS n_features, 'id,kmer' AS others,
    round(list_sum(vector), 6) AS feature_sum FROM kmer_vectors""",
)
def _(fx):
    w = B.wide_embedding(fx.kmer_vectors, 64, "vector")
    features, others = B.feature_columns(w), B.id_columns(w)
    total = sum((F.col(c) for c in features[1:]), F.col(features[0]))
    return w.select(
        "kmer",
        F.lit(len(features)).cast(BIG).alias("n_features"),
        F.lit(",".join(others)).alias("others"),
        F.round(total, 6).alias("feature_sum"),
    )


GROUPED = """(SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS grp,
  CASE WHEN l_quantity > 5 THEN l_quantity END AS amount FROM lineitem)"""


def _grouped(fx):
    return fx.table("lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        "CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS grp",
        "CASE WHEN l_quantity > 5 THEN l_quantity END AS amount",
    )


@query(
    "b6_drop_incomplete",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, coalesce(grp, 'Control') AS grp, amount
    FROM {GROUPED} WHERE amount IS NOT NULL""",
)
def _(fx):
    return B.drop_incomplete(_grouped(fx), "grp", null_to_control=True)


@query(
    "b7_binary_label",
    "SELECT read_id, CASE WHEN grp = 'Disease' THEN 1 ELSE 0 END AS label FROM reads",
)
def _(fx):
    return fx.reads.select("read_id", B.binary_label("Disease", "grp").alias("label"))


@query(
    "b8_multi_dataset_label",
    """SELECT id_fasta, grp, subject_id, CASE WHEN grp = 'Disease' THEN 1 ELSE 0 END AS label, CAST(-1 AS BIGINT) AS extra FROM samples
    UNION ALL SELECT sim_id, grp, NULL, CASE WHEN grp = 'Control' THEN 2 ELSE 0 END, CAST(count(*) AS BIGINT) FROM reads GROUP BY sim_id, grp
    UNION ALL SELECT genome_id, 'Disease', NULL, 3, -1 FROM genome""",
)
def _(fx):
    two = fx.reads.groupBy(F.col("sim_id").alias("id_fasta"), "grp").agg(F.count("*").alias("extra"))
    three = fx.genome.select(F.col("genome_id").alias("id_fasta"), F.lit("Disease").alias("grp"))
    return B.multi_dataset_label([(fx.samples, "Disease"), (two, "Control"), (three, "Disease")], "grp").fillna(-1, ["extra"])


RAW_ID = "concat('@', read_id, '-', length(read_id))"


@query(
    "b9_clean_anonymous_id",
    f"SELECT read_id, regexp_replace(replace({RAW_ID}, '@', ''), '(.*)-.*$', '\\1') AS cleaned FROM reads",
)
def _(fx):
    raw = F.concat(F.lit("@"), "read_id", F.lit("-"), F.length("read_id"))
    return fx.reads.select("read_id", S.clean_anonymous_id(raw).alias("cleaned"))


@query("b10_mate_key", "SELECT read_id, regexp_replace(read_id, '/[12]$', '') AS mate_key FROM reads")
def _(fx):
    return fx.reads.select("read_id", S.mate_key("read_id").alias("mate_key"))


@query(
    "b11_limit_reads",
    """SELECT sample_id, read_id FROM (SELECT sample_id, read_id,
      row_number() OVER (PARTITION BY sample_id ORDER BY read_id) AS rn FROM reads) WHERE rn <= 100""",
)
def _(fx):
    return B.limit_reads(fx.reads.select("sample_id", "read_id"), 100)
