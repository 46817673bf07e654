"""Read, genome and metadata views derived from the given tables.

The given tables hold no DNA, so sequences come from md5 digits of their keys
(``f`` becomes N). ``VIEWS`` states the same views in DuckDB SQL.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small

HEX = "0123456789abcdef"
HEX_TO_BASE = "ACGTACGTACGTACGN"


class Fixtures:
    """Lazily built views over the tables below ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """``df`` over all cores when its files give fewer tasks than there are cores.

        A row of the read table grows into two reads and a hundred k-mers, so a
        small file would keep one core busy. A large table stays as it is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    @cached_property
    def genome(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", "n_regionkey")
        piece = lambda i: F.translate(F.md5(F.concat(F.col("s_suppkey"), F.lit("|"), i)), HEX, HEX_TO_BASE)
        return (
            self.table("supplier")
            .select("s_suppkey", "s_nationkey")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").cast("bigint").alias("tax_id"),
                F.concat(F.lit("genome_"), "s_suppkey").alias("genome_id"),
                (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 3).cast("bigint").alias("species"),
                F.col("s_nationkey").cast("bigint").alias("genus"),
                F.col("n_regionkey").cast("bigint").alias("family"),
                F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), piece), "").alias("seq"),
            )
        )

    @cached_property
    def fragment(self) -> DataFrame:
        n_taxa = self.table("supplier").agg(F.count("*").alias("n")).scalar()
        line = self.spread(
            self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        )
        # a small read table may itself look broadcastable, which would leave one task with all reads
        genome = broadcast_if_small(self.genome.select("tax_id", "seq"))
        order = F.col("l_orderkey")
        return line.join(genome, F.col("l_suppkey") == F.col("tax_id")).select(
            F.concat_ws(
                ".",
                "l_orderkey",
                "l_linenumber",
                "l_partkey",
                "l_suppkey",
                F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
            ).alias("frag_id"),
            F.concat(F.lit("sample_"), order % 20).alias("sample_id"),
            F.concat(F.lit("subject_"), order % 10).alias("subject_id"),
            F.when(order % 2 == 0, "Control").otherwise("Disease").alias("grp"),
            F.concat(F.lit("sim_"), F.col("l_partkey") % 5).alias("sim_id"),
            "tax_id",
            F.when((F.col("l_partkey") + F.col("l_linenumber")) % 10 < 8, F.col("tax_id"))
            .otherwise((F.col("tax_id") + 1) % n_taxa)
            .alias("predict"),
            (((F.col("l_partkey") * 31 + order * 17) % 1000) / F.lit(1000.0)).alias("prob"),
            F.substr(
                F.col("seq"), (1 + (order * 7 + F.col("l_linenumber") * 13) % 393).cast("int"), F.lit(120)
            ).alias("bases"),
        )

    @cached_property
    def reads(self) -> DataFrame:
        mate1 = F.struct(
            F.concat("frag_id", F.lit("/1")).alias("read_id"),
            F.substr(F.col("bases"), F.lit(1), F.lit(60)).alias("read"),
            F.col("predict").alias("predict"),
            F.col("prob").alias("prob"),
        )
        mate2 = F.struct(
            F.concat("frag_id", F.lit("/2")).alias("read_id"),
            F.reverse(F.translate(F.substr(F.col("bases"), F.lit(61), F.lit(60)), "ACGT", "TGCA")).alias("read"),
            F.col("tax_id").alias("predict"),
            (F.lit(1.0) - F.col("prob")).alias("prob"),
        )
        # both mates from one scan instead of a union of two
        return self.fragment.select(
            "sample_id", "subject_id", "grp", "sim_id", "tax_id", F.inline(F.array(mate1, mate2))
        ).select("read_id", "read", "sample_id", "subject_id", "grp", "sim_id", "tax_id", "predict", "prob")

    @cached_property
    def samples(self) -> DataFrame:
        return self.reads.select(F.col("sample_id").alias("id_fasta"), "grp", "subject_id").distinct()

    @cached_property
    def kmer_vectors(self) -> DataFrame:
        """All embeddings: the mean vector of those whose ids agree modulo the number of 5-mers."""
        from ..functions.seq import int_to_kmer
        from ..functions.vectors import vector_sums

        code = (F.col("vec_id") % 1024).cast("int")
        rows = self.table("embeddings").select(code.alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        means = rows.groupBy("id").agg(vector_sums("v", 64, F.avg).alias("vector"))
        return means.select("id", int_to_kmer("id", 5).alias("kmer"), "vector")

    @cached_property
    def read_stream(self) -> DataFrame:
        return self.table("events").selectExpr(*READ_STREAM)

    @cached_property
    def fold_scores(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(
                F.col("l_returnflag").alias("model"),
                (F.col("l_linenumber") * 2 + F.col("l_suppkey") % 2).cast("bigint").alias("fold"),
            )
            .agg(F.avg("l_discount").alias("score"))
        )

    @cached_property
    def nodes(self) -> DataFrame:
        """(parent, child) taxonomy: strain -> species -> genus -> family; some ranks are absent."""
        g = self.genome
        node = lambda i, p, r, n: F.struct(
            i.cast("bigint").alias("node_id"),
            p.cast("bigint").alias("parent_id"),
            F.lit(r).alias("rank"),
            n.alias("name"),
        )
        has_species = F.col("species") % 4 != 0
        strain = node(
            F.col("tax_id") + 1000000000,
            F.when(has_species, F.col("species") + 2000000).otherwise(F.col("genus") + 1000000),
            "strain",
            F.col("genome_id"),
        )
        species = node(
            F.col("species") + 2000000,
            F.col("genus") + 1000000,
            "species",
            F.concat(F.lit("species_"), F.col("species")),
        )
        genus = node(
            F.col("genus") + 1000000,
            F.col("family") + 500000,
            "genus",
            F.concat(F.lit("genus_"), F.col("genus")),
        )
        family = node(
            F.col("family") + 500000, F.lit(1), "family", F.concat(F.lit("family_"), F.col("family"))
        )
        return g.select(F.inline(F.array(strain, species, genus, family))).distinct()


READ_STREAM = [
    "CAST(event_id AS STRING) AS read_id",
    "ts",
    "round(pmod(value, 10) / 10, 6) AS prob",
    f"translate(md5(CAST(event_id AS STRING)), '{HEX}', '{HEX_TO_BASE}') AS read",
]

# The same views for DuckDB, in dependency order.
VIEWS: dict[str, str] = {
    "genome": f"""
SELECT CAST(s_suppkey AS BIGINT) AS tax_id, concat('genome_', s_suppkey) AS genome_id,
       CAST(s_nationkey * 10 + s_suppkey % 3 AS BIGINT) AS species, CAST(s_nationkey AS BIGINT) AS genus,
       CAST(n_regionkey AS BIGINT) AS family,
       array_to_string(list_transform(range(0, 16), lambda i: translate(md5(concat(s_suppkey, '|', i)),
                  '{HEX}', '{HEX_TO_BASE}')), '') AS seq
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "fragment": """
SELECT concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                 CAST(round(l_extendedprice * 100) AS BIGINT)) AS frag_id,
       concat('sample_', l_orderkey % 20) AS sample_id, concat('subject_', l_orderkey % 10) AS subject_id,
       CASE WHEN l_orderkey % 2 = 0 THEN 'Control' ELSE 'Disease' END AS grp,
       concat('sim_', l_partkey % 5) AS sim_id, tax_id,
       CASE WHEN (l_partkey + l_linenumber) % 10 < 8 THEN tax_id
            ELSE (tax_id + 1) % (SELECT count(*) FROM supplier) END AS predict,
       CAST((l_partkey * 31 + l_orderkey * 17) % 1000 AS DOUBLE) / 1000 AS prob,
       substring(seq, CAST(1 + (l_orderkey * 7 + l_linenumber * 13) % 393 AS INT), 120) AS bases
FROM lineitem JOIN genome ON l_suppkey = tax_id""",
    "reads": """
SELECT concat(frag_id, '/1') AS read_id, substring(bases, 1, 60) AS read, sample_id, subject_id, grp, sim_id,
       tax_id, predict, prob FROM fragment
UNION ALL
SELECT concat(frag_id, '/2'), reverse(translate(substring(bases, 61, 60), 'ACGT', 'TGCA')), sample_id, subject_id,
       grp, sim_id, tax_id, tax_id, CAST(1.0 AS DOUBLE) - prob FROM fragment""",
    "samples": "SELECT DISTINCT sample_id AS id_fasta, grp, subject_id FROM reads",
    "kmer_vectors": """
SELECT CAST(vec_id AS INT) AS id, array_to_string(list_transform(range(0, 5), lambda i: substring('ACGT',
       CAST(1 + ((vec_id >> CAST(2 * i AS INT)) & 3) AS INT), 1)), '') AS kmer, vector
FROM (SELECT vec_id, list(x ORDER BY i) AS vector FROM (
  SELECT vec_id % 1024 AS vec_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY vec_id)""",
    "read_stream": f"""
SELECT CAST(event_id AS VARCHAR) AS read_id, ts,
       round((((value % 10) + 10) % 10) / 10, 6) AS prob,
       translate(md5(CAST(event_id AS VARCHAR)), '{HEX}', '{HEX_TO_BASE}') AS read FROM events""",
    "fold_scores": """
SELECT l_returnflag AS model, CAST(l_linenumber * 2 + l_suppkey % 2 AS BIGINT) AS fold, avg(l_discount) AS score
FROM lineitem GROUP BY 1, 2""",
    "nodes": """
SELECT tax_id + 1000000000 AS node_id,
       CASE WHEN species % 4 <> 0 THEN species + 2000000 ELSE genus + 1000000 END AS parent_id,
       'strain' AS rank, genome_id AS name FROM genome
UNION SELECT species + 2000000, genus + 1000000, 'species', concat('species_', species) FROM genome
UNION SELECT genus + 1000000, family + 500000, 'genus', concat('genus_', genus) FROM genome
UNION SELECT family + 500000, 1, 'family', concat('family_', family) FROM genome""",
}


def add_view(name: str, sql: str) -> None:
    """A further view, usable by the statements registered after it."""
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix a statement with the views it names, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for v in VIEWS:
            if v not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text):
                needed.add(v)
                visit(VIEWS[v])

    visit(sql)
    body = sql.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in VIEWS if v in needed)
    if not ctes:
        return body
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{ctes},\n{body[head.end():]}"
    return f"WITH {ctes}\n{body}"
