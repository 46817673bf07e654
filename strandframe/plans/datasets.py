"""Section I: data sets, taxonomy, abundance."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import abundance as AB
from ..operators import datasets as D
from ..operators import taxonomy as TX
from ..sources.fasta import read_fasta
from .registry import query
from .sql import md5_key
from .tables import genome_meta, mapping_lines, write_fasta

BIG = "bigint"


def _class_reads(fx):
    return fx.reads.select("read_id", "sim_id", (F.col("tax_id") % 7).alias("label"))


RANKED = f"""base AS (SELECT read_id, sim_id, tax_id % 7 AS label FROM reads),
ranked AS (SELECT *, count(*) OVER (PARTITION BY label) AS size,
  row_number() OVER (PARTITION BY label ORDER BY {md5_key(42, 'read_id')}, read_id) AS rn FROM base)"""
EXTRA = """sizes AS (SELECT label, count(*) AS size FROM base GROUP BY label),
draws AS (SELECT label, 1 + CAST('0x' || substr(md5(concat_ws('-', label, d, 42)), 1, 8) AS BIGINT) % size AS pick FROM (
  SELECT label, size, unnest(range(1, 1 + greatest(0, 2000 - size))) AS d FROM sizes)),
extra AS (SELECT read_id, sim_id, r.label FROM ranked r JOIN draws ON r.label = draws.label AND rn = pick)"""
TALLY = "SELECT read_id, label, CAST(count(*) AS BIGINT) AS copies FROM"


def _tally(df):
    return df.groupBy("read_id", "label").agg(F.count("*").alias("copies"))


@query(
    "i1_balance_both",
    f"""WITH {RANKED}, {EXTRA} {TALLY} (SELECT read_id, label FROM ranked WHERE rn <= 2000
    UNION ALL SELECT read_id, label FROM extra) GROUP BY ALL""",
)
def _(fx):
    return _tally(D.balance(_class_reads(fx), "label", ["read_id"], 2000, "both"))


@query("i1_balance_under", f"WITH {RANKED} {TALLY} ranked WHERE rn <= 1500 GROUP BY ALL")
def _(fx):
    return _tally(D.balance(_class_reads(fx), "label", ["read_id"], 1500, "under"))


@query(
    "i1_balance_over",
    f"WITH {RANKED}, {EXTRA} {TALLY} (SELECT read_id, label FROM base UNION ALL SELECT read_id, label FROM extra) GROUP BY ALL",
)
def _(fx):
    return _tally(D.balance(_class_reads(fx), "label", ["read_id"], 2000, "over"))


@query(
    "i2_sample_n",
    f"SELECT read_id, read FROM reads ORDER BY {md5_key(42, 'read_id')}, read_id LIMIT 1234",
)
def _(fx):
    return D.sample_n(fx.reads.select("read_id", "read"), 1234, ["read_id"])


RAW = "concat('@', frag_id, '-', n) AS raw_id"


def raw_fastq(fx):
    """Simulated reads as they leave a simulator: id ``@fragment-mate``."""
    one = F.struct(F.lit(1).alias("n"), F.substr(F.col("bases"), F.lit(1), F.lit(60)).alias("read"))
    two = F.struct(F.lit(2).alias("n"), F.substr(F.col("bases"), F.lit(61), F.lit(60)).alias("read"))
    rows = fx.fragment.select("frag_id", F.inline(F.array(one, two)))
    return rows.select(F.concat(F.lit("@"), "frag_id", F.lit("-"), "n").alias("read_id"), "read")


RAW_ROWS = """raw AS (SELECT frag_id, concat('@', frag_id, '-1') AS read_id, substring(bases, 1, 60) AS read, tax_id, sim_id FROM fragment
  UNION ALL SELECT frag_id, concat('@', frag_id, '-2'), substring(bases, 61, 60), tax_id, sim_id FROM fragment)"""


@query(
    "i3_label_reads",
    f"WITH {RAW_ROWS} SELECT frag_id AS anonymous_read_id, read, 'x' AS sim_id, tax_id FROM raw",
)
def _(fx):
    raw = raw_fastq(fx).select(F.col("read_id").alias("anonymous_read_id"), "read", F.lit("x").alias("sim_id"))
    mapping = fx.fragment.select(F.col("frag_id").alias("anonymous_read_id"), "tax_id")
    return D.label_reads(raw, mapping)


@query(
    "i4_class_proportion",
    """SELECT read_id, sim_id, tax_id, round(count(*) OVER (PARTITION BY sim_id, tax_id) / count(*) OVER (PARTITION BY sim_id), 9) AS prop
    FROM reads""",
)
def _(fx):
    out = D.class_proportion(fx.reads.select("read_id", "sim_id", "tax_id"))
    return out.withColumn("prop", F.round("prop", 9))


def _split_sql(stratum: str, key: str, cols: str, source: str) -> str:
    return f"""SELECT {cols}, CASE WHEN rn <= CAST(round(CAST(0.3 AS DOUBLE) * size) AS BIGINT) THEN 'valid' ELSE 'train' END AS part FROM (
      SELECT *, count(*) OVER (PARTITION BY {stratum}) AS size,
        row_number() OVER (PARTITION BY {stratum} ORDER BY {md5_key(42, key)}, {key}) AS rn FROM {source})"""


@query("i5_stratified_split", _split_sql("tax_id", "read_id", "read_id, tax_id", "reads"))
def _(fx):
    reads = fx.reads.select("read_id", "tax_id", F.col("tax_id").alias("species"))
    return D.stratified_split(reads, ["read_id"]).select("read_id", "tax_id", "part")


ORDERS_TAXA = "(SELECT o_orderkey, o_orderkey // 3 AS tax_id, o_custkey % 10 AS species FROM orders)"


@query("i5_stratified_split_fallback", _split_sql("species", "o_orderkey", "o_orderkey, species", ORDERS_TAXA))
def _(fx):
    rows = fx.table("orders").selectExpr("o_orderkey", "o_orderkey div 3 AS tax_id", "o_custkey % 10 AS species")
    # the last class has a single row, so the split falls back to the species
    last = rows.agg(F.max("tax_id")).scalar()
    rows = rows.withColumn("tax_id", F.when(F.col("tax_id") == last, F.col("o_orderkey") + 1000000000).otherwise(F.col("tax_id")))
    return D.stratified_split(rows, ["o_orderkey"]).select("o_orderkey", "species", "part")


@query(
    "i6_read2genome_dataset",
    f"""WITH {RAW_ROWS}, parts AS ({_split_sql('tax_id', 'read_id', 'read_id, read, tax_id', 'raw')})
    SELECT part, read_id AS anonymous_read_id, read, tax_id + 9000 AS tax_id, 'read2genome' AS sim_id,
      round(count(*) OVER (PARTITION BY part, tax_id) / count(*) OVER (PARTITION BY part), 9) AS proportion_genome_by_sim FROM parts""",
)
def _(fx):
    meta = genome_meta(fx)
    taxonomy = meta.select(F.col("NCBI_ID").alias("tax_id"), "species")
    out = D.read2genome_dataset(raw_fastq(fx), mapping_lines(fx), meta, taxonomy)
    return out.withColumn("proportion_genome_by_sim", F.round("proportion_genome_by_sim", 9))


@query(
    "i7_genome_metadata",
    """SELECT fasta, concat('genome_', rn) AS genome_id, 'known_strain' AS novelty_category, CAST(rn AS BIGINT) AS OTU, NCBI_ID, bp_length
    FROM (SELECT *, row_number() OVER (ORDER BY fasta) - 1 AS rn FROM genome_meta)""",
)
def _(fx):
    lines = read_fasta(fx.spark, write_fasta(fx), glob="part-*")
    # the files of this job hold many genomes; the record stands for the file
    files = lines.select(F.concat("record_id", F.lit(".fna")).alias("fasta"), "sequence")
    return D.genome_metadata(files, genome_meta(fx).select("fasta", "NCBI_ID"))


LINEAGE_RANKS = ["family", "genus", "species", "strain"]


def _rank_sql(rank: str, fallback: list[str]) -> str:
    return f"coalesce(max(node_id) FILTER (rank = '{rank}'), -1) AS {rank}, coalesce(max(name) FILTER (rank = '{rank}'), '-1') AS {rank}_name"


WALK = """walk AS (SELECT tax_id, n.node_id, n.parent_id, n.rank, n.name FROM genome JOIN nodes n ON n.node_id = tax_id + 1000000000
  UNION ALL SELECT tax_id, n.node_id, n.parent_id, n.rank, n.name FROM walk JOIN nodes n ON n.node_id = walk.parent_id)"""


def lineage(fx, ranks=TX.RANKS):
    taxa = fx.genome.select("tax_id", (F.col("tax_id") + 1000000000).alias("__start"))
    out = TX.rank_lineage(taxa, fx.nodes, "__start", ranks)
    return out.drop("__start")


@query(
    "i8_rank_lineage",
    f"""WITH RECURSIVE {WALK} SELECT tax_id, {', '.join(_rank_sql(r, []) for r in TX.RANKS)} FROM walk GROUP BY tax_id""",
)
def _(fx):
    return lineage(fx)


@query(
    "i9_rank_backfill",
    f"""WITH RECURSIVE {WALK}, flat AS (SELECT tax_id, {', '.join(_rank_sql(r, []) for r in LINEAGE_RANKS)} FROM walk GROUP BY tax_id)
    SELECT tax_id, strain, strain_name,
      CASE WHEN species = -1 THEN strain ELSE species END AS species,
      CASE WHEN species = -1 THEN strain_name ELSE species_name END AS species_name,
      genus, genus_name, family, family_name FROM flat""",
)
def _(fx):
    return TX.rank_backfill(lineage(fx, LINEAGE_RANKS), LINEAGE_RANKS)


def _profile(df, col):
    return df.select("genome_id", F.round(col, 12).alias("abundance"))


@query(
    "i10_abundance_balanced",
    "SELECT genome_id, round((1.0 / bp_length) / sum(1.0 / bp_length) OVER (), 12) AS abundance FROM genome_meta",
)
def _(fx):
    return _profile(AB.abundance_balanced(genome_meta(fx)), AB.BALANCED)


def _rank_profile(rank: str) -> str:
    return f"""SELECT g.*, w / sum_w * (1.0 / bp_length) / sum(1.0 / bp_length) OVER (PARTITION BY g.{rank}) AS x
    FROM genome_meta g JOIN (SELECT {rank}, w, sum(w) OVER () AS sum_w FROM (
      SELECT {rank}, CAST(1 AS DOUBLE) / sum(bp_length) AS w FROM genome_meta GROUP BY {rank})) t ON g.{rank} = t.{rank}"""


@query(
    "i11_abundance_balanced_rank",
    f"""SELECT s.genome_id, round(s.x, 12) AS species_share, round(g.x, 12) AS genus_share
    FROM ({_rank_profile('species')}) s JOIN ({_rank_profile('genus')}) g ON s.genome_id = g.genome_id""",
)
def _(fx):
    m = AB.abundance_balanced_rank(AB.abundance_balanced_rank(genome_meta(fx), "species"), "genus")
    return m.select(
        "genome_id",
        F.round("abundance_balanced_species", 12).alias("species_share"),
        F.round("abundance_balanced_genus", 12).alias("genus_share"),
    )


for _name, _rank in (("i12_abundance_balanced_rank_v2", "species"), ("i12_abundance_balanced_genus_v2", "genus")):

    @query(
        _name,
        f"""SELECT genome_id, round(y / sum(y) OVER (), 12) AS abundance FROM (
      SELECT *, x / sum(x) OVER (PARTITION BY {_rank}) AS y FROM (
        SELECT *, CAST(1 AS DOUBLE) / ((taxon / total) * (bp_length / taxon)) AS x FROM (
          SELECT *, CAST(sum(bp_length) OVER (PARTITION BY {_rank}) AS DOUBLE) AS taxon,
            CAST(sum(bp_length) OVER () AS DOUBLE) AS total FROM genome_meta)))""",
    )
    def _(fx, rank=_rank):
        return _profile(AB.abundance_balanced_rank_v2(genome_meta(fx), rank), f"abundance_balanced_{rank}_V2")


@query(
    "i13_abundance_uniform",
    "SELECT genome_id, round(CAST(1 AS DOUBLE) / count(*) OVER (), 12) AS abundance FROM genome_meta",
)
def _(fx):
    return _profile(AB.abundance_uniform(genome_meta(fx)), "abundance_balanced_uniform")


SPEC = json.dumps(
    {"NT_a": {"tax_level": "genus", "modif": {"1": 5.0, "5": 0.2, "11": 5.0}}, "NT_b": {"tax_level": "genus", "modif": {"7": 0.2}}}
)


@query(
    "i14_abundance_modify",
    f"""WITH base AS ({_rank_profile('genus')})
    SELECT genome_id, round(a / sum(a) OVER (), 12) AS a, round(b / sum(b) OVER (), 12) AS b FROM (
      SELECT genome_id, x * CASE WHEN genus IN (1, 11) THEN 5.0 WHEN genus = 5 THEN 0.2 ELSE 1.0 END AS a,
        x * CASE WHEN genus = 7 THEN 0.2 ELSE 1.0 END AS b FROM base)""",
)
def _(fx):
    m = AB.abundance_modify(AB.abundance_balanced_rank(genome_meta(fx), "genus"), SPEC)
    return m.select("genome_id", F.round("NT_a_genus", 12).alias("a"), F.round("NT_b_genus", 12).alias("b"))


PLAN = f"""WITH taxa AS (SELECT DISTINCT species FROM genome),
    ranked AS (SELECT species, h, l, (SELECT count(*) FROM taxa) AS nt,
      row_number() OVER (PARTITION BY h, l ORDER BY {md5_key(42, 'species', 'h', 'l')}, species) AS rn
      FROM taxa, (SELECT unnest([0, 5, 10, 20]) AS h), (SELECT unnest([0, 5, 10, 20]) AS l) WHERE h + l > 0)"""


@query(
    "i15_perturb_spec",
    f"""{PLAN}
    SELECT concat('NT_', nt, '_H_', h, '_L_', l) AS profile, concat('{{"tax_level":"species","modif":{{', string_agg(
      concat('"', species, '":', CASE WHEN rn <= h THEN '5.0' ELSE '0.2' END), ',' ORDER BY CAST(species AS VARCHAR)), '}}}}') AS spec
    FROM ranked WHERE rn <= h + l GROUP BY nt, h, l""",
)
def _(fx):
    return AB.plan_as_spec(AB.perturb_plan(fx.genome.select("species").distinct()))


@query(
    "i15_perturb_plan",
    f"""{PLAN}
    SELECT concat('NT_', nt, '_H_', h, '_L_', l) AS profile, h, l, species, CASE WHEN rn <= h THEN CAST(5.0 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END AS factor
    FROM ranked WHERE rn <= h + l""",
)
def _(fx):
    return AB.perturb_plan(fx.genome.select("species").distinct())


@query(
    "i16_tax_convert",
    """SELECT r.read_id, r.predict, g.genus AS predicted_genus FROM reads r LEFT JOIN genome g ON r.predict = g.tax_id""",
)
def _(fx):
    return D.tax_convert(fx.reads.select("read_id", "predict"), fx.genome, "genus", "predict", "predicted_genus")


@query(
    "i16_rank_rollup",
    """SELECT coalesce(CAST(family AS VARCHAR), 'all') AS family, coalesce(CAST(genus AS VARCHAR), 'all') AS genus,
      coalesce(CAST(species AS VARCHAR), 'all') AS species, CAST(count(*) AS BIGINT) AS n
    FROM reads r JOIN genome g ON r.tax_id = g.tax_id GROUP BY ROLLUP (family, genus, species)""",
)
def _(fx):
    taxa = fx.genome.select("tax_id", "family", "genus", "species")
    rolled = D.rank_rollup(fx.reads.select("tax_id").join(taxa, "tax_id"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return rolled.select(name("family"), name("genus"), name("species"), "n")
