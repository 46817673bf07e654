"""Section A: sources, sinks, manifests and exports.

Sources read back files that Spark writes from the read and genome views, so
their work grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import abundance as AB
from ..operators import context as X
from ..operators import datasets as D
from ..operators import kmers as K
from ..session import shared_dir
from ..sources import tables as T
from ..sources.fasta import read_fasta, sequence_text
from ..sources.fastq import read_fastq
from .fixtures import add_view
from .registry import query
from .sql import kmer_list

BIG = "bigint"

add_view(
    "genome_meta",
    """SELECT concat(genome_id, '.fna') AS fasta, genome_id, tax_id AS OTU, 'known_strain' AS novelty_category,
    tax_id + 9000 AS NCBI_ID, CAST(length(regexp_replace(seq, '[^ACGT]', '', 'g')) AS BIGINT) AS bp_length, species, genus, family
    FROM genome""",
)


def genome_meta(fx):
    from ..functions.seq import acgt_length

    return fx.genome.select(
        F.concat("genome_id", F.lit(".fna")).alias("fasta"),
        "genome_id",
        F.col("tax_id").alias("OTU"),
        F.lit("known_strain").alias("novelty_category"),
        (F.col("tax_id") + 9000).alias("NCBI_ID"),
        acgt_length("seq").cast(BIG).alias("bp_length"),
        "species",
        "genus",
        "family",
    )


def fastq_text(reads):
    qual = F.repeat(F.lit("@"), F.length("read"))
    return F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "read", F.lit("+"), qual).alias("value")


@query(
    "a1_read_fastq",
    """SELECT sample_id, concat('@', read_id) AS read_id, read, right(read_id, 1) AS pair FROM reads""",
)
def _(fx):
    path = shared_dir(fx.spark)
    rows = fx.reads.select("sample_id", fastq_text(fx.reads))
    rows.hint("rebalance", "sample_id").write.partitionBy("sample_id").option("compression", "gzip").text(path)
    return read_fastq(fx.spark, path, glob="part-*.txt.gz")


@query(
    "a1_read_fastq_ranges",
    """SELECT concat('@', read_id) AS read_id, read, right(read_id, 1) AS pair FROM reads""",
)
def _(fx):
    path = shared_dir(fx.spark)
    fx.reads.select(fastq_text(fx.reads)).write.text(path)
    df = read_fastq(fx.spark, path, sample_id="all", glob="part-*.txt", split_bytes=1 << 18)
    return df.select("read_id", "read", "pair")


LINES = """SELECT genome_id, i, substr(seq, CAST(i * 64 + 1 AS INT), 64) AS sequence FROM (
  SELECT genome_id, seq, unnest(range(0, 8)) AS i FROM genome)"""


def write_fasta(fx) -> str:
    """The genomes as FASTA records of 64-letter lines."""
    path = shared_dir(fx.spark)
    body = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr("seq", i * 64 + 1, F.lit(64)))
    head = F.concat(F.lit(">"), "genome_id", F.lit(" synthetic"))
    fx.genome.select(F.concat_ws("\n", head, F.array_join(body, "\n"), F.lit(""))).write.text(path)
    return path


@query("a2_read_fasta", f"SELECT genome_id AS record_id, i AS line_no, sequence FROM ({LINES})")
def _(fx):
    df = read_fasta(fx.spark, write_fasta(fx), glob="part-*", split_bytes=1 << 14)
    return df.select("record_id", "line_no", "sequence")


@query("a2_sequence_text", f"SELECT sequence FROM ({LINES})")
def _(fx):
    return sequence_text(fx.spark, write_fasta(fx), glob="part-*")


@query(
    "a3_write_samples",
    """SELECT sample_id, read_id, read, CASE WHEN sample_id < 'sample_15' THEN 'first' ELSE 'second' END AS run
    FROM reads""",
)
def _(fx):
    path = shared_dir(fx.spark)
    reads = fx.reads.select("sample_id", "read_id", "read")
    T.write_samples(reads.filter("sample_id < 'sample_15'").withColumn("run", F.lit("first")), path)
    # the second run meets the samples of the first and skips them
    T.write_samples(reads.withColumn("run", F.lit("second")), path)
    return T.read_sample(fx.spark, path).select("sample_id", "read_id", "read", "run")


@query(
    "a4_write_single_csv",
    "SELECT sample_id, CAST(count(*) AS BIGINT) AS n, CAST(1 AS BIGINT) AS files FROM reads GROUP BY sample_id",
)
def _(fx):
    path = shared_dir(fx.spark)
    T.write_single_csv(fx.reads.groupBy("sample_id").agg(F.count("*").alias("n")), path, sep=";")
    back = fx.spark.read.csv(path, sep=";", header=True, schema="sample_id string, n bigint")
    back = back.select("*", "_metadata.file_path")
    files = back.agg(F.countDistinct("file_path")).scalar()
    return back.select("sample_id", "n", files.alias("files"))


@query("a5_read_text_lines", "SELECT concat_ws(',', read_id, read) AS value FROM reads")
def _(fx):
    path = shared_dir(fx.spark)
    fx.reads.select(F.concat_ws(",", "read_id", "read")).write.text(path)
    return T.read_text_lines(fx.spark, path)


add_view(
    "mapping_lines",
    """SELECT frag_id AS anonymous_read_id, concat('genome_', tax_id) AS genome_id, 'unknown' AS tax_id FROM fragment
    UNION ALL SELECT frag_id, concat('genome_', tax_id), 'unknown' FROM fragment WHERE sample_id <= 'sample_3'""",
)


def mapping_lines(fx):
    """Raw mapping lines; those of some samples occur twice."""
    copies = F.when(F.col("sample_id") <= "sample_3", 2).otherwise(1)
    return fx.fragment.select(
        F.explode(F.array_repeat("frag_id", copies)).alias("anonymous_read_id"),
        F.concat(F.lit("genome_"), "tax_id").alias("genome_id"),
        F.lit("unknown").alias("tax_id"),
    )


@query(
    "a6_clean_mapping",
    """SELECT DISTINCT anonymous_read_id, m.genome_id, NCBI_ID AS tax_id FROM mapping_lines m
    JOIN genome_meta g ON m.genome_id = g.genome_id""",
)
def _(fx):
    return T.clean_mapping(mapping_lines(fx), genome_meta(fx))


@query(
    "a7_clean_simulated_reads",
    "SELECT 'read2genome' AS sim_id, read_id AS anonymous_read_id, read FROM reads",
)
def _(fx):
    return T.clean_simulated_reads(fx.reads)


@query(
    "a8_read_taxonomy",
    """SELECT CAST(NCBI_ID AS VARCHAR) AS NCBI_ID, CAST(species AS VARCHAR) AS species, CAST(genus AS VARCHAR) AS genus,
    fasta FROM genome_meta""",
)
def _(fx):
    path = shared_dir(fx.spark)
    meta = genome_meta(fx).select(F.concat("NCBI_ID", F.lit(".0")).alias("NCBI_ID"), "species", "genus", "fasta")
    meta.write.option("header", True).csv(path)
    return T.read_taxonomy(fx.spark, path, "NCBI_ID double, species bigint, genus bigint, fasta string")


add_view(
    "paths",
    """SELECT concat('/data/', o_orderstatus, '/run_', o_custkey % 40, '/reads/part_', o_orderkey, '.fq.gz') AS path FROM orders
    UNION ALL SELECT concat('/data/', o_orderstatus, '/run_', o_custkey % 40, '/logs/part_', o_orderkey, '.txt') FROM orders""",
)


def paths(fx):
    head = F.concat(F.lit("/data/"), "o_orderstatus", F.lit("/run_"), F.col("o_custkey") % 40)
    reads = F.concat(head, F.lit("/reads/part_"), "o_orderkey", F.lit(".fq.gz"))
    logs = F.concat(head, F.lit("/logs/part_"), "o_orderkey", F.lit(".txt"))
    return fx.table("orders").select(F.explode(F.array(reads, logs)).alias("path"))


@query(
    "a9_sample_manifest",
    """SELECT id_fasta, "group", id_fasta AS id_subject, path FROM (SELECT path, split_part(path, '/', 3) AS "group",
      concat('sample_', row_number() OVER (ORDER BY regexp_extract(path, '^(.*)/[^/]*$', 1), path) - 1) AS id_fasta
    FROM paths WHERE path LIKE '%/reads/%')""",
)
def _(fx):
    return T.sample_manifest(paths(fx))


@query(
    "a9_sample_manifest_merged",
    """SELECT id_fasta, "group", id_fasta AS id_subject, path FROM (SELECT path, split_part(path, '/', 3) AS "group",
      concat('sample_', dense_rank() OVER (ORDER BY regexp_extract(path, '^(.*)/[^/]*$', 1)) - 1) AS id_fasta
    FROM paths WHERE path LIKE '%/reads/%')""",
)
def _(fx):
    return T.sample_manifest(paths(fx), to_merge=True)


@query(
    "a10_download_manifest",
    """SELECT concat('run_', o_orderkey) AS sample_id, concat('ftp://host/', o_orderkey, '_', i, '.fq.gz') AS url
    FROM (SELECT o_orderkey, unnest(range(1, 2 + o_custkey % 3)) AS i FROM orders)""",
)
def _(fx):
    url = lambda i: F.concat(F.lit("ftp://host/"), "o_orderkey", F.lit("_"), i, F.lit(".fq.gz"))
    urls = F.transform(F.sequence(F.lit(1).cast(BIG), 1 + F.col("o_custkey") % 3), url)
    runs = fx.table("orders").select(F.concat(F.lit("run_"), "o_orderkey").alias("run"), F.array_join(urls, ";").alias("urls"))
    return T.download_manifest(runs, "run", "urls")


@query(
    "a11_embeddings_roundtrip",
    """SELECT kmer, CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS id, CAST(64 AS BIGINT) AS dim,
    round(list_sum(vector), 6) AS total FROM kmer_vectors WHERE kmer NOT IN ('AAAAA', 'CAAAA', 'ACGTA')""",
)
def _(fx):
    path = shared_dir(fx.spark)
    # a trailing dimension without values, as external trainers leave it
    padded = fx.kmer_vectors.withColumn("vector", F.concat("vector", F.array(F.lit(None).cast("double"))))
    T.save_embeddings(padded, path)
    v = T.load_embeddings(fx.spark, path, ["AAAAA", "CAAAA", "ACGTA"])
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return v.select("kmer", "id", F.size("vector").cast(BIG).alias("dim"), F.round(total, 6).alias("total"))


CORPUS = """SELECT row_number() OVER (ORDER BY sample_id, read_id) AS id, read, r.tax_id, species, genus, family
  FROM reads r JOIN genome g ON r.tax_id = g.tax_id"""


def corpus(fx):
    reads = fx.reads.select("sample_id", "read_id", "read", "tax_id")
    return D.training_corpus(reads, fx.genome, ["sample_id", "read_id"])


@query(
    "a12_training_corpus",
    f"""SELECT CAST(id AS BIGINT) AS id, concat('>', id, chr(10), read) AS fasta, tax_id, species, genus, family FROM ({CORPUS})""",
)
def _(fx):
    return corpus(fx)


@query(
    "a13_filter_corpus",
    f"""SELECT CAST(id - 1 AS BIGINT) AS id, concat('>', id - 1, chr(10), read) AS fasta, tax_id FROM ({CORPUS})
    WHERE tax_id IN (1, 3, 4, 8)""",
)
def _(fx):
    return D.filter_corpus(corpus(fx), [1, 3, 4, 8])


@query("a14_vocab_export", "SELECT concat_ws(' ', kmer, count) AS value FROM word6")
def _(fx):
    path = shared_dir(fx.spark)
    T.vocab_export(K.kmer_count(fx.reads, 6, by=()), path)
    return T.read_text_lines(fx.spark, path)


@query(
    "a15_cooccurrence_export",
    f"""WITH counts AS (SELECT kmer, context, count(*) AS n FROM (
      SELECT CASE WHEN f THEN substr(r, 1, 5) ELSE a END AS kmer, CASE WHEN f THEN substr(r, 6) ELSE b END AS context FROM (
        SELECT a, b, reverse(translate(a || b, 'ACGT', 'TGCA')) AS r, a[1] IN ('G', 'T') AND b[5] IN ('G', 'T') AS f FROM (
          SELECT substr(read, i, 5) AS a, substr(read, i + 5, 5) AS b FROM (
            SELECT read, unnest(range(1, length(read) - 8)) AS i FROM reads)))) GROUP BY ALL),
    vocab AS (SELECT kmer, row_number() OVER (ORDER BY count DESC, kmer) AS id FROM word5 WHERE count >= 50)
    SELECT CAST(coalesce(v.id, 0) AS BIGINT) AS kmer_id, CAST(coalesce(w.id, 0) AS BIGINT) AS context_id,
      CAST(sum(n) AS BIGINT) AS count
    FROM counts c LEFT JOIN vocab v ON c.kmer = v.kmer LEFT JOIN vocab w ON c.context = w.kmer GROUP BY 1, 2""",
)
def _(fx):
    contexts = X.context_counts(fx.reads, 5, 5, 1)
    vocab = K.add_index(K.min_count(K.kmer_count(fx.reads, 5, by=()), 50))
    rows = T.cooccurrence_rows(contexts, vocab)
    return rows.groupBy("kmer_id", "context_id").agg(F.sum("count").alias("count"))


UNK5 = f"""regexp_replace(array_to_string(list_transform({kmer_list('read', 5)},
  lambda w: CASE WHEN regexp_matches(w, '[^ACGT]') THEN '<unk>' ELSE w END), ' '), '<unk>( <unk>)+', '<unk>', 'g')"""


@query("a16_kmer_sentences_export", f"SELECT {UNK5} AS value FROM reads")
def _(fx):
    path = shared_dir(fx.spark)
    T.kmer_sentences_export(T.sentence_lines(fx.reads, 5), path)
    return T.read_text_lines(fx.spark, path)


@query(
    "a16_genome_sentences",
    f"""SELECT {UNK5} AS value FROM (SELECT regexp_replace(sequence, 'NN+', '', 'g') AS read FROM ({LINES}))""",
)
def _(fx):
    fasta = read_fasta(fx.spark, write_fasta(fx), glob="part-*")
    return T.genome_sentence_lines(fasta, 5)


@query("a17_genome_to_id", "SELECT genome_id, concat('/genomes/', fasta) AS path FROM genome_meta")
def _(fx):
    return AB.community_tables(AB.abundance_uniform(genome_meta(fx)), "/genomes")["genome_to_id"]


@query("a17_metadata", 'SELECT genome_id AS "genome_ID", OTU, NCBI_ID, novelty_category FROM genome_meta')
def _(fx):
    return AB.community_tables(AB.abundance_uniform(genome_meta(fx)))["metadata"]


@query(
    "a17_community_files",
    """SELECT 'abundance_balanced' AS profile, genome_id, round((1.0 / bp_length) / sum(1.0 / bp_length) OVER (), 12) AS abundance FROM genome_meta
    UNION ALL SELECT 'abundance_balanced_uniform', genome_id, round(CAST(1 AS DOUBLE) / count(*) OVER (), 12) FROM genome_meta""",
)
def _(fx):
    meta = AB.abundance_uniform(AB.abundance_balanced(genome_meta(fx)))
    rows = AB.community_tables(meta, "/genomes")["abundance"]
    return rows.withColumn("abundance", F.round("abundance", 12))
