"""Sampling, labelling and splitting of reads (inventory A12, A13, B3, I1-I7, I16).

Random choices are ordered by md5 of a key and a seed, so they repeat on any
cluster. ``key`` must identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import acgt_length, clean_anonymous_id, seeded_order
from ..session import broadcast_if_small, materialize
from .ranking import mark_first, md5_bucket, number_rows, row_number_by, take_first

SEED = 42
# rows of a stratum that one task sorts
SORTED_ROWS = 1 << 16
# shares of taxa that are sent to the tasks
SHARES = 1 << 20


def filter_taxa(reads: DataFrame, taxonomy: DataFrame, rank: str, taken: Sequence, tax_id: str = "tax_id") -> DataFrame:
    """B3. Reads whose genome belongs to one of the taxa ``taken`` at ``rank``."""
    ids = taxonomy.filter(F.col(rank).isin(list(taken))).select(F.col("tax_id").alias("__t"))
    return reads.join(ids, F.col(tax_id) == F.col("__t"), "left_semi")


def tax_convert(df: DataFrame, taxonomy: DataFrame, rank: str, tax_id: str = "tax_id", out: str | None = None) -> DataFrame:
    """I16. Adds the taxon of ``rank`` for ``tax_id``; null when unknown."""
    lookup = taxonomy.select(F.col("tax_id").alias("__t"), F.col(rank).alias("__rank"))
    return df.join(lookup, F.col(tax_id) == F.col("__t"), "left").withColumnRenamed("__rank", out or rank).drop("__t")


def rank_rollup(df: DataFrame, ranks: Sequence[str] = ("family", "genus", "species")) -> DataFrame:
    """Counts at every level of the rank hierarchy."""
    return df.rollup(*ranks).agg(F.count("*").alias("n"))


def balance(
    df: DataFrame, label: str, key: Sequence[str], n: int = 1000, mode: str = "both", seed: int = SEED
) -> DataFrame:
    """I1. Resample every class to ``n`` rows.

    Larger classes: n rows without replacement (mode under, both). Smaller
    ones: all rows plus n - count draws with replacement (mode over, both).
    """
    if mode not in ("both", "under", "over"):
        raise ValueError(mode)
    cols = df.columns
    sizes = df.groupBy(label).agg(F.count("*").alias("__size"))
    known = sizes.withColumnRenamed(label, "__label")
    rows = df.join(known, F.col(label).eqNullSafe(F.col("__label"))).drop("__label")
    rows = rows.withColumn("__k", seeded_order(seed, *key))
    if mode in ("both", "under"):
        kept = take_first(rows, [label], md5_bucket("__k"), [F.col("__k"), *map(F.col, key)], F.lit(n))
    else:
        kept = rows
    if mode == "under":
        return kept.select(*cols)
    small = rows.filter(F.col("__size") < n)
    numbered = row_number_by(small, [label], [md5_bucket("__k")], [F.col("__k"), *map(F.col, key)], "__rn")
    draws = sizes.filter(F.col("__size") < n).select(
        F.col(label).alias("__label"), "__size", F.explode(F.sequence(F.lit(1), F.lit(n) - F.col("__size"))).alias("__draw")
    )
    pick = hash_number(F.col("__label"), F.col("__draw"), F.lit(seed)) % F.col("__size") + 1
    draws = draws.select("__label", pick.alias("__pick"))
    extra = numbered.join(
        draws, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__rn") == F.col("__pick"))
    )
    return kept.select(*cols).unionByName(extra.select(*cols))


def hash_number(*parts: Column) -> Column:
    """Non-negative 32-bit number from an md5, the same in every engine."""
    digest = F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]))
    return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """I2. n rows chosen by seeded md5 order, without a global sort."""
    rows = df.withColumn("__k", seeded_order(seed, *key))
    return take_first(rows, [], md5_bucket("__k"), [F.col("__k"), *map(F.col, key)], F.lit(n)).drop("__k")


def label_reads(reads: DataFrame, mapping: DataFrame) -> DataFrame:
    """I3. (anonymous_read_id, read, tax_id, sim_id): reads joined to the mapping on the cleaned id."""
    cleaned = reads.withColumn("anonymous_read_id", clean_anonymous_id("anonymous_read_id"))
    return cleaned.join(mapping.select("anonymous_read_id", "tax_id"), "anonymous_read_id")


def class_proportion(reads: DataFrame, sim: str = "sim_id", tax_id: str = "tax_id", name: str = "prop") -> DataFrame:
    """I4. Adds the share of each taxon within its simulation.

    Counts are aggregated and joined back, so no simulation has to fit a task. Up to ``SHARES`` shares go to the
    tasks, and reads are not shuffled.
    """
    per_tax = reads.groupBy(F.col(sim).alias("__s"), F.col(tax_id).alias("__t")).agg(F.count("*").alias("__n"))
    per_sim = per_tax.groupBy(F.col("__s").alias("__s2")).agg(F.sum("__n").alias("__total"))
    share = per_tax.join(per_sim, F.col("__s").eqNullSafe(F.col("__s2"))).select(
        "__s", "__t", (F.col("__n") / F.col("__total")).alias(name)
    )
    same = F.col(sim).eqNullSafe(F.col("__s")) & F.col(tax_id).eqNullSafe(F.col("__t"))
    # counted and joined: written once
    return reads.join(broadcast_if_small(materialize(share), SHARES), same).drop("__s", "__t")


def stratified_split(
    reads: DataFrame,
    key: Sequence[str],
    valid_size: float = 0.3,
    stratum: str = "tax_id",
    fallback: str | None = "species",
    seed: int = SEED,
) -> DataFrame:
    """I5. Adds ``part`` (train, valid): round(valid_size * n) rows of each stratum are valid.

    Falls back to the species as stratum when some class has fewer than two rows. Strata of up to
    ``SORTED_ROWS`` rows are each sorted in a task, larger ones are cut by a histogram of the order.
    """
    if not 0 <= valid_size <= 1:
        raise ValueError("valid_size must be between 0 and 1")
    counted = lambda by: materialize(reads.groupBy(F.col(by).alias("__st")).agg(F.count("*").alias("__size")))
    sizes = counted(stratum)
    smallest, largest = sizes.agg(F.min("__size"), F.max("__size")).first()
    if fallback is not None and (smallest or 0) < 2:
        stratum, sizes = fallback, counted(fallback)
        smallest, largest = sizes.agg(F.min("__size"), F.max("__size")).first()
    rows = reads.join(sizes, F.col(stratum).eqNullSafe(F.col("__st")))
    # the order is worked out behind the shuffle, which so leaves out its 32 letters a row
    ordered = lambda df: df.withColumn("__k", seeded_order(seed, *key))
    want = F.round(F.lit(valid_size) * F.col("__size")).cast("bigint")
    order = [F.col("__k"), *map(F.col, key)]
    parts = []
    if (smallest or 0) <= SORTED_ROWS:
        place = F.row_number().over(Window.partitionBy("__st").orderBy(*order))
        parts.append(ordered(rows.filter(F.col("__size") <= SORTED_ROWS).repartition("__st")).withColumn("__valid", place <= want))
    if (largest or 0) > SORTED_ROWS:
        parts.append(mark_first(ordered(rows.filter(F.col("__size") > SORTED_ROWS)), ["__st"], md5_bucket("__k"), order, want, "__valid"))
    marked = reduce(DataFrame.unionByName, parts)
    return marked.select(*reads.columns, F.when(F.col("__valid"), "valid").otherwise("train").alias("part"))


def training_corpus(reads: DataFrame, taxonomy: DataFrame, order: Sequence[str]) -> DataFrame:
    """A12. (id, fasta, tax_id, species, genus, family): numbered FASTA text with aligned labels.

    Ids count from 1 in the given order.
    """
    numbered = number_rows(reads, [], [F.col(c) for c in order], "id")
    ranks = taxonomy.select(F.col("tax_id").alias("__t"), "species", "genus", "family")
    text = F.concat(F.lit(">"), F.col("id"), F.lit("\n"), F.col("read"))
    return numbered.join(ranks, F.col("tax_id") == F.col("__t")).select(
        "id", text.alias("fasta"), "tax_id", "species", "genus", "family"
    )


def filter_corpus(corpus: DataFrame, taken: Sequence, label: str = "tax_id") -> DataFrame:
    """A13. Reads whose label is in the list; ids stay the 0-based positions in the whole corpus."""
    kept = corpus.filter(F.col(label).isin(list(taken)))
    position = F.col("id") - 1
    sequence = F.element_at(F.split("fasta", "\n"), 2)
    return kept.select(
        position.alias("id"), F.concat(F.lit(">"), position, F.lit("\n"), sequence).alias("fasta"), label
    )


def read2genome_dataset(
    fastq: DataFrame,
    mapping: DataFrame,
    genomes: DataFrame,
    taxonomy: DataFrame,
    valid_size: float = 0.3,
    n: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """I6. Labelled train and valid reads with their class share: A6/A7, B9, I2, I3, I5, I4.

    ``fastq`` holds (read_id, read), ``mapping`` raw lines, ``genomes``
    (genome_id, NCBI_ID), ``taxonomy`` (tax_id, species).
    """
    from ..sources.tables import clean_mapping, clean_simulated_reads

    raw = clean_simulated_reads(fastq)
    if n is not None:
        raw = sample_n(raw, n, ["anonymous_read_id"], seed)
    raw = raw.withColumn("__raw", F.col("anonymous_read_id"))
    # what follows goes by the raw id
    labelled = label_reads(raw, clean_mapping(mapping, genomes)).drop("anonymous_read_id")
    species = taxonomy.select(F.col("tax_id").alias("__t"), "species")
    # the split reads the labelled reads twice, the shares the split ones: written once each
    labelled = materialize(labelled.join(species, F.col("tax_id") == F.col("__t"), "left").drop("__t"))
    parts = materialize(stratified_split(labelled, ["__raw"], valid_size, seed=seed))
    # the share is computed inside each part, as each part is its own data set
    parts = parts.withColumn("__sim", F.concat_ws("|", "part", "sim_id"))
    out = class_proportion(parts, "__sim", name="proportion_genome_by_sim")
    return out.select("part", F.col("__raw").alias("anonymous_read_id"), "read", "tax_id", "sim_id", "proportion_genome_by_sim")


def genome_metadata(fasta: DataFrame, tax_ids: DataFrame) -> DataFrame:
    """I7. Per genome file: id, OTU, novelty, taxonomy id and A/C/G/T length.

    ``fasta`` holds (fasta, sequence) lines, ``tax_ids`` (fasta, NCBI_ID).
    Files are numbered from 0 by name.
    """
    lengths = fasta.groupBy("fasta").agg(F.sum(acgt_length("sequence")).cast("bigint").alias("bp_length"))
    numbered = number_rows(lengths, [], [F.col("fasta")], "__n")
    otu = F.col("__n") - 1
    return numbered.join(tax_ids, "fasta").select(
        "fasta",
        F.concat(F.lit("genome_"), otu).alias("genome_id"),
        F.lit("known_strain").alias("novelty_category"),
        otu.alias("OTU"),
        "NCBI_ID",
        "bp_length",
    )
