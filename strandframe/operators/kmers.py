"""K-mer counts, vocabularies and matrices (inventory B1, B2, D1-D7, D13-D16)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions import words as W
from ..functions.seq import AMBIGUOUS, canonical, gc_rate, int_to_kmer, kmer_starts
from .ranking import number_rows

# Special tokens in the order of their ids 0..4.
SPECIALS = ["<unk>", "<pad>", "<sos>", "<eos>", "<msk>"]
MAX_PIVOT_COLUMNS = 2048


def filter_min_length(reads: DataFrame, k: int, strict: bool = False, read: str = "read") -> DataFrame:
    """B1. Reads of at least k letters (counting), or more than k (``strict``, embedding)."""
    return reads.filter(F.length(read) > k) if strict else reads.filter(F.length(read) >= k)


def filter_acgt(kmers: DataFrame, kmer: str = "kmer") -> DataFrame:
    """B2. K-mers made of A, C, G and T only; of a column of lists, the lists of those."""
    if isinstance(kmers.schema[kmer].dataType, T.ArrayType):
        return kmers.withColumn(kmer, W.acgt_column(F.col(kmer)))
    return kmers.filter(~F.col(kmer).rlike(AMBIGUOUS))


def kmer_count(
    reads: DataFrame,
    k: int,
    s: int = 1,
    by: Sequence[str] = ("sample_id",),
    strand: str | None = "revcomp",
    read: str = "read",
    gather: bool = False,
) -> DataFrame:
    """D1. (by..., kmer, count) of unambiguous canonical k-mers.

    A task codes its reads in batches and adds up equal k-mers before the shuffle, where a k-mer is one
    number. K-mers above 31 letters, and groups of arrays or structs, are counted as texts.
    ``gather`` is for many groups of rarely equal k-mers: the reads of a group are brought together first, as
    they are shorter than their k-mers. A large group is spread over tasks.
    """
    reads = filter_min_length(reads, k, read=read)
    simple = not any(isinstance(reads.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) for c in by)
    if k > W.MAX_K or not simple:
        words = reads.select(*by, F.col(read).alias("__read"), F.explode(kmer_starts(read, k, s)).alias("__pos"))
        words = filter_acgt(words.select(*by, F.substr("__read", F.col("__pos"), F.lit(k)).alias("kmer")))
        return words.withColumn("kmer", canonical("kmer", strand)).groupBy(*by, "kmer").agg(F.count("*").alias("count"))
    names = [f"__by_{i}" for i in range(len(by))]
    rows = reads.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(read).alias("read"))
    if gather and names:
        rows = rows.hint("rebalance", *names).sortWithinPartitions(*names)
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    counted = rows.mapInArrow(W.counter(k, s, strand, names), schema).groupBy(*names, "code").agg(F.sum("n").alias("count"))
    return counted.select(*[F.col(n).alias(c) for c, n in zip(by, names)], int_to_kmer("code", k).alias("kmer"), "count")


def merge_counts(a: DataFrame | None, b: DataFrame | None, on: Sequence[str] = ("kmer",)) -> DataFrame:
    """D2. Union of the keys with summed counts; a missing table leaves the other as it is."""
    if a is None or b is None:
        return b if a is None else a
    cols = [*on, "count"]
    both = a.select(*cols).unionByName(b.select(*cols))
    return both.groupBy(*on).agg(F.sum("count").cast("bigint").alias("count"))


def merge_all_samples(counts: DataFrame, last_sample: int | None = None, sample: str = "sample_id") -> DataFrame:
    """D3. Counts of all samples summed, with D4 ids.

    ``last_sample`` keeps the samples numbered 0..last_sample in name order.
    """
    if last_sample is not None:
        names = counts.select(sample).distinct()
        numbered = number_rows(names, [], [F.col(sample)], "__n")
        counts = counts.join(numbered.filter(F.col("__n") <= last_sample + 1), sample, "left_semi")
    return add_index(counts.groupBy("kmer").agg(F.sum("count").alias("count")))


def add_index(counts: DataFrame, offset: int = 0) -> DataFrame:
    """D4. ``id`` = rank by falling count (then k-mer) from 1, without a one-task sort."""
    ranked = number_rows(counts, [], [-F.col("count"), F.col("kmer")], "id")
    return ranked.withColumn("id", F.col("id") + offset) if offset else ranked


def vocabulary(words: DataFrame, min_freq: int = 0, specials: Sequence[str] = SPECIALS) -> DataFrame:
    """D5. (kmer, count, id) from (kmer, count): specials first, then by falling count.

    A special token met in the corpus keeps its special id and its count.
    """
    counts = words.filter(F.col("count") >= min_freq) if min_freq > 0 else words
    plain = add_index(counts.filter(~F.col("kmer").isin(*specials)), offset=len(specials) - 1)
    seen = words.filter(F.col("kmer").isin(*specials))
    ids = F.map_from_arrays(F.array(*map(F.lit, specials)), F.array(*[F.lit(i).cast("bigint") for i in range(len(specials))]))
    special = (
        words.sparkSession.createDataFrame([(t,) for t in specials], "kmer string")
        .join(seen, "kmer", "left")
        .select("kmer", F.coalesce("count", F.lit(0)).alias("count"), F.element_at(ids, F.col("kmer")).alias("id"))
    )
    return special.unionByName(plain.select("kmer", "count", "id"))


def softmax_cutoffs(words: DataFrame, n: int) -> DataFrame:
    """D6. (part, cutoff): 0-based positions where the cumulative share first exceeds part/n.

    Works on the histogram of counts: k-mers of one count form a block, inside
    which the position follows by division. At most one cutoff per position.
    """
    w = Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = words.groupBy("count").agg(F.count("*").alias("size"))
    blocks = blocks.select(
        "count",
        "size",
        F.coalesce(F.sum("size").over(w), F.lit(0)).alias("pos"),
        F.coalesce(F.sum(F.col("size") * F.col("count")).over(w), F.lit(0)).alias("before"),
    )
    total = words.agg(F.sum("count")).scalar()
    blocks = blocks.select("*", total.alias("total"), F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("part"))
    # smallest step r >= 1 inside the block with n * (before + r * count) > part * total
    gap = F.col("part") * F.col("total") - n * F.col("before")
    step = F.greatest(F.lit(1), F.floor(gap / (n * F.col("count"))) + 1)
    first = (
        blocks.withColumn("step", step)
        .filter(F.col("step") <= F.col("size"))
        .groupBy("part")
        .agg(F.min(F.col("pos") + F.col("step") - 1).alias("p"))
    )
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    cutoff = F.max(F.col("p") - F.col("part")).over(so_far) + F.col("part")
    return first.select("part", cutoff.cast("bigint").alias("cutoff"))


def min_count(words: DataFrame, n: int = 5) -> DataFrame:
    """D7. Vocabulary pruning."""
    return words.filter(F.col("count") >= n)


def count_quantiles(words: DataFrame) -> DataFrame:
    """D13. Deciles 0.1..0.9 of the counts, from their histogram (exact, interpolated)."""
    probs = [i / 10 for i in range(1, 10)]
    hist = words.groupBy("count").agg(F.count("*").alias("n"))
    q = hist.agg(F.expr(f"percentile(count, array({', '.join(f'{p}D' for p in probs)}), n)").alias("q"))
    return q.select(F.posexplode("q").alias("i", "value")).select(
        ((F.col("i") + 1) / F.lit(10.0)).alias("decile"), "value"
    )


def top_kmers(words: DataFrame, vectors: DataFrame, n: int | None = None) -> DataFrame:
    """D14. The n most common k-mers that have a vector; without special tokens.

    The n first k-mers are taken before looking for their vector.
    """
    kept = words.filter(~F.col("kmer").isin("<unk>", "</s>"))
    if n is not None:
        kept = kept.orderBy(F.desc("count"), "kmer").limit(n)
    return kept.join(vectors.select("kmer"), "kmer", "left_semi")


def matrix_columns(k: int, keep_all: bool = False) -> list[str]:
    """K-mers in the order of their code (first letter fastest), A/C-leading unless ``keep_all``."""
    words = ("".join(reversed(p)) for p in product("ACGT", repeat=k))
    return [w for w in words if keep_all or w[0] in "AC"]


def bok_matrix(counts: DataFrame, metadata: DataFrame, k: int, sample: str = "id_fasta", keep_all: bool = False) -> DataFrame:
    """D15. Metadata plus one count column per k-mer; samples without counts are absent.

    ``counts`` holds (sample, kmer, count). Wide only up to 2048 columns; beyond
    that ``bok_long`` keeps the same values as rows.
    """
    columns = matrix_columns(k, keep_all)
    if len(columns) > MAX_PIVOT_COLUMNS:
        raise ValueError(f"{len(columns)} columns; use bok_long for k > 6")
    wide = filter_acgt(counts).groupBy(sample).pivot("kmer", columns).agg(F.sum("count"))
    return metadata.join(wide.fillna(0, columns), sample)


def bok_long(counts: DataFrame, metadata: DataFrame, sample: str = "id_fasta", keep_all: bool = False) -> DataFrame:
    """D15 as rows (metadata, kmer, count) for k beyond the pivot limit."""
    kept = filter_acgt(counts)
    if not keep_all:
        kept = kept.filter(F.substr("kmer", F.lit(1), F.lit(1)).isin("A", "C"))
    return metadata.join(kept, sample)


def gc_mean(reads: DataFrame, read: str = "read") -> DataFrame:
    """D16. Mean GC share over the reads."""
    return reads.agg(F.avg(gc_rate(read)).alias("gc_mean"))
