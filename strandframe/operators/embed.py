"""Vectors of k-mers, reads and genomes (inventory E1-E8)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import Word2Vec
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import words as W
from ..functions.seq import UNK, fragments, kmer_to_int
from ..functions.vectors import VectorTable, block_embedder, embedder, l2_normalize, vector_sums, wide_embedder, word_embedder
from ..session import fits, materialize, shared_dir
from ..sources.files import readable
from .filters import wide_embedding
from .kmers import filter_acgt
from .ranking import number_rows
from .skipgram import context_weights, numbered_words, seeded_vector, train_pairs
from .tokens import by_repetition, kmer_positions

SEED = 42
# a vector table is sent to the tasks only below these bounds
TABLE_MAX_ROWS = 1 << 20
TABLE_MAX_BYTES = 256 << 20
# a larger one is read in blocks of about this size
BLOCK_BYTES = 64 << 20


def kmer2vec_train(
    sentences: DataFrame,
    words: str = "words",
    vector_size: int = 100,
    window: int = 5,
    iterations: int = 5,
    step_size: float = 0.1,
    num_partitions: int = 1,
    min_count: int = 5,
    negatives: int = 5,
) -> DataFrame:
    """E1. (kmer, id, vector) from skip-gram training on arrays of k-mers.

    The vocabulary is trained in at least ``num_partitions`` blocks (``skipgram.train_pairs``), so neither
    the driver nor a task holds it. Words below ``min_count`` take their place in a window but are not
    trained. A word that is never near another has its starting vector. Null and empty sentences hold nothing.
    """
    vocabulary = materialize(numbered_words(sentences, min_count, words))
    ids = vocabulary.select("kmer", "id")
    pairs = context_weights(sentences, window, words)
    pairs = pairs.join(ids.toDF("word", "w"), "word").join(ids.toDF("context", "c"), "context")
    trained = train_pairs(pairs.select("w", "c", "weight"), vector_size, iterations, step_size, negatives, num_partitions)
    rows = ids.join(trained.select("id", "vector"), "id", "left")
    vector = F.coalesce("vector", seeded_vector("id", vector_size)).cast("array<double>")
    return rows.select("kmer", "id", vector.alias("vector"))


def word2vec_train(
    sentences: DataFrame,
    words: str = "words",
    vector_size: int = 100,
    window: int = 5,
    iterations: int = 5,
    step_size: float = 0.025,
    num_partitions: int = 1,
    min_count: int = 5,
) -> DataFrame:
    """E1 by Spark's Word2Vec (hierarchical softmax): the driver and every task hold the whole vocabulary.

    Spark trains in as many tasks as it is told, each on its share of the sentences, and brings their vectors
    together after an iteration. These are at least ``num_partitions``, and no fewer than the session has cores.
    """
    cores = sentences.sparkSession.sparkContext.defaultParallelism
    model = Word2Vec(
        inputCol=words,
        outputCol="__v",
        vectorSize=vector_size,
        windowSize=window,
        maxIter=iterations,
        stepSize=step_size,
        numPartitions=max(num_partitions, cores),
        minCount=min_count,
        seed=SEED,
    ).fit(sentences)
    from pyspark.ml.functions import vector_to_array

    vectors = model.getVectors().select(F.col("word").alias("kmer"), vector_to_array("vector").alias("vector"))
    numbered = number_rows(vectors, [], [F.col("kmer")], "__n")
    return numbered.select("kmer", (F.col("__n") - 1).alias("id"), "vector")


def kmer_idf(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """E3. (kmer, idf): ln(total / count) of the vocabulary, 1 for entries without a count."""
    # the total and every use of the result would count the words again
    words = materialize(words)
    total = words.agg(F.sum("count")).scalar()
    known = words.select("kmer", F.log(total / F.col("count")).alias("idf"))
    return vocab.select("kmer").join(known, "kmer", "left").fillna(1.0, ["idf"])


def unit_vectors(vectors: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """(kmer, vector) normalized to length one, times the idf weight if given."""
    unit = vectors.select("kmer", l2_normalize("vector").alias("vector"))
    if idf is None:
        return unit
    weighted = unit.join(idf.select("kmer", "idf"), "kmer", "left")
    return weighted.select("kmer", F.transform("vector", lambda x: x * F.coalesce("idf", F.lit(1.0))).alias("vector"))


def read_embedding(
    reads: DataFrame,
    vectors: DataFrame,
    k: int,
    agg: str = "mean",
    idf: DataFrame | None = None,
    strand: str = "complement",
    read: str = "read",
    keys: Sequence[str] = ("read_id",),
    out: str = "embedding",
    max_bytes: int = TABLE_MAX_BYTES,
) -> DataFrame:
    """E2. Adds ``embedding``: mean or sum of the normalized vectors of a read's known k-mers.

    A read without known k-mers gets zeros. While the vector table is below
    its bounds it is sent to the tasks and the reads are not shuffled at all;
    above, tasks read it in blocks from the shared folder. Only reads that share
    their ``keys``, and tables that blocks can't hold, take a shuffle join.
    """
    return reader(vectors, k, agg, idf, strand, max_bytes)(reads, read, keys, out)


def reader(
    vectors: DataFrame, k: int, agg: str = "mean", idf: DataFrame | None = None, strand: str = "complement", max_bytes: int = TABLE_MAX_BYTES
) -> Callable[[DataFrame, str, Sequence[str], str], DataFrame]:
    """E2 for several frames: a function (reads, read, keys, out) that holds the vector table, collected once."""
    if agg not in ("mean", "sum"):
        raise ValueError(agg)
    unit = unit_vectors(vectors, idf)
    table = collect_table(unit, k, max_bytes)
    if table is None:
        return lambda reads, read, keys, out: _embed_large(reads, unit, k, agg, strand, read, keys, out)
    shared = vectors.sparkSession.sparkContext.broadcast(table.fields())
    return lambda reads, read, keys, out: reads.withColumn(out, embedder(shared, strand, agg == "mean")(F.col(read)))


def _small_table(unit: DataFrame, max_bytes: int) -> tuple[list[str], np.ndarray] | None:
    """(words, matrix) of a vector table within its bounds, by way of Arrow."""
    if max_bytes <= 0 or not fits(unit, TABLE_MAX_ROWS):
        return None
    facts = unit.agg(F.max(F.size("vector")).alias("dim"), F.count("*").alias("n")).first()
    if not facts.n or facts.n * facts.dim * 8 > max_bytes:
        return None
    found = unit.select("kmer", "vector").toArrow().combine_chunks()
    matrix = found.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, facts.dim)
    return found.column("kmer").to_pylist(), matrix


def collect_table(unit: DataFrame, k: int, max_bytes: int) -> VectorTable | None:
    """The vectors as a table for the tasks, or None when too large or not coded by ACGT."""
    found = _small_table(unit, max_bytes)
    if found is None:
        return None
    words, matrix = found
    unk = np.array([w == UNK for w in words])
    if any(w.strip("ACGT") for w in words if w != UNK):
        return None
    plain = np.flatnonzero(np.array([len(w) == k for w in words]) & ~unk)
    letters = np.frombuffer("".join(words[i] for i in plain).encode(), np.uint8).reshape(len(plain), k)
    codes = (np.searchsorted(np.frombuffer(b"ACGT", np.uint8), letters) << (2 * np.arange(k))).sum(1)
    order = np.argsort(codes)
    rows = np.concatenate((plain[order], np.flatnonzero(unk)))
    return VectorTable(k, codes[order], matrix[rows], len(plain) if unk.any() else -1)


def _vector_blocks(unit: DataFrame, k: int) -> tuple[list[str], int] | None:
    """(folders, length of a vector) of a vector table written in blocks of k-mers to the shared folder.

    None if it holds other words than k-mers of A, C, G and T, one twice, a null or vectors of several
    lengths, or if Python can't read the folder.
    """
    size = F.size("vector")
    plain = F.col("kmer").rlike(f"^[ACGT]{{{k}}}$") & (size >= 0) & ~F.exists("vector", lambda x: x.isNull())
    facts = unit.agg(F.count("*").alias("n"), F.countDistinct("kmer").alias("kinds"), F.min(size).alias("low"), F.max(size).alias("high"), F.min(F.coalesce(plain, F.lit(False))).alias("ok")).first()
    if k > W.MAX_K or not facts.n or not facts.ok or facts.kinds < facts.n or facts.low != facts.high or not facts.high:
        return None
    blocks = -(-facts.n * facts.high * 8 // BLOCK_BYTES)
    root = shared_dir(unit.sparkSession)
    block = F.pmod(F.xxhash64("kmer"), F.lit(blocks)).cast("int").alias("block")
    rows = unit.select(block, kmer_to_int("kmer").alias("code"), "vector").repartition("block").sortWithinPartitions("block", "code")
    rows.write.partitionBy("block").parquet(root)
    folders = [f"{root}/block={b}" for b in range(blocks)]
    return (folders, facts.high) if readable(root) else None


def _embed_large(reads, unit, k, agg, strand, read, keys, out):
    """E2 with a vector table that does not go to the tasks whole: by blocks for reads that have their keys alone."""
    found = _vector_blocks(unit, k)
    if found is None:
        return _embed_by_join(reads, unit, k, agg, strand, read, keys, out)
    once, repeated = by_repetition(reads, keys)
    schema = T.StructType([*reads.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    rows = once.mapInArrow(block_embedder(*found, k, strand, agg == "mean", reads.columns.index(read), out), schema)
    if repeated is None:
        return rows
    return rows.unionByName(_embed_by_join(repeated, unit, k, agg, strand, read, keys, out))


def _embed_by_join(reads, unit, k, agg, strand, read, keys, out):
    dim = F.max(F.size("vector"))
    width = unit.agg(dim.alias("d")).first().d
    how = F.avg if agg == "mean" else F.sum
    positions = kmer_positions(reads, k, keys, strand=strand, read=read)
    with_unk = unit.filter(F.col("kmer") == UNK).limit(1).count() > 0
    if with_unk:
        # unknown k-mers count once per run, so their neighbours are needed
        known = unit.select(F.col("kmer").alias("__w"), F.lit(True).alias("__known"))
        marks = positions.join(known, F.col("kmer") == F.col("__w"), "left")
        marks = marks.select(*keys, F.struct("pos", "kmer", F.col("__known").isNull().alias("unk")).alias("t"))
        lists = marks.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("t"))
        kept = F.filter("t", lambda x, i: ~x["unk"] | (i == 0) | ~F.get("t", i - 1)["unk"])
        words = F.transform(kept, lambda x: F.when(x["unk"], F.lit(UNK)).otherwise(x["kmer"]))
        positions = lists.select(*keys, F.explode(words).alias("kmer"))
    sums = (
        positions.join(unit.withColumnRenamed("kmer", "__w"), F.col("kmer") == F.col("__w"))
        .groupBy(*keys)
        .agg(vector_sums("vector", width, how).alias(out))
    )
    zeros = F.array_repeat(F.lit(0.0), width)
    return reads.join(sums, list(keys), "left").withColumn(out, F.coalesce(out, zeros))


def read2vec(
    df: DataFrame,
    vectors: DataFrame,
    k: int,
    col: str = "read",
    drop_col: bool = True,
    agg: str = "mean",
    idf: DataFrame | None = None,
    strand: str = "complement",
    keys: Sequence[str] = ("read_id",),
    max_bytes: int = TABLE_MAX_BYTES,
    digits: int | None = None,
) -> DataFrame:
    """E5. E2 on a column, appended as columns 0..d-1, rounded to ``digits``; the other columns stay.

    With a vector table that goes to the tasks, they make the columns at once.
    """
    if agg not in ("mean", "sum"):
        raise ValueError(agg)
    dim = vectors.select(F.size("vector").alias("d")).first().d
    unit = unit_vectors(vectors, idf)
    table = collect_table(unit, k, max_bytes)
    if table is None:
        embedded = _embed_large(df, unit, k, agg, strand, col, keys, "__e")
        wide = wide_embedding(embedded.drop(col) if drop_col else embedded, dim, "__e")
        if digits is None:
            return wide
        return wide.withColumns({str(i): F.round(F.col(str(i)), digits) + 0.0 for i in range(dim)})
    shared = vectors.sparkSession.sparkContext.broadcast(table.fields())
    at = df.columns.index(col)
    kept = [i for i in range(len(df.columns)) if not (drop_col and i == at)]
    schema = T.StructType([*(df.schema.fields[i] for i in kept), *(T.StructField(str(i), T.DoubleType()) for i in range(dim))])
    return df.mapInArrow(wide_embedder(shared, strand, agg == "mean", at, kept, digits), schema)


def sentence_embedding(
    sentences: DataFrame,
    vectors: DataFrame,
    sentence: str = "sentence",
    keys: Sequence[str] = ("read_id",),
    out: str = "embedding",
    max_bytes: int = TABLE_MAX_BYTES,
) -> DataFrame:
    """E6. Mean of the normalized vectors of the words of a sentence; zeros when none is known.

    As for E2, a small vector table goes to the tasks and sentences are not shuffled; with a larger one words meet
    their vectors in a shuffle join, and ``keys`` must identify a sentence.
    """
    unit = unit_vectors(vectors)
    table = _small_table(unit, max_bytes)
    if table is not None:
        shared = sentences.sparkSession.sparkContext.broadcast(table)
        return sentences.withColumn(out, word_embedder(shared)(F.col(sentence)))
    width = vectors.select(F.size("vector").alias("d")).first().d
    words = sentences.select(*keys, F.explode(F.split(sentence, " ")).alias("kmer"))
    # equal words of a sentence are one row, so that fewer vectors are joined
    words = words.groupBy(*keys, "kmer").agg(F.count("*").alias("__n"))
    sums = [F.sum(F.get("vector", F.lit(i)) * F.col("__n")) / F.sum("__n") for i in range(width)]
    sums = words.join(unit, "kmer").groupBy(*keys).agg(F.array(*sums).alias(out))
    zeros = F.array_repeat(F.lit(0.0), width)
    return sentences.join(sums, list(keys), "left").withColumn(out, F.coalesce(out, zeros))


def kmer_hash_embedding(reads: DataFrame, k: int, keys: Sequence[str] = ("read_id",), strand: str = "revcomp") -> DataFrame:
    """E7. Sparse counts without a vocabulary: (keys, indices, counts), index = k-mer code.

    A read's k-mers are counted where it is; only reads that share their keys are brought together.
    """
    if k > W.MAX_K:
        return _hash_grouped(reads, k, keys, strand)
    once, repeated = by_repetition(reads.select(*keys, "read"), keys)
    lists = once.select(*keys, W.code_counts_column(F.col("read"), k, strand).alias("f")).where(F.size("f") > 0)
    lists = lists.select(*keys, F.col("f.code").alias("indices"), F.col("f.n").alias("counts"))
    return lists if repeated is None else lists.unionByName(_hash_grouped(repeated, k, keys, strand))


def _hash_grouped(reads: DataFrame, k: int, keys: Sequence[str], strand: str) -> DataFrame:
    """``kmer_hash_embedding`` by grouping every k-mer."""
    codes = filter_acgt(kmer_positions(reads, k, keys, strand=strand)).select(*keys, kmer_to_int("kmer").alias("code"))
    counts = codes.groupBy(*keys, "code").agg(F.count("*").alias("n"))
    lists = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("code", "n"))).alias("f"))
    return lists.select(*keys, F.col("f.code").alias("indices"), F.col("f.n").alias("counts"))


def genome_embedding(
    genomes: DataFrame,
    vectors: DataFrame,
    k: int,
    max_length: int = 20,
    genome: str = "genome_id",
    seq: str = "seq",
    metadata: DataFrame | None = None,
    done: DataFrame | None = None,
    **options,
) -> DataFrame:
    """E8. Mean read embedding of the pieces of every genome, joined to the metadata.

    ``genomes`` has one row per sequence line; genomes listed in ``done`` are skipped.
    """
    if done is not None:
        genomes = genomes.join(done.select(genome), genome, "left_anti")
    dim = vectors.select(F.size("vector").alias("d")).first().d
    pieces = genomes.select(genome, F.posexplode(fragments(seq, max_length)).alias("__piece", "__text"))
    embedded = read_embedding(pieces, vectors, k, read="__text", keys=(genome, "__piece", "__text"), out="__e", **options)
    means = embedded.groupBy(genome).agg(vector_sums("__e", dim, F.avg).alias("embedding"))
    return means if metadata is None else metadata.join(means, genome)


def projection_checks(v: Column | str, dim: int) -> list[Column]:
    """Sum and index-weighted sum of a vector: two numbers that any wrong dimension changes."""
    v = F.col(v) if isinstance(v, str) else v
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    ramp = F.zip_with(v, F.sequence(F.lit(1), F.lit(dim)), lambda x, i: x * i)
    return [total, F.aggregate(ramp, F.lit(0.0), lambda a, x: a + x)]
