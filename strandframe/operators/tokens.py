"""Token sequences over a k-mer vocabulary (inventory C10, C11)."""

from __future__ import annotations

from collections.abc import Sequence

from functools import reduce

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.seq import UNK, canonical, kmer_starts
from ..session import broadcast_if_small, fits, materialize

PAD = -2
UNKNOWN = -1
# a vocabulary is sent to the tasks only up to this size
TABLE_MAX_ROWS = 1 << 20


def unknown_id(vocab: DataFrame) -> F.Column:
    """Id of ``<unk>`` when the vocabulary has it, else -1."""
    return F.coalesce(vocab.filter(F.col("kmer") == UNK).agg(F.min("id").cast("int")).scalar(), F.lit(UNKNOWN))


def kmer_positions(
    reads: DataFrame, k: int, keys: Sequence[str], s: int = 1, strand: str | None = "revcomp", read: str = "read"
) -> DataFrame:
    """One row (keys, pos, kmer) per k-mer start; reads shorter than k give none."""
    rows = reads.select(*keys, F.col(read).alias("__read"), F.explode(kmer_starts(read, k, s)).alias("pos"))
    return rows.select(*keys, "pos", canonical(F.substr("__read", F.col("pos"), F.lit(k)), strand).alias("kmer"))


def by_repetition(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose keys nothing else has, the rest): the rest, with null keys too, is None if there is none.

    Only a hash of the keys is shuffled. Keys of equal hash are taken as repeated.
    """
    mark = F.xxhash64(*keys).alias("__mark")
    null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in keys])
    marks = rows.select(mark, null.cast("int").alias("__null")).groupBy("__mark").agg(F.count("*").alias("__n"), F.max("__null").alias("__null"))
    many = materialize(marks.where((F.col("__n") > 1) | (F.col("__null") > 0)).select("__mark"))
    if many.isEmpty():
        return rows, None
    many, marked = broadcast_if_small(many), rows.select("*", mark)
    return marked.join(many, "__mark", "left_anti").drop("__mark"), marked.join(many, "__mark", "left_semi").drop("__mark")


def code_table(vocab: DataFrame, k: int, table_rows: int = TABLE_MAX_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted codes of the vocabulary's k-mers and their rows' ``id`` (-1 without one), or None.

    None if it has more than ``table_rows``, a k-mer of other letters than ACGT, or one twice.
    """
    if k > W.MAX_K or not fits(vocab, table_rows):
        return None
    ids = F.col("id").cast("int") if "id" in vocab.columns else F.lit(0)
    known = vocab.where((F.length("kmer") == k) & (F.col("kmer") != UNK)).select("kmer", ids.alias("id")).toArrow().combine_chunks()
    codes = W.codes_of(known.column("kmer").combine_chunks())
    if codes.null_count or len(pc.unique(codes)) < len(codes):
        return None
    codes, ids = codes.to_numpy(), pc.fill_null(known.column("id"), -1).to_numpy()
    valued = pc.is_valid(known.column("id")).to_numpy()
    order = np.argsort(codes[valued])
    return codes[valued][order], ids[valued][order]


def tokenize(
    reads: DataFrame,
    vocab: DataFrame,
    k: int,
    keys: Sequence[str] = ("read_id",),
    max_length: int = -1,
    min_length: int = -1,
    strand: str = "complement",
    table_rows: int = TABLE_MAX_ROWS,
) -> DataFrame:
    """C10. Adds ``tokens``: vocabulary ids in read order, runs of unknown k-mers as one.

    ``keys`` identify a read. A vocabulary of up to ``table_rows`` k-mers goes to the tasks, and reads are not
    shuffled; with a larger one, and for reads that share their keys, k-mers are joined with it.
    """
    text = F.col("read") if max_length <= 0 else F.substr(F.col("read"), F.lit(1), F.lit(max_length))
    cut = reads.select(*keys, text.alias("read"))
    table = code_table(vocab, k, table_rows)
    if table is None:
        out = _tokens_joined(cut, vocab, k, keys, strand)
    else:
        unk = vocab.select(unknown_id(vocab).alias("u")).first()
        shared = reads.sparkSession.sparkContext.broadcast((*table, unk.u if unk else UNKNOWN))
        once, repeated = by_repetition(cut, keys)
        out = once.withColumn("tokens", W.tokens_column(F.col("read"), shared, k, strand))
        if repeated is not None:
            out = out.unionByName(_tokens_joined(repeated, vocab, k, keys, strand))
    if min_length > 0:
        extra = F.greatest(F.lit(min_length), F.length("read")) - F.greatest(F.length("read"), F.lit(k - 1))
        out = out.withColumn("tokens", F.concat("tokens", F.array_repeat(F.lit(PAD), F.greatest(extra, F.lit(0)))))
    return out.drop("read")


def _tokens_joined(cut: DataFrame, vocab: DataFrame, k: int, keys: Sequence[str], strand: str) -> DataFrame:
    """``tokenize`` with the vocabulary joined: partial lists of a read form before the shuffle, since its k-mers stay together."""
    unk = unknown_id(vocab)
    known = vocab.select(F.col("kmer").alias("__word"), F.col("id").cast("int").alias("__id"))
    pairs = (
        kmer_positions(cut, k, keys, strand=strand)
        .join(known, F.col("kmer") == F.col("__word"), "left")
        .select(*keys, F.struct("pos", F.coalesce("__id", unk).alias("id"), F.col("__id").isNull().alias("unk")).alias("t"))
    )
    lists = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("t"))
    kept = F.filter("t", lambda x, i: ~x["unk"] | (i == 0) | ~F.get("t", i - 1)["unk"])
    lists = lists.select(*keys, F.transform(kept, lambda x: x["id"]).alias("tokens"))
    return cut.join(lists, list(keys), "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<int>")))


def pad_tokens(tokens: DataFrame) -> DataFrame:
    """C11. Right-pads ``tokens`` with -2 to the longest list of the frame."""
    longest = tokens.agg(F.max(F.size("tokens"))).scalar()
    return tokens.withColumn(
        "tokens", F.concat("tokens", F.array_repeat(F.lit(PAD), longest - F.size("tokens")))
    )
