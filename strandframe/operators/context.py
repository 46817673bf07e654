"""Context pairs and co-occurrence of k-mers (inventory D8-D12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import kmer_starts, orient_pair
from ..functions.words import pair_counter


def context_pairs(
    reads: DataFrame,
    k: int,
    kc: int,
    w: int,
    s: int = 1,
    side: str = "both",
    keys: Sequence[str] = (),
    read: str = "read",
) -> DataFrame:
    """D8. (keys, kmer, context): contexts of kc letters next to each k-mer.

    Right contexts start at i+k+j*kc, left ones at i-(j+1)*kc, j = 0..w-1; only
    complete ones. ``side`` is ``both`` or ``right``.
    """
    starts = reads.select(*keys, F.col(read).alias("__r"), F.explode(kmer_starts(read, k, s)).alias("__i"))
    offsets = [k + j * kc for j in range(w)]
    if side == "both":
        offsets += [-(j + 1) * kc for j in range(w)]
    near = starts.select("*", F.explode(F.array(*[F.col("__i") + o for o in offsets])).alias("__c"))
    near = near.filter((F.col("__c") >= 1) & (F.col("__c") + kc - 1 <= F.length("__r")))
    return near.select(
        *keys,
        F.substr("__r", F.col("__i"), F.lit(k)).alias("kmer"),
        F.substr("__r", F.col("__c"), F.lit(kc)).alias("context"),
    )


def orient(pairs: DataFrame) -> DataFrame:
    """D9. Pairs in the orientation of C17."""
    other = [c for c in pairs.columns if c not in ("kmer", "context")]
    turned = pairs.select(*other, orient_pair("kmer", "context").alias("__p"))
    return turned.select(*other, F.col("__p.a").alias("kmer"), F.col("__p.b").alias("context"))


def context_counts(reads: DataFrame, k: int, kc: int, w: int, s: int = 1, read: str = "read") -> DataFrame:
    """D10. Oriented right contexts counted; distinct plain pairs are oriented, not every occurrence."""
    plain = context_pairs(reads, k, kc, w, s, "right", read=read)
    plain = plain.groupBy("kmer", "context").agg(F.count("*").alias("count"))
    return orient(plain).groupBy("kmer", "context").agg(F.sum("count").alias("count"))


def context_probability(counts: DataFrame) -> DataFrame:
    """D11. Adds ``probability`` = count / total count."""
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn("probability", F.col("count") / total)


def near_counts(sentences: DataFrame, words: Column | str, window: int) -> DataFrame:
    """(a, b, d, n): words d <= window places apart in a sentence, added up inside tasks; a pair has a row per task that met it."""
    lists = sentences.select((F.col(words) if isinstance(words, str) else words).alias("words"))
    kind = lists.schema["words"].dataType.elementType.simpleString()
    return lists.mapInArrow(pair_counter(window), f"a {kind}, b {kind}, d int, n long")


def cooccurrence(sentences: DataFrame, words: Column | str, window: int) -> DataFrame:
    """D12. (a, b, weight): symmetric counts of words at distance d <= window, weighted 1/d.

    ``words`` is the array of vocabulary words of a sentence. Pairs stay inside
    a row, are counted as integers per (a, b, d), and get their weight and
    their mirror image after the aggregation.
    """
    arr = F.col(words) if isinstance(words, str) else words
    counted = near_counts(sentences, arr, window).groupBy("a", "b", "d").agg(F.sum("n").alias("n"))
    both = counted.select(
        F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))),
        (F.col("n") / F.col("d")).alias("w"),
    )
    return both.groupBy("a", "b").agg(F.sum("w").alias("weight"))
