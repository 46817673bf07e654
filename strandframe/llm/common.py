"""Shared helpers: words, hashing of byte ranges, Arrow batches, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

WHITE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.array_remove(F.split(text, WHITE), ""), F.array().cast("array<string>"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def group_key(column: Column) -> Column:
    """A value that keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


class RangeHash:
    """64-bit hashes of any byte ranges of a text from one running sum (polynomial, modulo 2^64)."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int):
        self.table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.sums = np.zeros(1, np.uint64)

    def load(self, data: np.ndarray) -> None:
        n = len(data)
        if len(self.up) < n + 1:
            size = max(n + 1, 2 * len(self.up))
            self.up = self.powers(self.BASE, size)
            self.down = self.powers(pow(self.BASE, -1, 2**64), size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ``k`` bytes in a row."""
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)

    @staticmethod
    def powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the low bits of ``h`` over all 64."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b); component is the smallest reachable node.

    Alternating star contraction: every round hangs each node's neighbours below its smallest
    neighbour, by aggregates and joins only, so a node with very many links is never gathered
    in one task. Rounds are written to the shared folder and end when nothing moves.
    """
    def written(df: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = materialize(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        return out, seen.get

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    (e, now), before = written(e), None
    while now != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows, so that very long texts don't meet in one batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
