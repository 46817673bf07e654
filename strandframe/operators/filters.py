"""Projections and filters on reads and matrices (inventory B4-B8, B11)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import number_rows

CONTROL = "Control"


def wide_embedding(df: DataFrame, dim: int, embedding: str = "embedding", prefix: str = "") -> DataFrame:
    """B4. Array column to columns 0..dim-1."""
    rest = [c for c in df.columns if c != embedding]
    return df.select(*[F.col(f"`{c}`") for c in rest], *[F.get(embedding, F.lit(i)).alias(f"{prefix}{i}") for i in range(dim)])


def feature_columns(df: DataFrame) -> list[str]:
    """B5. Columns whose name is an integer."""
    return [c for c in df.columns if _is_int(c)]


def id_columns(df: DataFrame) -> list[str]:
    """B5. The other columns."""
    return [c for c in df.columns if not _is_int(c)]


def matrix_features(df: DataFrame, count: str = "count") -> list[str]:
    """B5. The count column followed by the digit columns."""
    return [count, *[c for c in df.columns if c.isdigit()]]


def _is_int(name: str) -> bool:
    try:
        int(name)
    except ValueError:
        return False
    return True


def drop_incomplete(df: DataFrame, group: str = "group", null_to_control: bool = False) -> DataFrame:
    """B6. Rows without any null; a null group becomes Control first if asked."""
    if null_to_control:
        df = df.withColumn(group, F.coalesce(F.col(group), F.lit(CONTROL)))
    return df.dropna("any")


def binary_label(disease: str, group: Column | str = "group") -> Column:
    """B7. 1 for the disease, else 0."""
    g = F.col(group) if isinstance(group, str) else group
    return F.when(g == disease, 1).otherwise(0)


def multi_dataset_label(datasets: Sequence[tuple[DataFrame, str]], group: str = "group", label: str = "label") -> DataFrame:
    """B8. Datasets stacked; the positive class of dataset j > 0 is j + 1, negatives stay 0."""
    parts = []
    for j, (df, disease) in enumerate(datasets):
        parts.append(df.withColumn(label, binary_label(disease, group) * (j + 1)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def limit_reads(reads: DataFrame, n: int, sample: str = "sample_id", read_id: str = "read_id") -> DataFrame:
    """B11. At most n reads per sample, the first by read id; all when n <= 0."""
    if n <= 0:
        return reads
    numbered = number_rows(reads, [sample], [F.col(read_id), F.xxhash64(*reads.columns)], "__n")
    return numbered.filter(F.col("__n") <= n).drop("__n")
