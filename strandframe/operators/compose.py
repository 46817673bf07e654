"""Compositional transforms in long form (inventory K7, K8).

Rows are (sample, part, value), dense: every sample has every part. Windows run
over the parts of one sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def multiplicative_replacement(
    df: DataFrame, sample: str, value: str = "value", part: str = "part", closure: str = "row", delta: float | None = None
) -> DataFrame:
    """K7. Rows closed to one, zeros replaced by delta (default 1/D^2), the rest scaled by 1 - delta * zeros.

    ``closure='column'`` first divides by the totals of the parts.
    """
    rows = df
    if closure == "column":
        totals = rows.groupBy(part).agg(F.sum(value).alias("__t"))
        rows = rows.join(totals, part).withColumn(value, F.col(value) / F.col("__t")).drop("__t")
    elif closure != "row":
        raise ValueError(closure)
    w = Window.partitionBy(sample)
    d = F.count("*").over(w)
    small = F.lit(delta) if delta is not None else 1.0 / (d * d)
    closed = rows.withColumns(
        {"__x": F.col(value) / F.sum(value).over(w), "__d": small, "__z": F.sum((F.col(value) == 0).cast("int")).over(w)}
    )
    out = F.when(F.col("__x") == 0, F.col("__d")).otherwise(F.col("__x") * (1 - F.col("__d") * F.col("__z")))
    return closed.withColumn(value, out).drop("__x", "__d", "__z")


def clr(df: DataFrame, sample: str, value: str = "value") -> DataFrame:
    """K8. ln x minus the mean of ln x over the sample."""
    log = F.log(value)
    return df.withColumn(value, log - F.avg(log).over(Window.partitionBy(sample)))


def alr(df: DataFrame, sample: str, part: str = "part", value: str = "value") -> DataFrame:
    """K8. ln x minus ln of the sample's first part, which drops out."""
    w = Window.partitionBy(sample)
    first = F.min_by(F.log(value), part).over(w)
    rows = df.withColumns({"__v": F.log(value) - first, "__first": F.min(part).over(w)})
    return rows.filter(F.col(part) != F.col("__first")).withColumn(value, F.col("__v")).drop("__v", "__first")


def ilr(df: DataFrame, sample: str, part: str = "part", value: str = "value") -> DataFrame:
    """K8. sqrt(j / (j + 1)) * (mean(ln x_1..x_j) - ln x_{j+1}) for j = 1..D-1; ``part`` becomes j."""
    order = Window.partitionBy(sample).orderBy(part)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    log = F.log(value)
    rows = df.withColumns(
        {"__j": F.row_number().over(order), "__mean": F.avg(log).over(upto), "__next": F.lead(log).over(order)}
    ).filter(F.col("__next").isNotNull())
    j = F.col("__j")
    scaled = F.sqrt(j / (j + 1)) * (F.col("__mean") - F.col("__next"))
    return rows.withColumns({value: scaled, part: j.cast("bigint")}).drop("__j", "__mean", "__next")
