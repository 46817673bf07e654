"""Exact ranks and running sums without a task that sees a whole group.

``bucket`` is a Column that grows with the order (a count, a prefix, the first
hex digits of an md5). Rows are windowed inside (group, bucket); what lies in
earlier buckets comes from a pre-aggregated histogram joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    value: Column,
    name: str,
) -> DataFrame:
    """Adds ``name``: inclusive running sum of ``value`` per group in the given order.

    ``bucket`` lists one or more Columns, most significant first; ties of the
    order count as one step only if the order is not unique, so give a total order.
    """
    keys = [f"__rs_b{i}" for i in range(len(bucket))]
    rows = df.withColumns({**dict(zip(keys, bucket)), "__rs_v": value})
    sizes = rows.groupBy(*group, *keys).agg(F.sum("__rs_v").alias("__rs_n"))
    before = None
    level = sizes
    # one offset per bucket level, coarse to fine, so that each histogram window is small
    for i in range(len(keys)):
        outer, here = [*group, *keys[:i]], keys[i]
        level = sizes.groupBy(*outer, here).agg(F.sum("__rs_n").alias("__rs_n"))
        w = Window.partitionBy(*outer).orderBy(here).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*outer, here, F.coalesce(F.sum("__rs_n").over(w), F.lit(0)).alias(f"__rs_o{i}"))
        before = level if before is None else _join_null_safe(level, before, outer)
    local = F.sum("__rs_v").over(
        Window.partitionBy(*group, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumn("__rs_l", local)
    total = F.col("__rs_l")
    for i in range(len(keys)):
        total = total + F.col(f"__rs_o{i}")
    out = _join_null_safe(rows, before, [*group, *keys])
    return out.select(*df.columns, total.alias(name))


def row_number_by(
    df: DataFrame,
    group: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    name: str = "rank",
) -> DataFrame:
    """Adds ``name``: 1-based row number per group (the whole frame when ``group`` is empty)."""
    return running_sum(df, group, bucket, order, F.lit(1).cast("bigint"), name)


def number_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds ``name``: 1-based row number per group (the whole frame when ``group`` is empty), whatever the order is made of.

    Rows are spread by ranges of (group, order), sorted inside each and written once. A row's number
    is its place in its range, less the group's first place there, and the group's rows in earlier ranges;
    so tasks see a range of rows, not a group. ``order`` must tell rows apart, else equal ones share a range.
    """
    keys = [f"__no_{i}" for i in range(len(group) + len(order))]
    rows = df.withColumns(dict(zip(keys, [*map(F.col, group), *order])))
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__no_id", F.monotonically_increasing_id())
    # the id holds the range in its upper bits and the place in the lower 33
    rows = materialize(rows.drop(*keys)).withColumn("__no_part", F.shiftright("__no_id", 33))
    cells = rows.groupBy("__no_part", *group).agg(F.min("__no_id").alias("__no_first"), F.count("*").alias("__no_n"))
    # one row per range, or per group and range that it lies in
    earlier = Window.partitionBy(*group or [F.lit(0)]).orderBy("__no_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__no_part", *group, "__no_first", F.coalesce(F.sum("__no_n").over(earlier), F.lit(0)).alias("__no_before"))
    number = F.col("__no_before") + F.col("__no_id") - F.col("__no_first") + 1
    return _join_null_safe(rows, cells, ["__no_part", *group]).select(*df.columns, number.alias(name))


def first_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, salt: Column, parts: int = 64
) -> DataFrame:
    """The first ``n`` rows of every group, in two steps.

    The first step ranks inside (group, salt) so a hot group is spread over
    ``parts`` tasks; the second sees at most ``parts * n`` rows of a group.
    """
    spread = df.withColumn("__fr_s", F.pmod(F.xxhash64(salt), F.lit(parts)))
    step = F.row_number().over(Window.partitionBy(*group, "__fr_s").orderBy(*order))
    spread = spread.withColumn("__fr_r", step).filter(F.col("__fr_r") <= n)
    last = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return spread.withColumn("__fr_r", last).filter(F.col("__fr_r") <= n).drop("__fr_s", "__fr_r")


def mark_first(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], n: Column, name: str = "first"
) -> DataFrame:
    """Adds boolean ``name``: the row is among the first ``n`` of its group.

    ``n`` may differ per group. Buckets wholly before or after the border are
    decided from a histogram; only the border bucket of a group is sorted.
    """
    rows = df.withColumn("__mf_b", bucket)
    w = Window.partitionBy(*group).orderBy("__mf_b").rowsBetween(Window.unboundedPreceding, 0)
    sizes = rows.groupBy(*group, "__mf_b").agg(F.count("*").alias("__mf_n"))
    marks = sizes.select(*group, "__mf_b", F.sum("__mf_n").over(w).alias("__mf_upto"), "__mf_n")
    marks = marks.withColumn("__mf_before", F.col("__mf_upto") - F.col("__mf_n")).drop("__mf_n")
    rows = _join_null_safe(rows, marks, [*group, "__mf_b"]).withColumn("__mf_want", n)
    edge = (F.col("__mf_before") < F.col("__mf_want")) & (F.col("__mf_upto") > F.col("__mf_want"))
    clear = rows.filter(~edge).select(*df.columns, (F.col("__mf_upto") <= F.col("__mf_want")).alias(name))
    local = F.row_number().over(Window.partitionBy(*group, "__mf_b").orderBy(*order))
    border = rows.filter(edge).withColumn("__mf_r", local)
    border = border.select(*df.columns, (F.col("__mf_r") + F.col("__mf_before") <= F.col("__mf_want")).alias(name))
    return clear.unionByName(border)


def take_first(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], n: Column
) -> DataFrame:
    """Rows marked by ``mark_first``."""
    return mark_first(df, group, bucket, order, n, "__first").filter("__first").drop("__first")


def md5_bucket(order_key: Column | str, digits: int = 3) -> Column:
    """First hex digits of an md5 order key: 16**digits even buckets."""
    key = F.col(order_key) if isinstance(order_key, str) else order_key
    return F.substr(key, F.lit(1), F.lit(digits))


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` where null equals null; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, cond).drop(*[f"__r_{k}" for k in keys])
