"""Operator 7: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import group_key, words

#: Leading hex digits of a key that make a range: 4096 ranges a source.
DIGITS = 3
MOST = 3
WEIGHTS = (1, 2, 3)


def targets(totals: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``totals`` (mix_src, mix_total; one row per source) with the words each source shall give.

    Sources in code point order (null last) weigh ``weights`` in turn and share the sum of all
    sizes. A source stops at ``most`` times its size; the excess goes to the others by weight.
    That is a water level L with sum(min(most * size, L * weight)) = sum(size): sources are
    ranked by the level at which they are full, and the first rank whose level is not reached
    gives L. The table has one row per source, so one window over it is small.
    """
    last = F.when(F.col("mix_src") == "", 1).otherwise(0)
    order = Window.orderBy(last, "mix_src")
    choice = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("w", F.get(choice, (F.row_number().over(order) - 1) % len(weights)))
    t = t.withColumn("cap", F.col("mix_total") * float(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("full_at", "mix_src")
    upto, whole = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    used = F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    left = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    t = t.withColumn("level", (F.sum("mix_total").over(whole) - used) / left)
    reached = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "mix_src", "level"))
    t = t.withColumn("L", F.min(reached).over(whole)["level"])
    return t.select("mix_src", "mix_total", F.least("cap", F.coalesce("L", "full_at") * F.col("w")).alias("mix_target"))


def mix(docs: DataFrame, size: Column | None = None, seed: int = 7, most: int = MOST) -> DataFrame:
    """``docs`` (source, text, doc_id and any others) with size, source_size, target and taken.

    Documents get hash-random keys; the keys' leading bits are ranges whose sizes are summed per
    source (map-side, at most 4096 rows per source), so that prefix sums over ranges tell
    where a source's budget ends. Only rows of that border range are sorted. A source gives whole
    epochs plus a part of one: ``taken`` is epochs * size, plus the size for documents before the
    cut; the document on the cut gives the words up to the exact budget.

    Results depend on ids, sizes, sources and the seed only, so reruns agree. Null text has size 0, null
    source is a source of its own, repeated rows count each; an empty table gives an empty one.
    Texts are not shuffled. Columns of the input that have a result's name are replaced.
    """
    size = F.size(words(F.col("text"))) if size is None else size
    keyed = docs.withColumns(
        {
            "mix_src": group_key(F.col("source")),
            "mix_size": size.cast("bigint"),
            "mix_key": F.md5(F.concat(F.lit(f"{seed}:"), group_key(F.col("doc_id")))),
        }
    ).withColumn("mix_bucket", F.conv(F.substring("mix_key", 1, DIGITS), 16, 10).cast("int"))
    sums = materialize(keyed.groupBy("mix_src", "mix_bucket").agg(F.sum("mix_size").alias("s")))
    aim = targets(sums.groupBy("mix_src").agg(F.sum("s").alias("mix_total")), most)
    aim = aim.withColumn("mix_budget", F.floor(F.col("mix_target") + 0.5)).withColumn(
        "mix_epochs", F.coalesce(F.floor(F.col("mix_budget") / F.nullif("mix_total", F.lit(0))), F.lit(0))
    )
    aim = aim.withColumn("mix_rest", F.col("mix_budget") - F.col("mix_epochs") * F.col("mix_total"))
    before = F.sum("s").over(Window.partitionBy("mix_src").orderBy("mix_bucket")) - F.col("s")
    border = (
        sums.withColumn("before", before)
        .join(aim, "mix_src")
        .where("before < mix_rest and before + s >= mix_rest")
        .select("mix_src", F.col("mix_bucket").alias("mix_border"), F.col("before").alias("mix_before"))
    )
    cut = materialize(aim.join(border, "mix_src", "left"))
    rows = keyed.join(cut, "mix_src")
    whole = F.col("mix_epochs") * F.col("mix_size")
    at_cut = F.col("mix_bucket") == F.coalesce("mix_border", F.lit(-1))
    taken = whole + F.when(F.col("mix_bucket") < F.col("mix_border"), F.col("mix_size")).otherwise(0)
    clear = rows.where(~at_cut).withColumn("taken", taken)
    inside = Window.partitionBy("mix_src").orderBy("mix_key", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("mix_before") + F.coalesce(F.sum("mix_size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("mix_rest") - start))
    out = clear.unionByName(rows.where(at_cut).withColumn("taken", whole + part))
    out = out.withColumns({"size": F.col("mix_size"), "source_size": F.col("mix_total"), "target": F.col("mix_target")})
    return out.drop(*[c for c in out.columns if c.startswith("mix_")])


def mixed_copies(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as the mix takes it, with the columns of ``docs``.

    A document that is taken in part is kept whole, so each source is off its budget by less than one document.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    plan = mix(docs.select(F.struct(*keep).alias("row"), "doc_id", "text", "source"))
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    out = plan.where("taken > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies)))
    return out.select("row.*")
