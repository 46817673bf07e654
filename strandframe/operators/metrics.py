"""Scores of read assignments (inventory J1-J14).

Everything above the reads works on pre-aggregated cells: one pass counts
(true, predicted, probability bucket), and all 100 thresholds come from running
sums over at most 101 buckets per label.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

REJECTED = -1
THRESHOLDS = 100


def reject_by_threshold(df: DataFrame, t: float | Column, pred: str = "predict", prob: str = "prob") -> DataFrame:
    """J1. ``prediction_threshold``: the prediction if prob > t, else -1."""
    return df.withColumn("prediction_threshold", F.when(F.col(prob) > t, F.col(pred)).otherwise(F.lit(REJECTED)))


def accepted(t: float | Column, pred: str = "predict", prob: str = "prob") -> Column:
    return (F.col(prob) > t) & (F.col(pred) != REJECTED)


def threshold_bucket(prob: Column | str) -> Column:
    """Largest i with prob > i * 0.01, by comparison rather than by rounding; -1 when none."""
    p = F.col(prob) if isinstance(prob, str) else prob
    c = F.ceil(p * 100).cast("int")
    i = F.when(p > c * F.lit(0.01), c).when(p > (c - 1) * F.lit(0.01), c - 1).otherwise(c - 2)
    return F.greatest(F.lit(-1), F.least(i, F.lit(THRESHOLDS - 1)))


def _label_rows(cells: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    """Per cell one row for its true and one for its predicted label."""
    hit = F.when(ok & (F.col("true") == F.col("pred")), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    acc = F.when(ok, F.col("n")).otherwise(0)
    as_true = F.struct(
        F.col("true").alias("label"), hit.alias("tp"), zero.alias("predicted"), acc.alias("kept"), F.col("n").alias("support")
    )
    as_pred = F.struct(
        F.when(ok, F.col("pred")).otherwise(F.lit(REJECTED)).alias("label"),
        zero.alias("tp"),
        acc.alias("predicted"),
        zero.alias("kept"),
        zero.alias("support"),
    )
    return cells.select(*by, F.inline(F.array(as_true, as_pred)))


def _cells(df: DataFrame, by: Sequence[str], true: str, pred: str, extra: dict[str, Column]) -> DataFrame:
    cols = {**{b: F.col(b) for b in by}, "true": F.col(true), "pred": F.col(pred), **extra}
    cells = df.select(*[c.alias(k) for k, c in cols.items()])
    return cells.groupBy(*cols).agg(F.count("*").alias("n"))


def label_stats(
    df: DataFrame, t: float = 0.0, by: Sequence[str] = (), true: str = "tax_id", pred: str = "predict", prob: str = "prob"
) -> DataFrame:
    """Per label: true positives, predicted and kept counts among accepted reads, support among all."""
    ok = accepted(t, pred, prob)
    cells = _cells(df, by, true, pred, {"ok": ok})
    rows = _label_rows(cells, by, F.col("ok"))
    return rows.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "kept", "support")])


def scores(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """J2-J6 from label statistics.

    Accuracy and macro precision look at accepted reads; recall and F1 at all
    reads with rejected ones predicted as -1, which counts as a class. Macro
    means run over the labels seen as true or predicted; 0/0 counts as 0.
    """
    tp, predicted, kept, support = (F.col(c) for c in ("tp", "predicted", "kept", "support"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    seen_accepted = (predicted > 0) | (kept > 0)
    rejected = F.sum(support) - F.sum(kept)
    # a label row exists for every true label and every predicted one; -1 stands for rejected reads
    n_labels = F.sum(F.when((support > 0) | (predicted > 0), 1).otherwise(0)) + F.when(
        (rejected > 0) & (F.sum(F.when((F.col("label") == REJECTED) & (support > 0), 1).otherwise(0)) == 0), 1
    ).otherwise(0)
    return stats.groupBy(*by).agg(
        share(F.sum(tp), F.sum(kept)).alias("accuracy"),
        F.coalesce(F.avg(F.when(seen_accepted, share(tp, predicted))), F.lit(0.0)).alias("precision"),
        share(F.sum(share(tp, support)), n_labels).alias("recall"),
        share(F.sum(share(2 * tp, predicted + support)), n_labels).alias("f1"),
        share(rejected, F.sum(support)).alias("reject_rate"),
    )


def accuracy(df: DataFrame, t: float = 0.0, **cols) -> DataFrame:
    """J2. Accuracy on accepted reads; 0 when there are none."""
    return scores(label_stats(df, t, **cols), cols.get("by", ())).select(*cols.get("by", ()), "accuracy")


def macro_precision(df: DataFrame, t: float = 0.0, **cols) -> DataFrame:
    """J3."""
    return scores(label_stats(df, t, **cols), cols.get("by", ())).select(*cols.get("by", ()), "precision")


def macro_recall(df: DataFrame, t: float = 0.0, **cols) -> DataFrame:
    """J4."""
    return scores(label_stats(df, t, **cols), cols.get("by", ())).select(*cols.get("by", ()), "recall")


def macro_f1(df: DataFrame, t: float = 0.0, **cols) -> DataFrame:
    """J5."""
    return scores(label_stats(df, t, **cols), cols.get("by", ())).select(*cols.get("by", ()), "f1")


def reject_rate(df: DataFrame, t: float = 0.0, by: Sequence[str] = (), pred: str = "predict", prob: str = "prob") -> DataFrame:
    """J6. Rejected / all."""
    return df.groupBy(*by).agg(F.avg((~accepted(t, pred, prob)).cast("double")).alias("reject_rate"))


def reject_rate_by_class(
    df: DataFrame, t: float = 0.0, true: str = "tax_id", pred: str = "predict", prob: str = "prob"
) -> DataFrame:
    """J7. Rejected / total per true class; classes without rejected reads are absent."""
    counts = df.groupBy(true).agg(
        F.sum((~accepted(t, pred, prob)).cast("bigint")).alias("rejected"), F.count("*").alias("total")
    )
    return counts.filter("rejected > 0").select(true, (F.col("rejected") / F.col("total")).alias("reject_rate"))


def label_curves(
    df: DataFrame, by: Sequence[str] = (), true: str = "tax_id", pred: str = "predict", prob: str = "prob"
) -> DataFrame:
    """``label_stats`` for every threshold step 0..99 from one count of the reads."""
    cells = _cells(df, by, true, pred, {"bucket": threshold_bucket(prob)})
    cells = cells.withColumn("bucket", F.when(F.col("pred") == REJECTED, -1).otherwise(F.col("bucket")))
    zero = F.lit(0).cast("bigint")
    as_true = F.struct(
        F.col("true").alias("label"),
        F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
        zero.alias("predicted"),
        F.col("n").alias("kept"),
    )
    as_pred = F.struct(F.col("pred").alias("label"), zero.alias("tp"), F.col("n").alias("predicted"), zero.alias("kept"))
    sums = [F.sum(c).alias(c) for c in ("tp", "predicted", "kept")]
    steps = cells.select(*by, "bucket", F.inline(F.array(as_true, as_pred))).groupBy(*by, "label", "bucket").agg(*sums)
    grid = (
        steps.select(*by, "label").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(-1), F.lit(THRESHOLDS - 1))))
    )
    dense = grid.select("*", zero.alias("tp"), zero.alias("predicted"), zero.alias("kept")).unionByName(steps)
    dense = dense.groupBy(*by, "label", "bucket").agg(*sums)
    label = Window.partitionBy(*by, "label")
    above = label.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    curves = dense.select(
        *by,
        "label",
        F.col("bucket").alias("step"),
        *[F.sum(c).over(above).alias(c) for c in ("tp", "predicted", "kept")],
        F.sum("kept").over(label).alias("support"),
    )
    return curves.filter("step >= 0")


def metrics_by_threshold(df: DataFrame, by: Sequence[str] = (), **cols) -> DataFrame:
    """J8. J2-J6 for the thresholds 0.99, 0.98, ..., 0.00."""
    out = scores(label_curves(df, by, **cols), [*by, "step"])
    return out.withColumn("threshold", F.col("step") * F.lit(0.01)).drop("step")


def reject_by_class_over_thresholds(df: DataFrame, by: Sequence[str] = (), **cols) -> DataFrame:
    """J8. Per true class the reject rates summed over all thresholds."""
    curves = label_curves(df, by, **cols).filter("support > 0")
    rate = (F.col("support") - F.col("kept")) / F.col("support")
    return curves.groupBy(*by, "label").agg(F.sum(rate).alias("reject_rate_sum"))


def best_threshold(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """J9. Threshold of the highest precision / (reject_rate + 1)^3; ties go to the highest threshold."""
    score = F.col("precision") / F.pow(F.col("reject_rate") + 1, F.lit(3.0))
    return metrics.groupBy(*by).agg(
        F.max_by("threshold", F.struct(F.round(score, 12), "threshold")).alias("threshold"), F.max(score).alias("score")
    )


def score_report(df: DataFrame, t: float = 0.0, dataset: str = "dataset", **cols) -> DataFrame:
    """J10. nb_class, threshold and J2-J5 per dataset."""
    stats = label_stats(df, t, by=[dataset], **cols)
    n = stats.filter("support > 0").groupBy(dataset).agg(F.count("*").alias("nb_class"))
    report = scores(stats, [dataset]).join(n, dataset)
    return report.select(dataset, "nb_class", F.lit(float(t)).alias("threshold"), "accuracy", "precision", "recall", "f1")


def confusion_matrix(
    df: DataFrame, labels: DataFrame | None = None, true: str = "tax_id", pred: str = "predict"
) -> DataFrame:
    """J11. (true, pred, share) for all pairs of labels, rows normalized, empty rows 0.

    ``labels`` has one column ``label``; default: every label met.
    """
    # labels, axis and rows read the cells
    cells = materialize(_cells(df, (), true, pred, {}))
    if labels is None:
        labels = cells.select(F.explode(F.array("true", "pred")).alias("label")).distinct()
    axis = labels.agg(F.array_sort(F.collect_set("label"))).scalar()
    listed = F.array_contains(axis, F.col("true")) & F.array_contains(axis, F.col("pred"))
    kind = labels.schema["label"].dataType
    known = cells.filter(listed).withColumn("pred", F.col("pred").cast(kind)).groupBy("true").agg(F.sum("n").alias("total"), F.collect_list(F.struct("pred", "n")).alias("met"))
    # a row of the matrix is completed where it is, so that no shuffle sees pairs of labels
    met = F.transform("met", lambda x: F.struct(x["pred"].alias("pred"), (x["n"] / F.col("total")).alias("share")))
    known = known.select(F.col("true").alias("__true"), F.transform("met", lambda x: x["pred"]).alias("preds"), met.alias("met"))
    rows = labels.select(F.col("label").alias("true")).join(known, F.col("true") == F.col("__true"), "left")
    rows = rows.select("true", "met", F.array_except(axis, F.coalesce("preds", F.array().cast(T.ArrayType(kind)))).alias("rest"))
    absent = F.transform("rest", lambda x: F.struct(x.alias("pred"), F.lit(0.0).alias("share")))
    none = F.array().cast(known.schema["met"].dataType)
    return rows.select("true", F.inline(F.concat(F.coalesce("met", none), absent)))


def proportion_true_vs_pred(
    df: DataFrame, sim: str = "sim_id", true: str = "tax_id", pred: str = "predict"
) -> DataFrame:
    """J12. Per sim the share of every true and predicted taxon, 0 where absent."""
    cells = _cells(df, [sim], true, pred, {})
    in_sim = Window.partitionBy(sim)

    def side(col: str, name: str) -> DataFrame:
        n = cells.groupBy(sim, F.col(col).alias(true)).agg(F.sum("n").alias("n"))
        return n.select(sim, true, (F.col("n") / F.sum("n").over(in_sim)).alias(name))

    both = side("true", "proportion_true").join(side("pred", "proportion_pred"), [sim, true], "full_outer")
    return both.fillna(0.0, ["proportion_true", "proportion_pred"])


def average_rank(col: str, by: Sequence[str]) -> Column:
    """Rank with ties at their mean rank, inside the groups ``by``."""
    ties = F.count("*").over(Window.partitionBy(*by, col))
    return F.rank().over(Window.partitionBy(*by).orderBy(col)) + (ties - 1) / 2


def spearman_by_sim(proportions: DataFrame, sim: str = "sim_id", digits: int | None = 2) -> DataFrame:
    """J13. Rank correlation of true and predicted proportions, one row per sim.

    The windows run over J12 rows: at most one per taxon and sim.
    """
    ranked = proportions.select(
        sim,
        average_rank("proportion_true", [sim]).alias("a"),
        average_rank("proportion_pred", [sim]).alias("b"),
    )
    rho = F.corr("a", "b")
    return ranked.groupBy(sim).agg((F.round(rho, digits) if digits is not None else rho).alias("spearman"))


def read2genome_scores(
    df: DataFrame,
    taxonomy: DataFrame,
    rank: str = "species",
    taken: Sequence | None = None,
    dataset: str = "dataset",
    predict: Callable[[DataFrame], DataFrame] | None = None,
    genomes: DataFrame | None = None,
    read_id: str = "read_id",
) -> dict[str, DataFrame]:
    """J14. The whole report for reads with a ``dataset`` column (train, valid).

    ``predict`` is the prediction step, a function reads -> (read_id, predict, prob) such as F2 or F3; without
    it the reads bring their predictions. True and predicted ids are converted to ``rank``. Returns the tables
    ``metrics`` (J10 at 0 and at the best threshold), ``curves`` (J8), ``best``
    (J9), ``proportion`` (J12) and ``correlation`` (J13), the last two on valid; with ``genomes`` also
    ``align``, the alignment rates (F5) of every data set at its best threshold.
    """
    from .assign import align_rate, hit_rate, read_hits
    from .datasets import filter_taxa, tax_convert

    if taken is not None:
        df = filter_taxa(df, taxonomy, rank, taken)
    if predict is not None:
        df = df.drop("predict", "prob")
        # all tables of the report use the predictions: made once
        df = materialize(df.join(predict(df).select(read_id, "predict", "prob"), read_id))
    df = tax_convert(df, taxonomy, rank, "tax_id", "true_rank")
    df = tax_convert(df, taxonomy, rank, "predict", "pred_rank")
    df = df.withColumn("pred_rank", F.coalesce("pred_rank", F.lit(REJECTED)))
    cols = {"true": "true_rank", "pred": "pred_rank"}
    curves = label_curves(df, [dataset], **cols)
    metrics = scores(curves, [dataset, "step"]).withColumn("threshold", F.col("step") * F.lit(0.01))
    best = best_threshold(metrics, [dataset])
    n = curves.filter("step = 0 AND support > 0").groupBy(dataset).agg(F.count("*").alias("nb_class"))
    marked = metrics.join(best.select(dataset, F.col("threshold").alias("__best")), dataset)
    zero = marked.filter("step = 0").withColumn("at", F.lit("zero"))
    at_best = marked.filter(F.col("threshold") == F.col("__best")).withColumn("at", F.lit("best"))
    report = zero.unionByName(at_best).join(n, dataset)
    valid = df.filter(F.col(dataset) == "valid")
    proportion = proportion_true_vs_pred(valid, true="true_rank", pred="pred_rank").withColumnRenamed("true_rank", rank)
    out = {
        "metrics": report.select(dataset, "at", "nb_class", "threshold", "accuracy", "precision", "recall", "f1"),
        "curves": metrics.drop("step"),
        "best": best,
        "proportion": proportion,
        "correlation": spearman_by_sim(proportion),
    }
    if genomes is not None:
        # one row per data set
        cuts = [(r[dataset], r.threshold) for r in best.collect()]
        cut = reduce(lambda a, b: a.when(F.col(dataset) == b[0], b[1]), cuts, F).otherwise(None) if cuts else F.lit(None)
        cut = cut.cast("double")
        # all data sets in one pass
        flagged = df.select(dataset, cut.alias("threshold"), accepted(cut).alias("ok"), F.col("read").alias("r")).filter("threshold IS NOT NULL")
        hits = read_hits(flagged, genomes, "r")
        if hits is not None:
            out["align"] = hit_rate(hits, [dataset, "threshold"])
            return out
        rates = [align_rate(df.filter(F.col(dataset) == name), genomes, t).select(F.lit(name).alias(dataset), F.lit(t).alias("threshold"), "*") for name, t in cuts]
        out["align"] = reduce(DataFrame.unionByName, rates)
    return out
