"""Section J: scores of read assignments and of folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cv as CV
from ..operators import metrics as M
from .fixtures import add_view
from .registry import query
from .sql import flip

BIG = "bigint"
T0 = 0.35


def _pred(fx):
    return fx.reads.select("read_id", "sim_id", "tax_id", "predict", "prob")


def label_sql(source: str, by: str, ok: str) -> str:
    """Label statistics with rejected reads predicted as -1."""
    cols = f"{by}, " if by else ""
    return f"""SELECT {cols} label, sum(tp) AS tp, sum(predicted) AS predicted, sum(kept) AS kept, sum(support) AS support FROM (
      SELECT {cols} true_id AS label, CAST({ok} AND true_id = pred_id AS INT) AS tp, 0 AS predicted, CAST({ok} AS INT) AS kept, 1 AS support FROM {source}
      UNION ALL SELECT {cols} CASE WHEN {ok} THEN pred_id ELSE -1 END, 0, 1, 0, 0 FROM {source}) GROUP BY {cols} label"""


SCORES = """coalesce(sum(tp) / nullif(sum(kept), 0), 0) AS accuracy,
  coalesce(avg(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END) FILTER (label <> -1 AND (predicted > 0 OR kept > 0)), 0) AS precision,
  avg(CASE WHEN support > 0 THEN tp / support ELSE 0 END) AS recall,
  avg(2 * tp / (predicted + support)) AS f1,
  (sum(support) - sum(kept)) / sum(support) AS reject_rate"""

add_view("predictions", "SELECT read_id, sim_id, tax_id AS true_id, predict AS pred_id, prob FROM reads")
add_view("stats35", label_sql("predictions", "", f"prob > {T0}"))
add_view("scores35", f"SELECT {SCORES} FROM stats35")
add_view(
    "stats_by_step",
    label_sql("(SELECT *, unnest(range(0, 100)) AS step FROM predictions)", "step", "prob > step * CAST(0.01 AS DOUBLE)"),
)
add_view("scores_by_step", f"SELECT step, {SCORES} FROM stats_by_step GROUP BY step")


@query(
    "j1_reject_by_threshold",
    f"SELECT read_id, CASE WHEN prob > {T0} THEN pred_id ELSE -1 END AS prediction_threshold FROM predictions",
)
def _(fx):
    return M.reject_by_threshold(_pred(fx), T0).select("read_id", "prediction_threshold")


for _name, _col, _fn in (
    ("j2_accuracy", "accuracy", M.accuracy),
    ("j3_macro_precision", "precision", M.macro_precision),
    ("j4_macro_recall", "recall", M.macro_recall),
    ("j5_macro_f1", "f1", M.macro_f1),
):

    @query(_name, f"SELECT round({_col}, 9) AS {_col} FROM scores35")
    def _(fx, fn=_fn, col=_col):
        return fn(_pred(fx), T0).select(F.round(col, 9).alias(col))


@query("j6_reject_rate", "SELECT round(reject_rate, 9) AS reject_rate FROM scores35")
def _(fx):
    return M.reject_rate(_pred(fx), T0).select(F.round("reject_rate", 9).alias("reject_rate"))


@query(
    "j7_reject_rate_by_class",
    f"""SELECT true_id AS tax_id, round(count(*) FILTER (prob <= {T0}) / count(*), 9) AS reject_rate FROM predictions
    GROUP BY true_id HAVING count(*) FILTER (prob <= {T0}) > 0""",
)
def _(fx):
    return M.reject_rate_by_class(_pred(fx), T0).withColumn("reject_rate", F.round("reject_rate", 9))


METRICS = ["accuracy", "precision", "recall", "f1", "reject_rate"]
ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in METRICS)


@query(
    "j8_metrics_by_threshold",
    f"SELECT round(step * CAST(0.01 AS DOUBLE), 2) AS threshold, {ROUNDED} FROM scores_by_step",
)
def _(fx):
    m = M.metrics_by_threshold(_pred(fx))
    return m.select(F.round("threshold", 2).alias("threshold"), *[F.round(c, 9).alias(c) for c in METRICS])


@query(
    "j8_reject_by_class",
    """SELECT label, round(sum((support - kept) / support), 6) AS reject_rate_sum FROM stats_by_step WHERE support > 0 GROUP BY label""",
)
def _(fx):
    out = M.reject_by_class_over_thresholds(_pred(fx))
    return out.withColumn("reject_rate_sum", F.round("reject_rate_sum", 6))


BEST = "round(precision / pow(reject_rate + 1, 3), 12)"


@query(
    "j9_best_threshold",
    f"""SELECT round(step * CAST(0.01 AS DOUBLE), 2) AS threshold, round({BEST}, 9) AS score FROM scores_by_step
    ORDER BY {BEST} DESC, step DESC LIMIT 1""",
)
def _(fx):
    b = M.best_threshold(M.metrics_by_threshold(_pred(fx)))
    return b.select(F.round("threshold", 2).alias("threshold"), F.round("score", 9).alias("score"))


@query(
    "j10_score_report",
    f"""WITH s AS ({label_sql('predictions', 'sim_id', f'prob > {T0}')})
    SELECT sim_id AS dataset, CAST(count(*) FILTER (support > 0) AS BIGINT) AS nb_class, CAST({T0} AS DOUBLE) AS threshold,
      round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1
    FROM s JOIN (SELECT sim_id AS sid, {SCORES} FROM s GROUP BY sim_id) ON sim_id = sid GROUP BY ALL""",
)
def _(fx):
    r = M.score_report(_pred(fx).withColumnRenamed("sim_id", "dataset"), T0)
    return r.select("dataset", "nb_class", "threshold", *[F.round(c, 9).alias(c) for c in METRICS[:4]])


@query(
    "j11_confusion_matrix",
    """WITH labels AS (SELECT true_id AS label FROM predictions UNION SELECT pred_id FROM predictions),
    cells AS (SELECT true_id, pred_id, count(*) AS n FROM predictions GROUP BY ALL)
    SELECT a.label AS "true", b.label AS "pred", round(coalesce(n / sum(n) OVER (PARTITION BY a.label), 0), 9) AS share
    FROM labels a CROSS JOIN labels b LEFT JOIN cells ON true_id = a.label AND pred_id = b.label""",
)
def _(fx):
    return M.confusion_matrix(_pred(fx)).withColumn("share", F.round("share", 9))


add_view(
    "proportions",
    """SELECT coalesce(t.sim_id, p.sim_id) AS sim_id, coalesce(t.tax_id, p.tax_id) AS tax_id,
      coalesce(proportion_true, 0) AS proportion_true, coalesce(proportion_pred, 0) AS proportion_pred
    FROM (SELECT sim_id, true_id AS tax_id, count(*) / sum(count(*)) OVER (PARTITION BY sim_id) AS proportion_true FROM predictions GROUP BY sim_id, true_id) t
    FULL JOIN (SELECT sim_id, pred_id AS tax_id, count(*) / sum(count(*)) OVER (PARTITION BY sim_id) AS proportion_pred FROM predictions GROUP BY sim_id, pred_id) p
    ON t.sim_id = p.sim_id AND t.tax_id = p.tax_id""",
)


@query(
    "j12_proportion_true_vs_pred",
    "SELECT sim_id, tax_id, round(proportion_true, 9) AS proportion_true, round(proportion_pred, 9) AS proportion_pred FROM proportions",
)
def _(fx):
    p = M.proportion_true_vs_pred(_pred(fx))
    return p.select("sim_id", "tax_id", F.round("proportion_true", 9).alias("proportion_true"), F.round("proportion_pred", 9).alias("proportion_pred"))


@query(
    "j13_spearman_by_sim",
    """SELECT sim_id, round(corr(a, b), 9) AS spearman FROM (SELECT sim_id,
      rank() OVER (PARTITION BY sim_id ORDER BY proportion_true) + (count(*) OVER (PARTITION BY sim_id, proportion_true) - 1) / 2 AS a,
      rank() OVER (PARTITION BY sim_id ORDER BY proportion_pred) + (count(*) OVER (PARTITION BY sim_id, proportion_pred) - 1) / 2 AS b
    FROM proportions) GROUP BY sim_id""",
)
def _(fx):
    s = M.spearman_by_sim(M.proportion_true_vs_pred(_pred(fx)), digits=None)
    return s.withColumn("spearman", F.round("spearman", 9))


add_view(
    "ranked_predictions",
    """SELECT CASE WHEN substr(md5(read_id), 1, 1) < '5' THEN 'valid' ELSE 'train' END AS dataset, sim_id,
      t.species AS true_id, coalesce(p.species, -1) AS pred_id, prob
    FROM reads r JOIN genome t ON r.tax_id = t.tax_id LEFT JOIN genome p ON r.predict = p.tax_id""",
)
RANK_STEPS = label_sql(
    "(SELECT *, unnest(range(0, 100)) AS step FROM ranked_predictions)", "dataset, step", "prob > step * CAST(0.01 AS DOUBLE)"
)


def _report(fx, **options):
    part = F.when(F.substr(F.md5("read_id"), F.lit(1), F.lit(1)) < "5", "valid").otherwise("train")
    return M.read2genome_scores(fx.reads.select("read_id", "read", "sim_id", "tax_id", "predict", "prob").withColumn("dataset", part), fx.genome, "species", **options)


@query(
    "j14_read2genome_scores",
    f"""WITH stats AS ({RANK_STEPS}),
    curves AS (SELECT dataset, step, CAST(count(*) FILTER (support > 0) AS BIGINT) AS nb_class, {SCORES} FROM stats GROUP BY dataset, step),
    best AS (SELECT dataset, step FROM (SELECT dataset, step,
      row_number() OVER (PARTITION BY dataset ORDER BY {BEST} DESC, step DESC) AS rn FROM curves) WHERE rn = 1)
    SELECT c.dataset, 'zero' AS "at", nb_class, CAST(0 AS DOUBLE) AS threshold, {', '.join(f'round({c}, 9) AS {c}' for c in METRICS[:4])} FROM curves c WHERE step = 0
    UNION ALL SELECT c.dataset, 'best', nb_class, round(c.step * CAST(0.01 AS DOUBLE), 2), {', '.join(f'round({c}, 9)' for c in METRICS[:4])}
    FROM curves c JOIN best b ON c.dataset = b.dataset AND c.step = b.step""",
)
def _(fx):
    m = _report(fx)["metrics"]
    return m.select("dataset", "at", "nb_class", F.round("threshold", 2).alias("threshold"), *[F.round(c, 9).alias(c) for c in METRICS[:4]])


@query(
    "j14_curves",
    f"""SELECT dataset, round(step * CAST(0.01 AS DOUBLE), 2) AS threshold, {', '.join(f'round({c}, 9) AS {c}' for c in METRICS)}
    FROM (SELECT dataset, step, {SCORES} FROM ({RANK_STEPS}) GROUP BY dataset, step)""",
)
def _(fx):
    c = _report(fx)["curves"]
    return c.select("dataset", F.round("threshold", 2).alias("threshold"), *[F.round(m, 9).alias(m) for m in METRICS])


@query(
    "j14_best",
    f"""SELECT dataset, round(step * CAST(0.01 AS DOUBLE), 2) AS threshold, round({BEST}, 9) AS score FROM (SELECT *,
      row_number() OVER (PARTITION BY dataset ORDER BY {BEST} DESC, step DESC) AS rn
      FROM (SELECT dataset, step, {SCORES} FROM ({RANK_STEPS}) GROUP BY dataset, step)) WHERE rn = 1""",
)
def _(fx):
    return _report(fx)["best"].select("dataset", F.round("threshold", 2).alias("threshold"), F.round("score", 9).alias("score"))


@query(
    "j14_proportion",
    """SELECT coalesce(t.sim_id, p.sim_id) AS sim_id, coalesce(t.species, p.species) AS species,
      round(coalesce(a, 0), 9) AS proportion_true, round(coalesce(b, 0), 9) AS proportion_pred FROM
      (SELECT sim_id, true_id AS species, count(*) / sum(count(*)) OVER (PARTITION BY sim_id) AS a FROM ranked_predictions WHERE dataset = 'valid' GROUP BY sim_id, true_id) t
      FULL JOIN (SELECT sim_id, pred_id AS species, count(*) / sum(count(*)) OVER (PARTITION BY sim_id) AS b FROM ranked_predictions WHERE dataset = 'valid' GROUP BY sim_id, pred_id) p
      ON t.sim_id = p.sim_id AND t.species = p.species""",
)
def _(fx):
    p = _report(fx)["proportion"]
    return p.select("sim_id", "species", F.round("proportion_true", 9).alias("proportion_true"), F.round("proportion_pred", 9).alias("proportion_pred"))


@query(
    "j14_correlation",
    """WITH p AS (SELECT coalesce(t.sim_id, p.sim_id) AS sim_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM
      (SELECT sim_id, true_id, count(*) / sum(count(*)) OVER (PARTITION BY sim_id) AS a FROM ranked_predictions WHERE dataset = 'valid' GROUP BY sim_id, true_id) t
      FULL JOIN (SELECT sim_id, pred_id, count(*) / sum(count(*)) OVER (PARTITION BY sim_id) AS b FROM ranked_predictions WHERE dataset = 'valid' GROUP BY sim_id, pred_id) p
      ON t.sim_id = p.sim_id AND true_id = pred_id)
    SELECT sim_id, round(corr(ra, rb), 2) AS spearman FROM (SELECT sim_id,
      rank() OVER (PARTITION BY sim_id ORDER BY a) + (count(*) OVER (PARTITION BY sim_id, a) - 1) / 2 AS ra,
      rank() OVER (PARTITION BY sim_id ORDER BY b) + (count(*) OVER (PARTITION BY sim_id, b) - 1) / 2 AS rb FROM p) GROUP BY sim_id""",
)
def _(fx):
    return _report(fx)["correlation"]


DATASET = "CASE WHEN substr(md5(read_id), 1, 1) < '5' THEN 'valid' ELSE 'train' END"


@query(
    "j14_align",
    f"""WITH best AS (SELECT dataset, step * CAST(0.01 AS DOUBLE) AS t FROM (SELECT *,
      row_number() OVER (PARTITION BY dataset ORDER BY {BEST} DESC, step DESC) AS rn
      FROM (SELECT dataset, step, {SCORES} FROM ({RANK_STEPS}) GROUP BY dataset, step)) WHERE rn = 1),
    d AS (SELECT r.*, b.t FROM (SELECT *, {DATASET} AS dataset FROM reads) r JOIN best b ON r.dataset = b.dataset),
    n AS (SELECT dataset, t, CAST(count(*) AS BIGINT) AS n_reads FROM d GROUP BY dataset, t),
    pats AS (SELECT dataset, read, count(*) FILTER (prob > t AND predict <> -1) AS n_ok, count(*) FILTER (NOT (prob > t AND predict <> -1)) AS n_no FROM d GROUP BY dataset, read),
    strands AS (SELECT dataset, read AS r, n_ok, n_no FROM pats UNION ALL SELECT dataset, reverse({flip('read')}), n_ok, n_no FROM pats),
    seeds AS (SELECT *, unnest([0, 1, 2]) AS j FROM (SELECT row_number() OVER () AS id, * FROM strands)),
    cut AS (SELECT *, substr(r, CAST(j * 20 + 1 AS INT), 20) AS seed FROM seeds),
    places AS (SELECT tax_id, pos, substr(seq, pos, 20) AS seed, seq FROM (SELECT tax_id, seq, unnest(range(1, length(seq) - 18)) AS pos FROM genome)),
    near AS (SELECT DISTINCT id, dataset, r, n_ok, n_no, tax_id, pos - j * 20 AS start, substr(seq, CAST(pos - j * 20 AS INT), 60) AS w
      FROM cut JOIN places ON cut.seed = places.seed WHERE NOT regexp_matches(cut.seed, '[^ACGT]') AND pos - j * 20 >= 1 AND pos - j * 20 + 59 <= length(seq)),
    hits AS (SELECT dataset, sum(n_ok) AS ok, sum(n_no) AS no FROM near WHERE hamming(translate(r, 'N', '.'), w) <= 2 GROUP BY dataset)
    SELECT n.dataset, round(t, 2) AS threshold, n_reads, round(ok / n_reads, 9) AS accepted_rate, round(no / n_reads, 9) AS rejected_rate FROM n JOIN hits ON n.dataset = hits.dataset""",
)
def _(fx):
    rates = _report(fx, genomes=fx.genome)["align"]
    nine = lambda c: F.round(c, 9).alias(c)
    return rates.select("dataset", F.round("threshold", 2).alias("threshold"), "n_reads", nine("accepted_rate"), nine("rejected_rate"))


add_view(
    "ranked_profile",
    f"""SELECT {DATASET.replace('read_id', 'r.read_id')} AS dataset, r.sim_id, t.species AS true_id, p.species AS pred_id, x.prob
    FROM reads r JOIN profile_predictions x ON x.read_id = r.read_id JOIN genome t ON r.tax_id = t.tax_id JOIN genome p ON x.predict = p.tax_id""",
)


@query(
    "j14_predicted",
    f"""WITH stats AS ({RANK_STEPS.replace('ranked_predictions', 'ranked_profile')}),
    curves AS (SELECT dataset, step, CAST(count(*) FILTER (support > 0) AS BIGINT) AS nb_class, {SCORES} FROM stats GROUP BY dataset, step)
    SELECT dataset, nb_class, {', '.join(f'round({c}, 9) AS {c}' for c in METRICS[:4])} FROM curves WHERE step = 0""",
)
def _(fx):
    from ..operators import assign as A

    profile = A.kmer_profile(fx.genome, 12)
    step = lambda reads: A.read2genome_profile(reads, profile, 12).withColumn("prob", F.round("prob", 6))
    m = _report(fx, predict=step)["metrics"].filter(F.col("at") == "zero")
    return m.select("dataset", "nb_class", *[F.round(c, 9).alias(c) for c in METRICS[:4]])


FOLDS = """SELECT sim_id AS model, tax_id % 3 AS fold, CASE WHEN read_id LIKE '%/1' THEN 'train' ELSE 'test' END AS side,
  CASE WHEN grp = 'Disease' THEN 1 ELSE 0 END AS y, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred, prob FROM reads"""
add_view("fold_rows", FOLDS)


@query(
    "j15_cv_metrics",
    """SELECT model, fold, side, round(avg(CAST(y = pred AS INT)), 9) AS accuracy,
      round(coalesce(sum(y * pred) / nullif(sum(pred), 0), 0), 9) AS precision,
      round(coalesce(sum(y * pred) / nullif(sum(y), 0), 0), 9) AS recall,
      round(coalesce(2 * sum(y * pred) / nullif(sum(y) + sum(pred), 0), 0), 9) AS f1,
      round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0), 9) AS roc_auc
    FROM (SELECT *, rank() OVER (PARTITION BY model, fold, side ORDER BY prob)
      + (count(*) OVER (PARTITION BY model, fold, side, prob) - 1) / 2 AS r FROM fold_rows) GROUP BY model, fold, side""",
)
def _(fx):
    rows = fx.reads.select(
        F.col("sim_id").alias("model"),
        (F.col("tax_id") % 3).alias("fold"),
        F.when(F.col("read_id").endswith("/1"), "train").otherwise("test").alias("side"),
        F.when(F.col("grp") == "Disease", 1).otherwise(0).alias("y"),
        F.when(F.col("prob") > 0.5, 1).otherwise(0).alias("pred"),
        "prob",
    )
    m = CV.cv_metrics(rows)
    return m.select("model", "fold", "side", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")])


@query(
    "j16_cv_summary",
    """SELECT model, round(avg(score), 9) AS mean, round(stddev_pop(score), 9) AS std,
      concat('[', array_to_string(list(printf('%.3f', round(score, 3)) ORDER BY fold), ','), ']') AS folds
    FROM fold_scores GROUP BY model""",
)
def _(fx):
    s = CV.cv_summary(fx.fold_scores)
    return s.select("model", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "folds")


STATS17 = """WITH m AS (SELECT model, CAST(count(*) AS DOUBLE) AS n, avg(score) AS m, var_samp(score) AS v, median(score) AS med FROM fold_scores GROUP BY model),
c AS (SELECT m.model, n, m, v, avg(pow(score - m, 2)) AS m2, avg(pow(score - m, 3)) AS m3, avg(pow(score - m, 4)) AS m4,
  avg(abs(score - med)) AS zm, var_pop(abs(score - med)) AS zv FROM fold_scores s JOIN m ON s.model = m.model GROUP BY ALL),
b AS (SELECT * FROM c ORDER BY m DESC, model DESC LIMIT 1),
p AS (SELECT c.*, b.model AS bmodel, b.n AS bn, b.m AS bm, b.v AS bv, b.zm AS bzm, b.zv AS bzv,
  ((b.n - 1) * b.v + (c.n - 1) * c.v) / (b.n + c.n - 2) AS sp, (b.n * b.zm + c.n * c.zm) / (b.n + c.n) AS zb FROM c, b)
SELECT model, bmodel AS best_model,
  round(((bn + n - 2) * ln(sp) - (bn - 1) * ln(bv) - (n - 1) * ln(v)) / (1 + (1 / (bn - 1) + 1 / (n - 1) - 1 / (bn + n - 2)) / 3), 6) AS bartlett,
  round((bn + n - 2) * (bn * pow(bzm - zb, 2) + n * pow(zm - zb, 2)) / (bn * bzv + n * zv), 6) AS levene,
  round((bm - m) / sqrt(sp * (1 / bn + 1 / n)), 6) AS t_pooled,
  round((bm - m) / sqrt(bv / bn + v / n), 6) AS t_welch,
  round(pow(bv / bn + v / n, 2) / (pow(bv / bn, 2) / (bn - 1) + pow(v / n, 2) / (n - 1)), 6) AS df_welch FROM p"""


@query("j17_cv_statistics", STATS17)
def _(fx):
    s = CV.cv_statistics(fx.fold_scores)
    nums = ["bartlett", "levene", "t_pooled", "t_welch", "df_welch"]
    # plus zero turns a rounded -0.0 into 0.0
    return s.select("model", "best_model", *[(F.round(c, 6) + 0.0).alias(c) for c in nums])


@query("j17_cv_significance")
def _(fx):
    return CV.cv_significance(fx.fold_scores)
