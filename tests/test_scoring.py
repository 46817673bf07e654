"""Scores against brute force, and the statistics of fold comparison."""

import math
import random

from strandframe.functions.stats import beta_fraction, t_two_sided
from strandframe.operators import cv as CV
from strandframe.operators import metrics as M


def brute(rows, t):
    """J2-J6 by their definitions."""
    kept = [(a, b) for a, b, p in rows if p > t and b != -1]
    every = [(a, b if p > t and b != -1 else -1) for a, b, p in rows]

    def macro(pairs, f):
        labels = {x for ab in pairs for x in ab}
        if not labels:
            return 0.0
        return sum(f(pairs, x) for x in labels) / len(labels)

    tp = lambda ps, x: sum(a == x == b for a, b in ps)
    div = lambda a, b: a / b if b else 0.0
    precision = lambda ps, x: div(tp(ps, x), sum(b == x for _, b in ps))
    recall = lambda ps, x: div(tp(ps, x), sum(a == x for a, _ in ps))
    f1 = lambda ps, x: div(2 * tp(ps, x), sum(a == x for a, _ in ps) + sum(b == x for _, b in ps))
    return {
        "accuracy": div(sum(a == b for a, b in kept), len(kept)),
        "precision": macro(kept, precision),
        "recall": macro(every, recall),
        "f1": macro(every, f1),
        "reject_rate": 1 - len(kept) / len(rows),
    }


def predictions(seed, n=300):
    rng = random.Random(seed)
    # probabilities on the borders of the grid and between
    prob = lambda: rng.choice([0.0, 1.0, rng.randrange(100) * 0.01, rng.random()])
    return [(rng.randrange(5), rng.choice([-1, 0, 1, 2, 3, 7]), prob()) for _ in range(n)]


def test_every_threshold_equals_brute_force(spark):
    rows = predictions(1)
    df = spark.createDataFrame(rows, "tax_id bigint, predict bigint, prob double").cache()
    curve = {round(r.threshold, 2): r for r in M.metrics_by_threshold(df).collect()}
    assert len(curve) == 100
    for i in range(100):
        want = brute(rows, i * 0.01)
        for name, value in want.items():
            assert math.isclose(curve[round(i * 0.01, 2)][name], value, abs_tol=1e-9), (i, name)
    for t in (0.0, 0.355, 0.999999, 1.0):
        want = brute(rows, t)
        got = M.scores(M.label_stats(df, t)).first()
        assert all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())
        assert math.isclose(M.reject_rate(df, t).first()[0], want["reject_rate"], abs_tol=1e-12)


def test_best_threshold_prefers_the_highest_on_ties(spark):
    df = spark.createDataFrame([(0.1, 0.5, 0.0), (0.3, 0.5, 0.0), (0.2, 0.4, 0.0)], "threshold double, precision double, reject_rate double")
    assert M.best_threshold(df).first().threshold == 0.3


def test_spearman_with_ties(spark):
    rows = [("s", 0.1, 0.2), ("s", 0.1, 0.3), ("s", 0.5, 0.3), ("s", 0.3, 0.2)]
    got = M.spearman_by_sim(spark.createDataFrame(rows, "sim_id string, proportion_true double, proportion_pred double"), digits=None)
    # ranks 1.5 1.5 4 3 and 1.5 3.5 3.5 1.5
    a, b = [1.5, 1.5, 4, 3], [1.5, 3.5, 3.5, 1.5]
    da, db = [x - 2.5 for x in a], [x - 2.5 for x in b]
    want = sum(x * y for x, y in zip(da, db)) / math.sqrt(sum(x * x for x in da) * sum(y * y for y in db))
    assert math.isclose(got.first().spearman, want)


def test_auc_brute_force(spark):
    rng = random.Random(3)
    rows = [("m", 0, "test", rng.randrange(2), 1, rng.choice([0.1, 0.5, rng.random()])) for _ in range(200)]
    df = spark.createDataFrame(rows, "model string, fold int, side string, y int, pred int, prob double")
    pos = [r[5] for r in rows if r[3]]
    neg = [r[5] for r in rows if not r[3]]
    want = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / (len(pos) * len(neg))
    assert math.isclose(CV.cv_metrics(df).first().roc_auc, want)


def test_tail_probabilities():
    # closed forms for one and two degrees of freedom
    for t in (0.1, 1.0, 3.7, 20.0):
        assert math.isclose(t_two_sided(t, 1), 1 - 2 / math.pi * math.atan(t), rel_tol=1e-10)
        assert math.isclose(t_two_sided(-t, 2), 1 - t / math.sqrt(2 + t * t), rel_tol=1e-9)
    assert math.isclose(beta_fraction(2.0, 3.0, 0.4), 0.5248, rel_tol=1e-12)
    # tabled 5% point of Student's distribution with 10 degrees of freedom
    assert abs(t_two_sided(2.228139, 10) - 0.05) < 1e-6


def test_fold_comparison(spark):
    rng = random.Random(9)
    rows = [(m, i, base + rng.gauss(0, 0.02)) for m, base in (("a", 0.9), ("b", 0.5), ("c", 0.895)) for i in range(12)]
    rows += [("few", i, 0.1) for i in range(3)]
    df = spark.createDataFrame(rows, "model string, fold int, score double").filter("model <> 'few'")
    got = {r.model: r.significant for r in CV.cv_significance(df).collect()}
    best = max(("a", "c"), key=lambda m: sum(r[2] for r in rows if r[0] == m))
    assert got[best] == 0.0 and got["b"] < 0.001
    assert got["c" if best == "a" else "a"] > 0.05
    s = CV.cv_summary(df).filter("model = 'a'").first()
    xs = [r[2] for r in rows if r[0] == "a"]
    assert math.isclose(s["mean"], sum(xs) / 12) and s.folds.startswith("[") and s.folds.count(",") == 11
