"""Operator 1: multivariate outliers by minimum-covariance-determinant estimates, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import group_key, words

SPAN = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Share of a group's rows that the estimates rest on.
CORE = 0.75
#: Statistics are kept as whole numbers of 1/UNIT, so that sums are exact in any order.
UNIT = 1024
#: Pseudo-words that steady the statistics of short texts.
PRIOR = 50.0
#: No statistic counts as steadier than this standard deviation.
FLOOR = 0.15
#: Share of ordinary rows that may lie beyond the limit.
TAIL = 1e-6
GROUP_ROWS = 100
LEAST_ROWS = 30
STEPS = 12
FINE = 64
N_STATS = 5

_STATS = [f"q_x{i}" for i in range(N_STATS)]
_CROSS = [(i, j) for i in range(N_STATS) for j in range(i, N_STATS)]


def chi2_cdf(x: float, k: int) -> float:
    """Series of the lower incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(found: Column, span: int = SPAN) -> Column:
    """Words inside windows of ``span`` words that occur twice or more in the text."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - span)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(span)]))

    def covered(w: Column) -> Column:
        ranked = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
            again = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(span), F.coalesce(F.get(p, j + 1) - x, F.lit(span))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return bound(ranked, lambda s: bound(places(s), total))

    some = bound(F.transform(found, lambda x: F.xxhash64(x)), lambda h: bound(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0)))
    return F.when(F.size(found) > span, some).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as struct ``q_row``, the base counts, and the transformed statistics x0..x4.

    The statistics, each with ``PRIOR`` pseudo-words of ordinary text: log of the word length, of
    the symbols, capitals and punctuation per word, and of the share of repeated words and lines,
    with constants that let scripts without capitals or punctuation pass.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("q_row")
    without = lambda chars: F.length(F.translate(F.col("q_text"), chars, ""))
    rows = docs.select(keep, group_key(F.col("lang")).alias("q_lang"), group_key(F.col("source")).alias("q_source"), text.alias("q_text"), words(text).alias("q_words"))
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "q_row",
        "q_lang",
        F.concat("q_lang", F.lit("\0"), "q_source").alias("q_group"),
        F.size("q_words").cast("bigint").alias("n_words"),
        without(" \t\n\x0b\f\r").cast("bigint").alias("word_chars"),
        (F.length("q_text") - without("#*$%&|<>")).cast("bigint").alias("n_symbols"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("q_words")).cast("bigint").alias("n_repeat_words"),
        (F.length("q_text") - F.length(F.regexp_replace("q_text", r"\p{Lu}", ""))).alias("q_upper"),
        (F.length("q_text") - without(".,;:!?")).alias("q_punct"),
    )
    size = F.col("n_words") + PRIOR
    stats = [
        F.log((F.col("word_chars") + 5 * PRIOR) / size),
        F.log(1 + 10 * F.col("n_symbols") / size),
        F.log(0.2 + (F.col("q_upper") + 0.07 * PRIOR) / size),
        F.log(0.3 + (F.col("q_punct") + 0.15 * PRIOR) / size),
        F.log(1 + 5 * (F.col("n_repeat_words") + F.col("n_dup_lines")) / size),
    ]
    rows = rows.withColumns({name: F.round(x * UNIT).cast("bigint") for name, x in zip(_STATS, stats)})
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("q_upper", "q_punct")


def group_names(stats: DataFrame) -> DataFrame:
    """(q_group, q_key): the rows a group is judged with. Groups below ``GROUP_ROWS`` rows share
    those of their language, and languages with few such rows share one key."""
    sizes = stats.groupBy("q_group", "q_lang").agg(F.count("*").alias("n"))
    small = F.sum(F.when(F.col("n") < GROUP_ROWS, F.col("n")).otherwise(0)).over(Window.partitionBy("q_lang"))
    key = F.when(F.col("n") >= GROUP_ROWS, F.col("q_group")).when(F.col("small") >= GROUP_ROWS, F.concat(F.lit("*"), "q_lang")).otherwise("**")
    return sizes.withColumn("small", small).select("q_group", key.alias("q_key"))


def cholesky(df: DataFrame) -> DataFrame:
    """Adds the lower triangle l_i_j of the scatter s_i_j (i <= j), and ``log_det``."""
    for i in range(N_STATS):
        for j in range(i + 1):
            value = F.col(f"s_{j}_{i}")
            for k in range(j):
                value = value - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            df = df.withColumn(f"l_{i}_{j}", F.sqrt(value) if i == j else value / F.col(f"l_{j}_{j}"))
    return df.withColumn("log_det", sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(N_STATS)), F.lit(0.0)))


def distance(df: DataFrame) -> DataFrame:
    """Adds ``distance``, the squared Mahalanobis distance: the length of the solution of L y = x - m."""
    for i, name in enumerate(_STATS):
        value = F.col(name) / UNIT - F.col(f"m_{i}")
        for j in range(i):
            value = value - F.col(f"l_{i}_{j}") * F.col(f"q_y{j}")
        df = df.withColumn(f"q_y{i}", value / F.col(f"l_{i}_{i}"))
    ys = [f"q_y{i}" for i in range(N_STATS)]
    return df.withColumn("distance", sum((F.col(y) * F.col(y) for y in ys), F.lit(0.0))).drop(*ys)


def start(rows: DataFrame) -> DataFrame:
    """Medians and median deviations per key, as a diagonal scatter. The statistics are whole numbers
    of a bounded range, so an exact median holds a bounded number of counts."""
    middle = materialize(rows.groupBy("q_key").agg(*[F.median(x).alias(f"c{i}") for i, x in enumerate(_STATS)]))
    away = rows.join(middle, "q_key").groupBy("q_key").agg(*[F.median(F.abs(F.col(x) - F.col(f"c{i}"))).alias(f"d{i}") for i, x in enumerate(_STATS)])
    both = middle.join(away, "q_key")
    scatter = [
        (F.pow(1.4826 * F.col(f"d{i}") / UNIT, F.lit(2)) + FLOOR**2 if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in _CROSS
    ]
    return cholesky(both.select("q_key", *[(F.col(f"c{i}") / UNIT).alias(f"m_{i}") for i in range(N_STATS)], *scatter))


def concentrate(rows: DataFrame, params: DataFrame) -> DataFrame:
    """One C-step: mean and scatter of the ``CORE`` share of each key's rows that lies nearest.

    Rows are summed per key and fine range of distance (map-side first); ranges are taken from the
    nearest on until they hold the share. So no key's rows are gathered or sorted.
    """
    near = distance(rows.join(params, "q_key")).withColumn("ring", F.floor(FINE * F.log2(F.col("distance") + 1)))
    sums = [F.sum(x).alias(x) for x in _STATS]
    sums += [F.sum(F.col(_STATS[i]) * F.col(_STATS[j])).alias(f"c_{i}_{j}") for i, j in _CROSS]
    # written, so that rows are dealt by key and range here and only ranges by key below
    rings = materialize(near.groupBy("q_key", "ring").agg(F.count("*").alias("n"), *sums))
    order = Window.partitionBy("q_key").orderBy("ring")
    rings = rings.withColumn("before", F.sum("n").over(order) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("q_key")))
    core = rings.where(F.col("before") < CORE * F.col("all")).groupBy("q_key")
    core = core.agg(*[F.sum(c).alias(c) for c in ["n", *_STATS, *[f"c_{i}_{j}" for i, j in _CROSS]]])
    steady = CORE / chi2_cdf(chi2_quantile(CORE, N_STATS), N_STATS + 2)
    mean = [(F.col(x) / F.col("n") / UNIT).alias(f"m_{i}") for i, x in enumerate(_STATS)]
    scatter = []
    for i, j in _CROSS:
        value = steady * (F.col(f"c_{i}_{j}") / F.col("n") - F.col(_STATS[i]) / F.col("n") * F.col(_STATS[j]) / F.col("n")) / UNIT**2
        scatter.append((value + (FLOOR**2 if i == j else 0.0)).alias(f"s_{i}_{j}"))
    return cholesky(core.select("q_key", *mean, *scatter))


def estimates(stats: DataFrame) -> DataFrame:
    """Location and scatter per q_group: C-steps from the medians until no determinant falls further.

    Only one row per group and one number per step reach the driver or a broadcast that Spark chooses by size.
    """
    names = materialize(group_names(stats))
    rows = stats.select("q_group", *_STATS).join(names, "q_group").drop("q_group")
    params = materialize(start(rows))
    for _ in range(STEPS):
        new = materialize(concentrate(rows, params))
        old = params.select("q_key", F.col("log_det").alias("old"))
        moved = new.join(old, "q_key").agg(F.max(F.abs(F.col("log_det") - F.col("old")))).first()[0]
        params = new
        if moved is None or moved < 1e-3:
            break
    count = rows.groupBy("q_key").agg(F.count("*").alias("q_n"))
    return materialize(names.join(params.join(count, "q_key"), "q_key").drop("q_key"))


def judged(stats: DataFrame, params: DataFrame) -> DataFrame:
    """Adds ``distance`` and ``kept``."""
    near = distance(stats.join(params, "q_group"))
    fine = (F.col("distance") <= chi2_quantile(1 - TAIL, N_STATS)) | (F.col("q_n") < LEAST_ROWS)
    return near.withColumn("kept", ~F.col("base_failed") & fine)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, distance and kept, per row of ``docs`` (doc_id, text, lang, source).

    Per language and source, the minimum-covariance-determinant estimate of transformed statistics
    is found by concentration steps over all rows; a row is kept if it does not fail the base
    rule and its squared Mahalanobis distance is within the chi-square limit of ``TAIL``.

    Null text counts as empty and fails the base rule; null language or source are values of their
    own; small groups share estimates (``group_names``), and a key with fewer than ``LEAST_ROWS``
    rows rejects by the base rule only. Repeated rows are judged alike; an empty table gives no row.
    A text is one row whatever its length; constant statistics have the deviation ``FLOOR``.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    small = docs.select(F.col("doc_id").cast("bigint"), "text", "lang", "source")
    stats = statistics(small)
    stats = materialize(stats.select(F.col("q_row.doc_id").alias("doc_id"), *names[1:], "q_lang", "q_group", *_STATS))
    return judged(stats, estimates(stats)).select(*names, "kept", "distance")


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns; texts are not shuffled.

    Rows are left out by an explode of none or one, not by a filter: that would move below the
    statistics, which would then be worked out twice a row in one very large piece of code.
    """
    stats = materialize(statistics(docs.select("doc_id", "text", "lang", "source")).select("q_lang", "q_group", *_STATS))
    found = judged(statistics(docs), estimates(stats)).select("q_row", "kept")
    return found.select(F.explode(F.when(F.col("kept"), F.array("q_row"))).alias("q_row")).select("q_row.*")
