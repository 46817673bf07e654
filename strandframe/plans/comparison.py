"""Section K: similarity, distance, composition, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import compose as C
from ..operators import distance as DI
from ..operators import matrix as H
from ..operators import models as MO
from ..session import materialize
from .embedding import DIMS, genome_vectors
from .fixtures import add_view
from .learning import FEATURES, complete_rows, normal_rows, subject_embeddings, subject_rows, splits
from .registry import query
from .sequences import needle_sql

COS = "list_dot_product(a.vector, b.vector) / (sqrt(list_dot_product(a.vector, a.vector)) * sqrt(list_dot_product(b.vector, b.vector)))"
add_view(
    "kmer_pairs",
    f"""SELECT CAST(a.id AS BIGINT) AS i, CAST(b.id AS BIGINT) AS j, CAST(hamming(a.kmer, b.kmer) AS BIGINT) AS distance, {COS} AS cosine
    FROM kmer_vectors a JOIN kmer_vectors b ON a.id < b.id""",
)


def _vectors(fx):
    return fx.kmer_vectors.select(F.col("id").cast("bigint").alias("id"), "kmer", "vector")


@query("k1_kmer_pair_distance", "SELECT i, j, distance, round(cosine, 9) AS cosine FROM kmer_pairs")
def _(fx):
    p = DI.kmer_pair_distance(_vectors(fx))
    return p.withColumn("cosine", F.round("cosine", 9) + 0.0)


@query(
    "k1_kmer_pair_needleman",
    f"""SELECT k.i, k.j, s.score AS distance, round(k.cosine, 9) AS cosine FROM kmer_pairs k JOIN kmer_vectors x ON x.id = k.i JOIN kmer_vectors y ON y.id = k.j
    JOIN ({needle_sql('SELECT x.kmer AS a, y.kmer AS b FROM kmer_vectors x JOIN kmer_vectors y ON x.id < y.id')}) s ON s.a = x.kmer AND s.b = y.kmer""",
)
def _(fx):
    p = DI.kmer_pair_distance(_vectors(fx), "needleman")
    return p.withColumn("cosine", F.round("cosine", 9) + 0.0)


@query(
    "k2_cosine_similarity",
    f"""SELECT CAST(a.vec_id AS BIGINT) AS id, round({COS.replace('vector', 'v')}, 9) AS cosine FROM
    (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) b
    ON b.vec_id = a.vec_id + 1""",
)
def _(fx):
    e = fx.table("embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("a"))
    nxt = e.select((F.col("id") - 1).alias("id"), F.col("a").alias("b"))
    return e.join(nxt, "id").select("id", (F.round(cosine("a", "b"), 9) + 0.0).alias("cosine"))


DECILES = [i / 10 for i in range(1, 10)]


@query(
    "k3_similarity_by_distance",
    f"""SELECT distance, CAST(count(*) AS BIGINT) AS n, round(avg(c), 6) AS mean, round(min(c), 6) AS min, round(quantile_cont(c, 0.5), 6) AS median,
    round(max(c), 6) AS max, {', '.join(f'round(quantile_cont(c, {p}), 6) AS d{i + 1}' for i, p in enumerate(DECILES))}
    FROM (SELECT distance, round(cosine, 6) AS c FROM kmer_pairs) GROUP BY distance""",
)
def _(fx):
    s = DI.similarity_by_distance(DI.pair_histogram(_vectors(fx)))
    r = lambda c, name: (F.round(c, 6) + 0.0).alias(name)
    return s.select(
        "distance", "n", *[r(c, c) for c in ("mean", "min", "median", "max")], *[r(F.get("deciles", F.lit(i)), f"d{i + 1}") for i in range(9)]
    )


@query(
    "k3_quadratic_fit",
    """WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS x1, sum(x * x) AS x2, sum(x * x * x) AS x3, sum(x * x * x * x) AS x4,
      sum(y) AS y0, sum(x * y) AS y1, sum(x * x * y) AS y2 FROM (SELECT CAST(distance AS DOUBLE) AS x, cosine AS y FROM kmer_pairs)),
    d AS (SELECT *, n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x3 * x2) + x2 * (x1 * x3 - x2 * x2) AS det FROM s)
    SELECT round((y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - x3 * y2) + x2 * (y1 * x3 - x2 * y2)) / det, 6) AS c0,
      round((n * (y1 * x4 - x3 * y2) - y0 * (x1 * x4 - x3 * x2) + x2 * (x1 * y2 - y1 * x2)) / det, 6) AS c1,
      round((n * (x2 * y2 - y1 * x3) - x1 * (x1 * y2 - y1 * x2) + y0 * (x1 * x3 - x2 * x2)) / det, 6) AS c2 FROM d""",
)
def _(fx):
    fit = DI.quadratic_fit(DI.pair_histogram(_vectors(fx)))
    return fit.select(*[(F.round(c, 6) + 0.0).alias(c) for c in ("c0", "c1", "c2")])


GV = "list_value(" + ", ".join(f"e{i}" for i in DIMS) + ")"
add_view(
    "genome_pairs",
    f"""SELECT a.id AS i, b.id AS j, round(1 - {COS}, 9) AS distance FROM
      (SELECT tax_id AS id, {GV} AS vector FROM genome_vectors v JOIN genome g ON v.genome_id = g.genome_id) a JOIN
      (SELECT tax_id AS id, {GV} AS vector FROM genome_vectors v JOIN genome g ON v.genome_id = g.genome_id) b ON a.id < b.id""",
)


def genome_pairs(fx):
    g = genome_vectors(fx).select(F.col("tax_id").alias("id"), F.col("embedding").alias("vector"))
    return DI.genome_distance(g).withColumn("distance", F.round("distance", 9) + 0.0)


@query("k4_genome_distance", "SELECT i, j, distance FROM genome_pairs")
def _(fx):
    return genome_pairs(fx)


RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
add_view("given_pairs", "SELECT i, j, CAST((j - i) % 7 + (i * j) % 5 AS DOUBLE) AS distance FROM genome_pairs")


@query(
    "k5_mantel",
    f"""WITH r AS (SELECT x.i, x.j, {RANK.format(c='x.distance')} AS rx, {RANK.format(c='y.distance')} AS ry
      FROM genome_pairs x JOIN given_pairs y ON x.i = y.i AND x.j = y.j),
    ids AS (SELECT DISTINCT unnest([i, j]) AS id FROM r),
    ord AS (SELECT id, row_number() OVER (ORDER BY id) AS place FROM ids),
    perms AS (SELECT perm, id, row_number() OVER (PARTITION BY perm ORDER BY md5(concat_ws('-', id, perm, 42)), id) AS place
      FROM ids, (SELECT unnest(range(1, 1000)) AS perm)),
    m AS (SELECT perm, p.id, o.id AS dest FROM perms p JOIN ord o ON p.place = o.place),
    c AS (SELECT a.perm, corr(r.rx, q.ry) AS rho FROM r JOIN m a ON a.id = r.i JOIN m b ON b.perm = a.perm AND b.id = r.j
      JOIN r q ON q.i = least(a.dest, b.dest) AND q.j = greatest(a.dest, b.dest) GROUP BY a.perm),
    obs AS (SELECT count(*) AS n, corr(rx, ry) AS rho FROM r)
    SELECT CAST(n AS BIGINT) AS n, round(rho, 9) AS rho,
      round((1 + (SELECT count(*) FROM c, obs WHERE abs(round(c.rho, 9)) >= abs(round(obs.rho, 9)))) / 1000, 9) AS p_value FROM obs""",
)
def _(fx):
    x = materialize(genome_pairs(fx))
    y = x.select("i", "j", ((F.col("j") - F.col("i")) % 7 + (F.col("i") * F.col("j")) % 5).cast("double").alias("distance"))
    m = DI.mantel(x, y, 999)
    return m.select("n", F.round("rho", 9).alias("rho"), F.round("p_value", 9).alias("p_value"))


@query("k6_project_2d")
def _(fx):
    return MO.project_2d(genome_vectors(fx))


add_view(
    "composition",
    """SELECT s.sample_id, g.tax_id AS part, CAST(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT sample_id FROM reads) s CROSS JOIN genome g
    LEFT JOIN (SELECT sample_id, predict, count(*) AS n FROM (SELECT sample_id,
      predict - predict % (1 + CAST(substr(sample_id, 8) AS BIGINT) % 3) AS predict FROM reads) GROUP BY ALL) c ON c.sample_id = s.sample_id AND predict = g.tax_id""",
)
add_view(
    "replaced",
    """SELECT sample_id, part, CASE WHEN x = 0 THEN d ELSE x * (1 - d * z) END AS value FROM (
      SELECT sample_id, part, value / sum(value) OVER w AS x, 1 / pow(count(*) OVER w, 2) AS d, sum(CAST(value = 0 AS INT)) OVER w AS z
      FROM composition WINDOW w AS (PARTITION BY sample_id))""",
)


def composition(fx):
    """Dense counts of all reads per sample and genome. Samples tell every genome apart, every second or every
    third one only, so that some counts are zero."""
    step = 1 + F.substr("sample_id", F.lit(8)).cast("bigint") % 3
    counts = fx.reads.groupBy("sample_id", (F.col("predict") - F.col("predict") % step).alias("part")).agg(F.count("*").alias("n"))
    axis = fx.genome.agg(F.array_sort(F.collect_set("tax_id"))).scalar()
    grid = fx.reads.select("sample_id").distinct().select("sample_id", F.explode(axis).alias("part"))
    dense = grid.join(counts, ["sample_id", "part"], "left")
    return dense.select("sample_id", "part", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def replaced(fx):
    return C.multiplicative_replacement(composition(fx), "sample_id")


def _nine(df):
    return df.select("sample_id", "part", (F.round("value", 9) + 0.0).alias("value"))


@query("k7_multiplicative_replacement", "SELECT sample_id, part, round(value, 9) AS value FROM replaced")
def _(fx):
    return _nine(replaced(fx))


@query(
    "k7_multiplicative_replacement_column",
    """SELECT sample_id, part, round(CASE WHEN x = 0 THEN d ELSE x * (1 - d * z) END, 9) AS value FROM (
      SELECT sample_id, part, v / sum(v) OVER w AS x, 1 / pow(count(*) OVER w, 2) AS d, sum(CAST(v = 0 AS INT)) OVER w AS z FROM (
        SELECT sample_id, part, value / sum(value) OVER (PARTITION BY part) AS v FROM composition) WINDOW w AS (PARTITION BY sample_id))""",
)
def _(fx):
    return _nine(C.multiplicative_replacement(composition(fx), "sample_id", closure="column"))


@query(
    "k8_clr",
    "SELECT sample_id, part, round(ln(value) - avg(ln(value)) OVER (PARTITION BY sample_id), 9) AS value FROM replaced",
)
def _(fx):
    return _nine(C.clr(replaced(fx), "sample_id"))


@query(
    "k8_alr",
    """SELECT sample_id, part, round(ln(value) - ln(first), 9) AS value FROM (SELECT *, arg_min(value, part) OVER (PARTITION BY sample_id) AS first,
      min(part) OVER (PARTITION BY sample_id) AS p0 FROM replaced) WHERE part <> p0""",
)
def _(fx):
    return _nine(C.alr(replaced(fx), "sample_id"))


@query(
    "k8_ilr",
    """SELECT sample_id, CAST(j AS BIGINT) AS part, round(sqrt(j / (j + 1)) * (m - nxt), 9) AS value FROM (
      SELECT sample_id, row_number() OVER w AS j, avg(ln(value)) OVER (PARTITION BY sample_id ORDER BY part ROWS UNBOUNDED PRECEDING) AS m,
        lead(ln(value)) OVER w AS nxt FROM replaced WINDOW w AS (PARTITION BY sample_id ORDER BY part)) WHERE nxt IS NOT NULL""",
)
def _(fx):
    return _nine(C.ilr(replaced(fx), "sample_id"))


#: Draws of the random search in the registered queries, each over the three inner splits; a fit is some hundred small jobs.
SEARCHED = 3


@query("k9_benchmark_classifiers")
def _(fx):
    return MO.benchmark_classifiers(normal_rows(fx), splits(fx), FEATURES, n_iter=SEARCHED)


@query("k10_benchmark_on_embedding")
def _(fx):
    x = H.abundance_features(complete_rows(fx), subject_embeddings(fx), "yes")
    return MO.benchmark_on_embedding(x, splits(fx).select("split", "id_subject", "part"), n_iter=SEARCHED)


@query(
    "k11_contrastive_loss",
    """WITH e AS (SELECT id_subject, [avg("0"), avg("1"), avg("2"), avg("3")] AS v FROM normal_rows GROUP BY id_subject),
    d AS (SELECT same, list_distance(a.v, b.v) * 10 AS d FROM partners p JOIN e a ON a.id_subject = p.id_subject JOIN e b ON b.id_subject = partner)
    SELECT round(sum(CASE WHEN same = 1 THEN d * d ELSE pow(greatest(0, 1 - d), 2) END) / 2 / count(*), 9) AS loss FROM d""",
)
def _(fx):
    e = subject_embeddings(fx).select("id_subject", F.transform("embedding", lambda x: x * 10).alias("v"))
    pairs = H.siamese_pairs(subject_rows(fx)).join(e.withColumnRenamed("v", "a"), "id_subject")
    other = e.select(F.col("id_subject").alias("partner"), F.col("v").alias("b"))
    return MO.contrastive_loss(pairs.join(other, "partner")).select(F.round("loss", 9).alias("loss"))


@query("k12_reconstruction_error")
def _(fx):
    return MO.reconstruction_error(genome_vectors(fx), ["genome_id"], k=4)
