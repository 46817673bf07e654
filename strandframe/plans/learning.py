"""Section H: learning matrices and bags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import matrix as H
from .fixtures import add_view
from .registry import query
from .sql import md5_key

LETTERS = "ACGT"
FEATURES = ["count", "0", "1", "2", "3"]


def _letters(how="sum"):
    return ", ".join(f"CAST({how}(length(read) - length(replace(read, '{b}', ''))) AS BIGINT) AS \"{i}\"" for i, b in enumerate(LETTERS))


add_view(
    "mil_matrix",
    f"""SELECT sample_id AS id_fasta, CASE WHEN sample_id <> 'sample_3' THEN grp END AS "group", predict AS genome,
    CAST(count(*) AS BIGINT) AS count, {_letters()} FROM reads GROUP BY sample_id, grp, predict""",
)
# a subject's reads go to every genome, every second or every third one, so that some pairs are missing
add_view(
    "subject_rows",
    f"""SELECT subject_id AS id_subject, grp AS "group", CASE WHEN grp = 'Disease' THEN 1 ELSE 0 END AS label,
    predict - predict % (1 + CAST(substr(subject_id, 9) AS BIGINT) % 3) AS genome,
    CAST(count(*) AS BIGINT) AS count, {_letters()} FROM reads GROUP BY ALL""",
)


def letter_sums():
    return [F.sum(F.length("read") - F.length(F.replace("read", F.lit(b)))).alias(str(i)) for i, b in enumerate(LETTERS)]


def mil_matrix(fx):
    rows = fx.reads.groupBy(F.col("sample_id").alias("id_fasta"), F.col("grp").alias("group"), F.col("predict").alias("genome"))
    out = rows.agg(F.count("*").alias("count"), *letter_sums())
    return out.withColumn("group", F.when(F.col("id_fasta") != "sample_3", F.col("group")))


def metadata(fx):
    return fx.samples.select("id_fasta", F.col("grp").alias("group"), F.col("subject_id").alias("id_subject"))


def subject_rows(fx):
    """Rows per subject and genome of all reads. Subjects tell every genome apart, every second or every third
    one only, so that some pairs are missing."""
    step = 1 + F.substr("subject_id", F.lit(9)).cast("bigint") % 3
    rows = fx.reads.groupBy(
        F.col("subject_id").alias("id_subject"), F.col("grp").alias("group"), (F.col("predict") - F.col("predict") % step).alias("genome")
    )
    out = rows.agg(F.count("*").alias("count"), *letter_sums())
    return out.withColumn("label", F.when(F.col("group") == "Disease", 1).otherwise(0))


def rounded(df, keys, cols=FEATURES, digits=9):
    return df.select(*keys, *[F.round(H.q(c).cast("double"), digits).alias(f"f_{c}") for c in cols])


def cols_sql(expr: str, cols=FEATURES, digits: int = 9) -> str:
    """``expr`` with {c} for each feature column, rounded and renamed."""
    return ", ".join(f"round(CAST({expr.format(c=chr(34) + c + chr(34))} AS DOUBLE), {digits}) AS \"f_{c}\"" for c in cols)


@query(
    "h1_learning_matrix",
    f"""SELECT id_subject, g AS "group", genome, CASE WHEN g = 'Disease' THEN 1 ELSE 0 END AS label, {cols_sql('sum({c})')}
    FROM (SELECT m.*, coalesce(m."group", 'Control') AS g, s.subject_id AS id_subject FROM mil_matrix m JOIN samples s ON m.id_fasta = s.id_fasta)
    GROUP BY id_subject, g, genome""",
)
def _(fx):
    return rounded(H.learning_matrix(mil_matrix(fx), metadata(fx), "Disease"), ["id_subject", "group", "genome", "label"])


@query(
    "h2_rollup_mil",
    f"""SELECT s.subject_id AS id_subject, grp AS "group", genome, {cols_sql('sum({c})')} FROM mil_matrix m
    JOIN samples s ON m.id_fasta = s.id_fasta GROUP BY s.subject_id, grp, genome""",
)
def _(fx):
    x = mil_matrix(fx).drop("group").join(metadata(fx), "id_fasta")
    return rounded(H.rollup_mil(x), ["id_subject", "group", "genome"])


add_view(
    "sample_letters",
    f"SELECT sample_id AS id_fasta, grp AS \"group\", {_letters()} FROM reads GROUP BY sample_id, grp",
)


def sample_letters(fx):
    rows = fx.reads.groupBy(F.col("sample_id").alias("id_fasta"), F.col("grp").alias("group"))
    return rows.agg(*letter_sums())


for _name, _is_bok, _how in (("h3_rollup_bok", True, "sum"), ("h3_rollup_sil", False, "avg")):

    @query(
        _name,
        f"""SELECT subject_id AS id_subject, "group", CASE WHEN "group" = 'Disease' THEN 1 ELSE 0 END AS label,
        {cols_sql(_how + '({c})', FEATURES[1:])} FROM sample_letters l JOIN samples s ON l.id_fasta = s.id_fasta GROUP BY subject_id, "group" """,
    )
    def _(fx, is_bok=_is_bok):
        m = H.learning_matrix(sample_letters(fx), metadata(fx), "Disease", is_bok=is_bok)
        return rounded(m, ["id_subject", "group", "label"], FEATURES[1:])


add_view(
    "complete_rows",
    """SELECT s.id_subject, s.label, g.genome, """
    + ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in FEATURES)
    + """ FROM (SELECT DISTINCT id_subject, label FROM subject_rows) s CROSS JOIN (SELECT DISTINCT genome FROM subject_rows) g
    LEFT JOIN (SELECT id_subject AS sid, genome AS gid, count, "0", "1", "2", "3" FROM subject_rows) r ON sid = id_subject AND gid = g.genome""",
)
KEYS = ["id_subject", "label", "genome"]


def complete_rows(fx):
    return H.complete_genomes(subject_rows(fx))


@query("h4_complete_genomes", f"SELECT id_subject, label, genome, {cols_sql('{c}')} FROM complete_rows")
def _(fx):
    return rounded(complete_rows(fx), KEYS)


@query(
    "h4_complete_genomes_given",
    f"SELECT id_subject, label, genome, {cols_sql('{c}')} FROM complete_rows WHERE genome IN (0, 2, 3, 5, 7)",
)
def _(fx):
    return rounded(H.complete_genomes(subject_rows(fx), [0, 2, 3, 5, 7]), KEYS)


add_view(
    "normal_rows",
    "SELECT id_subject, label, genome, "
    + ", ".join(f'"{c}" / sum(count) OVER (PARTITION BY id_subject) AS "{c}"' for c in FEATURES)
    + " FROM complete_rows",
)


def normal_rows(fx):
    return H.normalize_by_subject_count(complete_rows(fx))


@query("h5_normalize_by_subject_count", f"SELECT id_subject, label, genome, {cols_sql('{c}')} FROM normal_rows")
def _(fx):
    return rounded(normal_rows(fx), KEYS)


@query(
    "h6_genome_dummies",
    f"""SELECT id_subject, label, genome, round(count / sum(count) OVER (PARTITION BY id_subject), 9) AS f_count,
    {cols_sql('{c} / count', FEATURES[1:])}, dense_rank() OVER (ORDER BY genome) - 1 AS dummy,
    (SELECT count(DISTINCT genome) FROM subject_rows) AS dummies FROM subject_rows""",
)
def _(fx):
    return rounded(H.genome_dummies(subject_rows(fx)), [*KEYS, "dummy", "dummies"])


SPLIT = f"""SELECT split, id_subject, "group", CASE WHEN rn <= CAST(round(CAST(0.4 AS DOUBLE) * n) AS BIGINT) THEN 'valid' ELSE 'train' END AS part FROM (
  SELECT *, count(*) OVER (PARTITION BY split, "group") AS n,
    row_number() OVER (PARTITION BY split, "group" ORDER BY {md5_key(42, 'id_subject', 'split')}, id_subject) AS rn
  FROM (SELECT *, unnest([0, 1, 2]) AS split FROM (SELECT DISTINCT id_subject, "group" FROM subject_rows)))"""
add_view("splits", SPLIT)


def splits(fx):
    return H.grouped_stratified_split(subject_rows(fx), 3, 0.4)


@query("h7_grouped_stratified_split", 'SELECT split, id_subject, "group", part FROM splits')
def _(fx):
    return splits(fx)


@query(
    "h8_standardize",
    f"""WITH r AS (SELECT n.*, split, part FROM normal_rows n JOIN splits s ON n.id_subject = s.id_subject),
    t AS (SELECT split AS sp, {', '.join(f'avg("{c}") AS "m{c}", stddev_pop("{c}") AS "s{c}"' for c in FEATURES)} FROM r WHERE part = 'train' GROUP BY split)
    SELECT split, part, id_subject, label, genome, {', '.join(f'round(("{c}" - "m{c}") / CASE WHEN "s{c}" = 0 THEN 1 ELSE "s{c}" END, 7) AS "f_{c}"' for c in FEATURES)}
    FROM r JOIN t ON split = sp""",
)
def _(fx):
    x = normal_rows(fx).join(splits(fx).drop("group"), "id_subject")
    return rounded(H.standardize(x, FEATURES), ["split", "part", *KEYS], digits=7)


TOTAL = ' + '.join(f'"{c}"' for c in FEATURES)


def _total(rows):
    inner = lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.transform(rows, inner), F.lit(0.0), lambda a, x: a + x)


@query(
    "h9_bags",
    f"""SELECT id_subject, label, CAST(count(*) AS BIGINT) AS n, array_to_string(list(genome ORDER BY genome), ',') AS genomes,
    round(CAST(sum({TOTAL}) AS DOUBLE), 6) AS total FROM subject_rows GROUP BY id_subject, label""",
)
def _(fx):
    b = H.bags(subject_rows(fx))
    text = F.array_join(F.col("genomes").cast("array<string>"), ",")
    return b.select("id_subject", "label", F.size("features").cast("bigint").alias("n"), text.alias("genomes"), F.round(_total("features"), 6).alias("total"))


@query(
    "h9_bags_padded",
    f"""SELECT id_subject, label, max(count(*)) OVER () AS n, CAST(max(count(*)) OVER () - count(*) AS BIGINT) AS padding,
    round(CAST(sum({TOTAL}) AS DOUBLE), 6) AS total FROM subject_rows GROUP BY id_subject, label""",
)
def _(fx):
    b = H.bags(subject_rows(fx), pad=True)
    padding = F.size(F.filter("genomes", lambda g: g == -1)).cast("bigint")
    return b.select("id_subject", "label", F.size("features").cast("bigint").alias("n"), padding.alias("padding"), F.round(_total("features"), 6).alias("total"))


add_view(
    "partners",
    f"""SELECT id_subject, partner, CAST("group" = pg AS INT) AS same FROM (SELECT id_subject, "group",
      coalesce(lead(id_subject) OVER w, first_value(id_subject) OVER w) AS partner, coalesce(lead("group") OVER w, first_value("group") OVER w) AS pg
      FROM (SELECT DISTINCT id_subject, "group" FROM subject_rows)
      WINDOW w AS (ORDER BY {md5_key(42, 'id_subject')}, id_subject))""",
)


@query("h10_siamese_pairs", "SELECT id_subject, partner, same FROM partners")
def _(fx):
    return H.siamese_pairs(subject_rows(fx))


@query(
    "h11_bag_pooling",
    " UNION ALL ".join(
        f"SELECT '{n}' AS how, id_subject, {cols_sql(f + '({c})')} FROM normal_rows GROUP BY id_subject"
        for n, f in (("sum", "sum"), ("max", "max"), ("mean", "avg"))
    ),
)
def _(fx):
    x = normal_rows(fx)
    parts = [rounded(H.bag_pooling(x, how), [F.lit(how).alias("how"), "id_subject"]) for how in ("sum", "max", "mean")]
    return reduce(lambda a, b: a.unionByName(b), parts)


add_view("weights", "SELECT CAST(r_regionkey AS VARCHAR) AS feature, r_regionkey * CAST(0.5 AS DOUBLE) - CAST(0.7 AS DOUBLE) AS weight FROM region")
add_view(
    "attended",
    """SELECT *, e / sum(e) OVER (PARTITION BY id_subject) AS attention FROM (
      SELECT *, exp(s - max(s) OVER (PARTITION BY id_subject)) AS e FROM (
        SELECT *, (SELECT weight FROM weights WHERE feature = '0') * "0" + (SELECT weight FROM weights WHERE feature = '1') * "1"
          + (SELECT weight FROM weights WHERE feature = '2') * "2" + (SELECT weight FROM weights WHERE feature = '3') * "3" AS s FROM normal_rows))""",
)


def weights(fx):
    return fx.table("region").selectExpr("CAST(r_regionkey AS STRING) AS feature", "r_regionkey * 0.5D - 0.7D AS weight")


@query(
    "h12_attention_pooling",
    f"SELECT id_subject, {cols_sql('sum({c} * attention)')} FROM attended GROUP BY id_subject",
)
def _(fx):
    return rounded(H.attention_pooling(normal_rows(fx), weights(fx)), ["id_subject"])


@query(
    "h13_attention_top5",
    """SELECT id_subject, """
    + ", ".join(
        f"coalesce(max(genome) FILTER (rn = {i}), -1) AS tax_{i}, round(coalesce(max(attention) FILTER (rn = {i}), -1), 9) AS attention_{i}"
        for i in range(1, 6)
    )
    + """ FROM (SELECT *, row_number() OVER (PARTITION BY id_subject ORDER BY round(attention, 12) DESC, genome) AS rn FROM attended) GROUP BY id_subject""",
)
def _(fx):
    a = H.attention(normal_rows(fx), weights(fx)).withColumn("attention", F.round("attention", 12))
    top = H.attention_top(a)
    return top.select("id_subject", *[c for i in range(1, 6) for c in (f"tax_{i}", F.round(f"attention_{i}", 9).alias(f"attention_{i}"))])


def subject_embeddings(fx):
    pooled = H.bag_pooling(normal_rows(fx), "mean")
    return pooled.select("id_subject", F.array(*[H.q(c) for c in FEATURES[1:]]).alias("embedding"))


@query(
    "h14_abundance_features",
    """WITH a AS (SELECT id_subject, label, list(CAST(count AS DOUBLE) ORDER BY genome) AS ab FROM complete_rows GROUP BY id_subject, label),
    e AS (SELECT id_subject, [avg("0"), avg("1"), avg("2"), avg("3")] AS em FROM normal_rows GROUP BY id_subject),
    f AS (SELECT 'no' AS mode, a.id_subject, label, em AS v FROM a JOIN e ON a.id_subject = e.id_subject
      UNION ALL SELECT 'yes', a.id_subject, label, list_concat(ab, em) FROM a JOIN e ON a.id_subject = e.id_subject
      UNION ALL SELECT 'only', id_subject, label, ab FROM a)
    SELECT mode, id_subject, label, CAST(len(v) AS BIGINT) AS n, round(list_sum(v), 6) AS total, round(list_last(v), 6) AS last,
      round(v[3], 6) AS third FROM f""",
)
def _(fx):
    x, e = complete_rows(fx), subject_embeddings(fx)
    parts = []
    for mode in ("no", "yes", "only"):
        f = H.abundance_features(x, e, mode)
        total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
        parts.append(
            f.select(
                F.lit(mode).alias("mode"),
                "id_subject",
                "label",
                F.size("features").cast("bigint").alias("n"),
                F.round(total, 6).alias("total"),
                F.round(F.element_at("features", -1), 6).alias("last"),
                F.round(F.element_at("features", 3), 6).alias("third"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), parts)
