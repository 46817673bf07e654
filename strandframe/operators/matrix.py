"""Learning matrices and bags (inventory H1-H14).

A matrix has an id, ``group``, maybe ``genome`` and ``count``, and features in
columns named 0..d-1. Its rows are per sample or per sample and genome, so a
subject's group holds at most the genomes of the collection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seq import seeded_order
from .filters import binary_label, drop_incomplete, feature_columns
from .ranking import mark_first, md5_bucket, number_rows, row_number_by

SUBJECT = "id_subject"


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def features_of(df: DataFrame) -> list[str]:
    return [c for c in ["count", *feature_columns(df)] if c in df.columns]


def learning_matrix(
    matrix: DataFrame,
    metadata: DataFrame,
    disease: str,
    is_bok: bool = False,
    nan_to_control: bool = True,
    group: str = "group",
) -> DataFrame:
    """H1. Matrix joined to its metadata, cleaned (B6), rolled up to subjects (H2, H3) and labelled (B7).

    ``metadata`` holds id_fasta, group, id_subject; the matrix' own group wins.
    """
    x = matrix.drop("pair")
    meta = metadata.select("id_fasta", group, SUBJECT)
    if group in x.columns:
        meta = meta.drop(group)
    x = drop_incomplete(x.join(meta, "id_fasta"), group, null_to_control=nan_to_control).drop("id_fasta")
    if "count" in x.columns:
        rolled = rollup_mil(x, group)
    else:
        rolled = rollup_bok(x, group) if is_bok else rollup_sil(x, group)
    return rolled.withColumn("label", binary_label(disease, group))


def _rollup(x: DataFrame, by: list[str], how) -> DataFrame:
    values = [c for c in x.columns if c not in by and c != "id_fasta"]
    return x.groupBy(*by).agg(*[how(q(c)).alias(c) for c in values])


def rollup_mil(x: DataFrame, group: str = "group") -> DataFrame:
    """H2. Sums by subject, group and genome."""
    return _rollup(x, [SUBJECT, group, "genome"], F.sum)


def rollup_bok(x: DataFrame, group: str = "group") -> DataFrame:
    """H3. Sums by subject and group."""
    return _rollup(x, [SUBJECT, group], F.sum)


def rollup_sil(x: DataFrame, group: str = "group") -> DataFrame:
    """H3. Means by subject and group."""
    return _rollup(x, [SUBJECT, group], F.avg)


def complete_genomes(x: DataFrame, genomes: Sequence[int] | None = None, label: str = "label") -> DataFrame:
    """H4. One row per subject and genome of the set; missing rows are zero.

    The set is every genome seen, or the given list, which also filters. It is
    one small array; the result has subjects x genomes rows by definition.
    """
    values = features_of(x)
    if genomes is None:
        axis = x.agg(F.array_sort(F.collect_set("genome"))).scalar()
    else:
        axis = F.array(*[F.lit(g).cast("bigint") for g in sorted(genomes)])
        x = x.filter(F.col("genome").isin(list(genomes)))
    subjects = x.select(SUBJECT, label).distinct()
    grid = subjects.select(SUBJECT, label, F.explode(axis).alias("genome"))
    rows = x.select(SUBJECT, label, "genome", *map(q, values))
    return grid.join(rows, [SUBJECT, label, "genome"], "left").fillna(0, values)


def normalize_by_subject_count(x: DataFrame) -> DataFrame:
    """H5. Features and count divided by the subject's total count."""
    total = F.sum("count").over(Window.partitionBy(SUBJECT))
    return x.withColumns({c: q(c) / total for c in features_of(x)})


def genome_dummies(x: DataFrame) -> DataFrame:
    """H6. One-hot genome columns in sparse form: ``dummy`` is the place of the row's one among ``dummies``
    columns, in the order of the genomes; any number of genomes fits. Features are divided by the row's
    count, the count by the subject's total.
    """
    total = F.sum("count").over(Window.partitionBy(SUBJECT))
    cols = {c: q(c) / F.col("count") for c in feature_columns(x)}
    cols["count"] = F.col("count") / total
    genomes = x.select("genome").distinct()
    places = number_rows(genomes, [], [F.col("genome")], "dummy")
    places = places.select("genome", (F.col("dummy") - 1).alias("dummy"), genomes.agg(F.count("*")).scalar().alias("dummies"))
    return x.withColumns(cols).join(places, "genome")


def grouped_stratified_split(
    subjects: DataFrame, n_splits: int = 1, test_size: float = 0.2, group: str = "group", seed: int = 42
) -> DataFrame:
    """H7. (split, id_subject, group, part): round(test_size * n) subjects of each group are valid.

    Rows follow their subject by a join on it.
    """
    people = subjects.select(SUBJECT, group).distinct()
    sizes = people.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    rows = people.join(sizes, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")
    rows = rows.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    rows = rows.withColumn("__k", seeded_order(seed, SUBJECT, "split"))
    want = F.round(F.lit(test_size) * F.col("__n")).cast("bigint")
    marked = mark_first(rows, ["split", group], md5_bucket("__k"), [F.col("__k"), F.col(SUBJECT)], want, "__v")
    return marked.select("split", SUBJECT, group, F.when(F.col("__v"), "valid").otherwise("train").alias("part"))


def standardize(x: DataFrame, features: Sequence[str], by: Sequence[str] = ("split",), part: str = "part") -> DataFrame:
    """H8. (x - mean) / std with mean and population std of the train rows; a std of 0 counts as 1."""
    train = x.filter(F.col(part) == "train")
    stats = train.groupBy(*by).agg(
        *[F.avg(q(c)).alias(f"__m_{c}") for c in features], *[F.stddev_pop(q(c)).alias(f"__s_{c}") for c in features]
    )
    std = lambda c: F.when(q(f"__s_{c}") == 0, F.lit(1.0)).otherwise(q(f"__s_{c}"))
    scaled = {c: (q(c) - q(f"__m_{c}")) / std(c) for c in features}
    return x.join(stats, list(by)).withColumns(scaled).drop(*[f"__{k}_{c}" for c in features for k in "ms"])


def bags(x: DataFrame, label: str = "label", pad: bool = False) -> DataFrame:
    """H9. Per subject its rows as arrays ordered by genome: features (count first) and genomes.

    With ``pad`` all bags get the length of the longest, filled with zeros and genome -1.
    """
    values = features_of(x)
    row = F.struct(F.col("genome").alias("genome"), F.array(*[q(c).cast("double") for c in values]).alias("x"))
    out = x.groupBy(SUBJECT, label).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    out = out.select(SUBJECT, label, F.col("rows.x").alias("features"), F.col("rows.genome").alias("genomes"))
    if pad:
        missing = out.agg(F.max(F.size("genomes"))).scalar() - F.size("genomes")
        zeros = F.array_repeat(F.lit(0.0), len(values))
        out = out.withColumns(
            {
                "features": F.concat("features", F.array_repeat(zeros, missing)),
                "genomes": F.concat("genomes", F.array_repeat(F.lit(-1).cast("bigint"), missing)),
            }
        )
    return out


def siamese_pairs(subjects: DataFrame, group: str = "group", seed: int = 42) -> DataFrame:
    """H10. (id_subject, partner, same): the next subject in seeded order, the last meets the first."""
    people = subjects.select(SUBJECT, group).distinct().withColumn("__k", seeded_order(seed, SUBJECT))
    ranked = row_number_by(people, [], [md5_bucket("__k")], [F.col("__k"), F.col(SUBJECT)], "__r").drop("__k")
    n = people.agg(F.count("*")).scalar()
    left = ranked.withColumn("__next", F.col("__r") % n + 1)
    right = ranked.select(F.col(SUBJECT).alias("partner"), F.col(group).alias("__g"), F.col("__r").alias("__at"))
    pairs = left.join(right, F.col("__next") == F.col("__at")).filter(F.col(SUBJECT) != F.col("partner"))
    return pairs.select(SUBJECT, "partner", (F.col(group) == F.col("__g")).cast("int").alias("same"))


def bag_pooling(x: DataFrame, how: str = "sum", by: Sequence[str] = (SUBJECT,)) -> DataFrame:
    """H11. Sum, maximum or mean of a subject's rows."""
    fn = {"sum": F.sum, "max": F.max, "mean": F.avg}[how]
    return x.groupBy(*by).agg(*[fn(q(c)).alias(c) for c in features_of(x)])


def attention(x: DataFrame, weights: DataFrame) -> DataFrame:
    """H12. Adds ``attention``: softmax within a subject of the linear score of the features.

    ``weights`` holds (feature, weight); features without weight count 0.
    """
    table = weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight")))).scalar()
    score = F.lit(0.0)
    for c in features_of(x):
        score = score + q(c) * F.coalesce(F.try_element_at(table, F.lit(c)), F.lit(0.0))
    w = Window.partitionBy(SUBJECT)
    scored = x.withColumn("__s", score).withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(w)))
    return scored.withColumn("attention", F.col("__e") / F.sum("__e").over(w)).drop("__s", "__e")


def attention_pooling(x: DataFrame, weights: DataFrame) -> DataFrame:
    """H12. Attention-weighted sum of a subject's rows."""
    weighted = attention(x, weights)
    return weighted.groupBy(SUBJECT).agg(*[F.sum(q(c) * F.col("attention")).alias(c) for c in features_of(x)])


def attention_top(weighted: DataFrame, n: int = 5) -> DataFrame:
    """H13. Per subject the n genomes of highest attention: tax_1, attention_1, ...; -1 where there are fewer."""
    w = Window.partitionBy(SUBJECT).orderBy(F.desc("attention"), "genome")
    top = weighted.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    cols = []
    for i in range(1, n + 1):
        at = F.col("__r") == i
        cols.append(F.coalesce(F.max(F.when(at, F.col("genome"))), F.lit(-1)).alias(f"tax_{i}"))
        cols.append(F.coalesce(F.max(F.when(at, F.col("attention"))), F.lit(-1.0)).alias(f"attention_{i}"))
    return top.groupBy(SUBJECT).agg(*cols)


def abundance_features(x: DataFrame, embeddings: DataFrame, mode: str = "no", label: str = "label") -> DataFrame:
    """H14. (id_subject, label, features): embeddings, abundance then embeddings, or abundance only.

    ``x`` is completed (H4), so the counts by genome line up; ``embeddings`` has (id_subject, embedding).
    """
    if mode not in ("no", "yes", "only"):
        raise ValueError(mode)
    counts = x.groupBy(SUBJECT, label).agg(F.array_sort(F.collect_list(F.struct("genome", F.col("count").cast("double").alias("c")))).alias("b"))
    counts = counts.select(SUBJECT, label, F.col("b.c").alias("abundance"))
    if mode == "only":
        return counts.withColumnRenamed("abundance", "features")
    both = counts.join(embeddings.select(SUBJECT, "embedding"), SUBJECT)
    value = F.col("embedding") if mode == "no" else F.concat("abundance", "embedding")
    return both.select(SUBJECT, label, value.alias("features"))
