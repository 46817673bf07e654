"""Abundance profiles of a genome collection (inventory I10-I15, A17)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import seeded_order
from .ranking import md5_bucket, row_number_by

BALANCED = "abundance_balanced"
UP, DOWN = 5.0, 0.2
GRID = [0, 5, 10, 20]


def _share(df: DataFrame, name: str, weight: Column) -> DataFrame:
    """Adds ``name`` = weight divided by its sum over the frame."""
    total = df.agg(F.sum(weight)).scalar()
    return df.withColumn(name, weight / total)


def _with_sum(df: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    sums = df.groupBy(F.col(by).alias("__g")).agg(F.sum(value).alias(name))
    return df.join(sums, F.col(by).eqNullSafe(F.col("__g"))).drop("__g")


def abundance_balanced(meta: DataFrame, bp: str = "bp_length") -> DataFrame:
    """I10. 1/bp_length, normalized to one."""
    return _share(meta, BALANCED, 1 / F.col(bp))


def abundance_balanced_rank(meta: DataFrame, rank: str, bp: str = "bp_length") -> DataFrame:
    """I11. Taxa weighted by normalized 1/sum(bp); genomes inside a taxon by normalized 1/bp."""
    weights = meta.groupBy(F.col(rank).alias("__g")).agg(
        (1 / F.sum(bp)).alias("__w"), F.sum(1 / F.col(bp)).alias("__inside")
    )
    weights = _share(weights, "__w", F.col("__w"))
    rows = meta.join(weights, F.col(rank).eqNullSafe(F.col("__g")))
    value = 1 / F.col(bp) / F.col("__inside") * F.col("__w")
    return rows.withColumn(f"{BALANCED}_{rank}", value).drop("__g", "__w", "__inside")


def abundance_balanced_rank_v2(meta: DataFrame, rank: str, bp: str = "bp_length") -> DataFrame:
    """I12. 1/(taxon share * share inside the taxon), normalized inside the taxon, then overall."""
    cols = meta.columns
    total = meta.agg(F.sum(bp)).scalar()
    rows = _with_sum(meta, rank, F.col(bp), "__sum").withColumn("__norm", F.col("__sum") / total)
    rows = rows.withColumn("__x", 1 / (F.col("__norm") * (F.col(bp) / F.col("__sum"))))
    rows = _with_sum(rows, rank, F.col("__x"), "__taxon").withColumn("__y", F.col("__x") / F.col("__taxon"))
    name = f"{BALANCED}_{rank}_V2"
    return _share(rows, name, F.col("__y")).select(*cols, name)


def abundance_uniform(meta: DataFrame) -> DataFrame:
    """I13. 1 / number of genomes."""
    return meta.withColumn(f"{BALANCED}_uniform", 1 / meta.agg(F.count("*")).scalar())


def abundance_modify(meta: DataFrame, spec: Mapping | str) -> DataFrame:
    """I14. One column ``<name>_<rank>`` per entry of the spec.

    ``spec`` (mapping or JSON) is {name: {tax_level: rank, modif: {taxon: factor}}}.
    The taxa named are multiplied by their factor, then the column is normalized.
    Needs the matching ``abundance_balanced_<rank>`` column.
    """
    spec = json.loads(spec) if isinstance(spec, str) else spec
    for name, entry in spec.items():
        rank, factors = entry["tax_level"], entry["modif"]
        value = F.col(f"{BALANCED}_{rank}")
        if factors:
            lookup = F.create_map(*[F.lit(x) for t, f in factors.items() for x in (str(t), float(f))])
            value = value * F.coalesce(F.try_element_at(lookup, F.col(rank).cast("string")), F.lit(1.0))
        meta = _share(meta, f"{name}_{rank}", value)
    return meta


def all_profiles(meta: DataFrame, spec: Mapping | str | None = None) -> DataFrame:
    """I10-I14 on one metadata table."""
    meta = abundance_balanced(meta)
    for rank in ("species", "genus"):
        meta = abundance_balanced_rank(meta, rank)
    for rank in ("species", "genus"):
        meta = abundance_balanced_rank_v2(meta, rank)
    meta = abundance_uniform(meta)
    return abundance_modify(meta, spec) if spec else meta


def perturb_plan(taxa: DataFrame, taxon: str = "species", grid: Sequence[int] = GRID, seed: int = 42) -> DataFrame:
    """I15. (profile, h, l, taxon, factor) for every pair (h, l) of the grid but (0, 0).

    Per pair h taxa are raised by 5 and l other taxa lowered to 0.2, chosen by
    seeded md5 order. ``taxa`` has one row per taxon.
    """
    cells = [(h, low) for h in grid for low in grid if (h, low) != (0, 0)]
    pairs = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(low).alias("l")) for h, low in cells])
    n = taxa.agg(F.count("*")).scalar()
    rows = taxa.select(F.col(taxon), F.inline(pairs), n.alias("__nt"))
    rows = rows.withColumn("__k", seeded_order(seed, taxon, "h", "l"))
    ranked = row_number_by(rows, ["h", "l"], [md5_bucket("__k")], [F.col("__k"), F.col(taxon)], "__r")
    chosen = ranked.filter(F.col("__r") <= F.col("h") + F.col("l"))
    profile = F.format_string("NT_%s_H_%s_L_%s", "__nt", "h", "l")
    return chosen.select(
        profile.alias("profile"), "h", "l", taxon, F.when(F.col("__r") <= F.col("h"), UP).otherwise(DOWN).alias("factor")
    )


def plan_as_spec(plan: DataFrame, taxon: str = "species") -> DataFrame:
    """I15 as JSON: (profile, spec) with spec = {tax_level, modif: {taxon: factor}}."""
    modif = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(taxon).cast("string"), "factor"))))
    return plan.groupBy("profile").agg(F.to_json(F.struct(F.lit(taxon).alias("tax_level"), modif.alias("modif"))).alias("spec"))


def community_tables(meta: DataFrame, folder: str = "") -> dict[str, DataFrame]:
    """A17. ``genome_to_id``, ``metadata`` and the profiles in long form (profile, genome_id, abundance)."""
    profiles = [c for c in meta.columns if c.startswith(BALANCED) or c.startswith("NT_")]
    path = F.concat(F.lit(folder.rstrip("/") + "/" if folder else ""), "fasta")
    return {
        "genome_to_id": meta.select("genome_id", path.alias("path")),
        "metadata": meta.select(F.col("genome_id").alias("genome_ID"), "OTU", "NCBI_ID", "novelty_category"),
        "abundance": meta.unpivot(["genome_id"], profiles, "profile", "abundance"),
    }


def write_community(meta: DataFrame, path: str, folder: str = "") -> None:
    """A17. The tables as tab-separated files; one folder per abundance profile."""
    for name, df in community_tables(meta, folder).items():
        writer = df.write.mode("overwrite").option("sep", "\t")
        if name == "abundance":
            writer.partitionBy("profile").csv(f"{path}/abundance")
        else:
            writer.option("header", name == "metadata").csv(f"{path}/{name}")
