"""Lineages over a parent/child table (inventory I8, I9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

# Ranks from the broadest to the most specific.
RANKS = ["kingdom", "phylum", "class", "order", "family", "genus", "species", "strain"]
MISSING = -1
# levels of a walk between two writes
LEVELS = 8


def rank_lineage(taxa: DataFrame, nodes: DataFrame, tax_id: str = "tax_id", ranks: Sequence[str] = RANKS) -> DataFrame:
    """I8. Adds id and name of every rank above (and including) the taxon, -1 where absent.

    ``nodes`` holds (node_id, parent_id, rank, name). Each level is one equi-join that keeps one row
    per taxon and appends to its path. Every ``LEVELS`` levels the rows are written; the walk ends
    when no row has a parent left, or meets a node of its path again.
    """
    step = nodes.select(
        F.col("node_id").alias("__node"),
        F.col("parent_id").cast("bigint").alias("__parent"),
        F.struct(F.col("rank"), F.col("node_id").cast("bigint").alias("id"), F.col("name")).alias("__here"),
    )
    empty = F.array().cast("array<struct<rank:string,id:bigint,name:string>>")
    rows = taxa.withColumns({"__at": F.col(tax_id).cast("bigint"), "__path": empty})
    moving = True
    while moving:
        for _ in range(LEVELS):
            path = F.when(F.col("__here").isNull(), F.col("__path")).otherwise(F.concat("__path", F.array("__here")))
            rows = rows.join(step, F.col("__at") == F.col("__node"), "left")
            rows = rows.select(*taxa.columns, F.col("__parent").alias("__at"), path.alias("__path"))
            # the root may name itself as parent
            again = F.exists("__path", lambda x: x["id"] == F.col("__at"))
            rows = rows.withColumn("__at", F.when(~again, F.col("__at")))
        rows = materialize(rows)
        moving = not rows.filter("__at IS NOT NULL").isEmpty()
    cols = {}
    for r in ranks:
        hit = F.get(F.filter("__path", _of_rank(r)), F.lit(0))
        cols[r] = F.coalesce(hit["id"], F.lit(MISSING).cast("bigint"))
        cols[f"{r}_name"] = F.coalesce(hit["name"], F.lit(str(MISSING)))
    return rows.withColumns(cols).drop("__at", "__path")


def _of_rank(rank: str):
    return lambda p: p["rank"] == rank


def rank_backfill(df: DataFrame, ranks: Sequence[str] = RANKS) -> DataFrame:
    """I9. A missing rank takes id and name of the next more specific rank that is present."""
    cols = {}
    for i, r in enumerate(ranks[:-1]):
        chain = ranks[i:]
        present = [F.when(F.col(c) != MISSING, F.struct(F.col(c).alias("id"), F.col(f"{c}_name").alias("name"))) for c in chain]
        cols[r] = F.coalesce(*present)
    filled = df.withColumns({f"__{r}": c for r, c in cols.items()})
    out = {}
    for r in cols:
        out[r] = F.coalesce(F.col(f"__{r}")["id"], F.col(r))
        out[f"{r}_name"] = F.coalesce(F.col(f"__{r}")["name"], F.col(f"{r}_name"))
    return filled.withColumns(out).drop(*[f"__{r}" for r in cols])
