"""Session defaults, the shared work folder, and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
# for rows of megabytes: Parquet looks at a page's and a row group's size from the 100th row on only, and a reader holds a row group at once
WIDE_ROWS = {
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size": str(16 << 20),
    "parquet.block.row.count.limit": "8",
}


def local_session(cores: int = 8, name: str = "strandframe", **conf: str) -> SparkSession:
    """Session for tests and the bench; on a cluster the session is given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the folder the cluster names in spark.checkpoint.dir.

    A local master without that setting (tests) gets a temporary folder; any
    other master without it is an error, since executors could not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, "strandframe-" + uuid.uuid4().hex)


def materialize(df: DataFrame, *partition_by: str, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with data that survives the loss of an executor; used
    where several consumers need the same expensive rows. ``wide`` rows, of megabytes each, are
    written a few at a time, so that neither writer nor reader holds a hundred of them.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    writer = df.write.options(**WIDE_ROWS) if wide else df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only when ``df`` was counted to have at most ``max_rows``.

    The count stops at ``max_rows + 1`` rows. Beyond the bound the frame is
    returned without hint, so the join shuffles.
    """
    return F.broadcast(df) if fits(df, max_rows) else df


def fits(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows
