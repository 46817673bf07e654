"""Structured Streaming jobs (inventory L1-L3).

All of them run on new files of a folder and resume from their checkpoint.
Sinks write one folder per batch, replaced when a batch is run again, so each
batch counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import vector_sums
from ..operators.embed import reader
from ..operators.kmers import filter_min_length, kmer_count
from ..operators.metrics import accepted


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def stream_kmer_count(reads: DataFrame, k: int, path: str, checkpoint: str, by: Sequence[str] = (), **options) -> StreamingQuery:
    """L1. K-mer counts of each batch of reads as a table of deltas; ``current_counts`` adds them up.

    No state is kept per k-mer: restarts resume from the checkpoint, and the
    deltas are as small as D1 makes them.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        kmer_count(batch, k, by=by, **options).write.mode("overwrite").parquet(_batch_folder(path, batch_id))

    writer = reads.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current_counts(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """L1. The sum of the deltas so far (equals D3 over everything read)."""
    return spark.read.parquet(path).groupBy(*by, "kmer").agg(F.sum("count").alias("count"))


def compact_counts(spark: SparkSession, path: str, out: str, by: Sequence[str] = ()) -> None:
    """L1. The deltas as one table, for the times when there are many."""
    current_counts(spark, path, by).write.mode("overwrite").parquet(out)


def stream_sample_embedding(
    reads: DataFrame,
    vectors: DataFrame,
    k: int,
    path: str,
    checkpoint: str,
    by: Sequence[str] = ("sample_id", "grp"),
    predict: str = "predict",
    compact_every: int | None = None,
    **options,
) -> StreamingQuery:
    """L2. Sums and counts per sample and predicted genome of each batch of reads, as a table of deltas.

    A batch writes one row per sample and genome that it holds, whatever came before; a batch that
    is run again replaces its own folder. ``current_cells`` (G5) and ``current_tabular`` (G1) add the
    deltas up. With ``compact_every`` the deltas so far become one snapshot after so many batches.
    """
    spark = reads.sparkSession
    dim = vectors.select(F.size("vector").alias("d")).first().d
    # the vector table is collected once, not per batch
    embed = reader(vectors, k, **options)

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = filter_min_length(batch, k, strict=True).withColumnRenamed(predict, "genome")
        embedded = embed(rows.select(*by, "genome", "read_id", "read"), "read", (*by, "read_id"), "__e")
        cells = embedded.groupBy(*by, "genome").agg(F.count("*").alias("count"), vector_sums("__e", dim).alias("embedding"))
        cells.write.mode("overwrite").parquet(_batch_folder(f"{path}/deltas", batch_id))
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact_cells(spark, path, by)

    writer = reads.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _snapshot(spark: SparkSession, path: str) -> int:
    """Last batch of the newest finished snapshot, -1 without one."""
    try:
        return spark.read.schema("upto bigint").parquet(f"{path}/finished").agg(F.max("upto")).first()[0]
    except AnalysisException:
        return -1


def current_cells(spark: SparkSession, path: str, by: Sequence[str] = ("sample_id", "grp")) -> DataFrame:
    """L2. (by, genome, count, embedding): G5 over everything read, from the newest snapshot and the deltas after it."""
    upto = _snapshot(spark, path)
    columns = [*by, "genome", "count", "embedding"]
    rows = spark.read.parquet(f"{path}/deltas").filter(F.col("batch") > upto).select(*columns)
    if upto >= 0:
        rows = spark.read.parquet(f"{path}/snapshots/upto={upto}").select(*columns).unionByName(rows)
    dim = rows.select(F.size("embedding").alias("d")).limit(1).collect()
    dim = dim[0].d if dim else 0
    return rows.groupBy(*by, "genome").agg(F.sum("count").alias("count"), vector_sums("embedding", dim).alias("embedding"))


def current_tabular(spark: SparkSession, path: str, by: Sequence[str] = ("sample_id", "grp")) -> DataFrame:
    """L2. (by, embedding): mean read embedding of every sample so far (G1)."""
    cells = current_cells(spark, path, by)
    dim = cells.select(F.size("embedding").alias("d")).limit(1).collect()
    sums = cells.groupBy(*by).agg(F.sum("count").alias("count"), vector_sums("embedding", dim[0].d if dim else 0).alias("sums"))
    return sums.select(*by, F.transform("sums", lambda x: x / F.col("count")).alias("embedding"))


def compact_cells(spark: SparkSession, path: str, by: Sequence[str] = ("sample_id", "grp")) -> int:
    """L2. A snapshot of all batches so far; it counts once its number is noted as finished. Returns its last batch."""
    last = spark.read.parquet(f"{path}/deltas").agg(F.max("batch")).first()[0]
    if last is None or last <= _snapshot(spark, path):
        return -1 if last is None else last
    current_cells(spark, path, by).write.mode("overwrite").parquet(f"{path}/snapshots/upto={last}")
    spark.range(last, last + 1).select(F.col("id").alias("upto")).write.mode("append").parquet(f"{path}/finished")
    return last


def prediction_rate(
    reads: DataFrame, threshold: float, window: str = "1 hour", watermark: str = "10 minutes", ts: str = "ts", read_id: str = "read_id"
) -> DataFrame:
    """L3. Reads, accepted reads and acceptance rate per tumbling window.

    Reads later than the watermark and repeated read ids within it are dropped.
    ``reads`` is a stream or a table with read_id, ts, predict, prob.
    """
    unique = reads.withWatermark(ts, watermark)
    unique = unique.dropDuplicatesWithinWatermark([read_id]) if reads.isStreaming else unique.dropDuplicates([read_id])
    ok = F.sum(accepted(threshold).cast("bigint"))
    rates = unique.groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"), ok.alias("accepted"))
    return rates.select(
        F.col("w.start").alias("window_start"), "n", "accepted", (F.col("accepted") / F.col("n")).alias("rate")
    )


def stream_prediction_rate(reads: DataFrame, threshold: float, path: str, checkpoint: str, **options) -> StreamingQuery:
    """L3. ``prediction_rate`` of a stream; a window is written once the watermark has passed it."""
    rates = prediction_rate(reads, threshold, **options)
    writer = rates.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return writer.format("parquet").trigger(availableNow=True).start()
