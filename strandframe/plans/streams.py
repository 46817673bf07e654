"""Section L: streaming jobs run to the end of their input; the result is the final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import jobs as J
from .embedding import checks, checks_sql
from .registry import query

SCHEMA = "read_id string, read string, sample_id string, grp string, predict bigint"


def arrivals(fx) -> tuple[str, list]:
    """(folder, parts): reads of samples that arrive one after the other."""
    reads = fx.reads.select("read_id", "read", "sample_id", "grp", "predict")
    late = F.regexp_extract("sample_id", "[0-9]+", 0).cast("int") % 3 == 0
    return shared_dir(fx.spark), [reads.filter(~late), reads.filter(late)]


@query("l1_stream_kmer_count", "SELECT kmer, count FROM word6")
def _(fx):
    folder, parts = arrivals(fx)
    out, checkpoint = shared_dir(fx.spark), shared_dir(fx.spark)
    for part in parts:
        part.write.mode("append").parquet(folder)
        # every round is a restart from the checkpoint
        stream = J.read_stream(fx.spark, folder, SCHEMA)
        J.stream_kmer_count(stream, 6, out, checkpoint).awaitTermination()
    return J.current_counts(fx.spark, out)


@query(
    "l2_stream_sample_embedding",
    f"""SELECT 'mil' AS part, sample_id, grp, genome, count, {checks_sql(4)} FROM mil
    UNION ALL SELECT 'tabular', sample_id, grp, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), {checks_sql(4)} FROM sil""",
)
def _(fx):
    folder, parts = arrivals(fx)
    out, checkpoint = shared_dir(fx.spark), shared_dir(fx.spark)
    for part in parts:
        part.write.mode("append").parquet(folder)
        stream = J.read_stream(fx.spark, folder, SCHEMA)
        J.stream_sample_embedding(stream, fx.kmer_vectors, 5, out, checkpoint).awaitTermination()
    keys = ["part", "sample_id", "grp", "genome", "count"]
    mil = J.current_cells(fx.spark, out).withColumn("part", F.lit("mil"))
    minus = F.lit(-1).cast("bigint")
    tabular = J.current_tabular(fx.spark, out).withColumns({"part": F.lit("tabular"), "genome": minus, "count": minus})
    return checks(mil, keys, 4).unionByName(checks(tabular, keys, 4))


@query(
    "l3_stream_prediction_rate",
    """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, CAST(count(*) AS BIGINT) AS n,
      CAST(count(*) FILTER (prob > 0.35) AS BIGINT) AS accepted, round(count(*) FILTER (prob > 0.35) / count(*), 9) AS rate
    FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, prob FROM read_stream) GROUP BY w
    HAVING w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM read_stream) - INTERVAL 10 MINUTE""",
)
def _(fx):
    events = fx.table("events")
    stream = J.read_stream(fx.spark, fx.sf_dir, events.schema, glob="events.parquet")
    reads = stream.selectExpr(
        "CAST(event_id AS STRING) AS read_id", "CAST(ts AS TIMESTAMP) AS ts", "round(pmod(value, 10) / 10, 6) AS prob", "user_id AS predict"
    )
    out, checkpoint = shared_dir(fx.spark), shared_dir(fx.spark)
    J.stream_prediction_rate(reads, 0.35, out, checkpoint).awaitTermination()
    rates = fx.spark.read.parquet(out)
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rates.select(start, "n", "accepted", F.round("rate", 9).alias("rate"))
