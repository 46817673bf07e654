"""The registered queries: pairing with SQL, streams, and a sample of them run against DuckDB."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from strandframe.operators.embed import read_embedding
from strandframe.streaming import jobs as J
from tools.check import duck, rows

SF = "/root/testdata/sf0.001"
SAMPLE = ["c6_kmers", "d4_add_index", "e2_read_embedding", "g3_relaxed_threshold", "h4_complete_genomes", "i4_class_proportion", "j10_score_report", "k8_ilr"]


def test_statements_belong_to_queries_and_bind():
    sql, con = oracle_sql(), duck(SF)
    assert set(sql) <= set(queries())
    for name, text in sql.items():
        con.execute("EXPLAIN " + text)


def test_entry(spark):
    df = entry(spark)
    assert {"sample_id", "kmer", "count"} <= set(df.columns) and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = queries()[name](spark, SF).toPandas()
    want = duck(SF).execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(got)


def test_stream_drops_late_and_repeated_reads(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    at = lambda minutes: t0 + dt.timedelta(minutes=minutes)
    schema = "read_id string, ts timestamp, predict bigint, prob double"
    batches = [
        [("a", at(5), 1, 0.9), ("b", at(6), 1, 0.1), ("a", at(5), 1, 0.9)],
        [("c", at(130), 1, 0.9)],
        # a repeated read within the watermark, a late one, one that closes the second window
        [("c", at(130), 1, 0.9), ("late", at(10), 1, 0.9), ("d", at(125), 2, 0.2)],
        [("e", at(400), 1, 0.9)],
    ]
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        J.stream_prediction_rate(J.read_stream(spark, src, schema), 0.5, out, ck).awaitTermination()
    got = {r.window_start.hour: (r.n, r.accepted) for r in spark.read.parquet(out).collect()}
    assert got == {0: (2, 1), 2: (2, 1)}


def test_stream_counts_survive_a_restart(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for text in ("ACGTAC", "ACGTTT", "NNACG"):
        spark.createDataFrame([(text,)], "read string").write.mode("append").parquet(src)
        J.stream_kmer_count(J.read_stream(spark, src, "read string"), 3, out, ck).awaitTermination()
    got = {r.kmer: r["count"] for r in J.current_counts(spark, out).collect()}
    # GTA and TAC turn into each other: the flipped form may start with G or T
    assert got == {"ACG": 3, "CGT": 2, "TAC": 1, "GTA": 1, "AAC": 1, "AAA": 1}


def test_sample_sums_are_written_by_batch(spark, tmp_path):
    vectors = spark.createDataFrame([("AC", [1.0, 0.0]), ("CG", [0.0, 2.0]), ("GT", [3.0, 4.0])], "kmer string, vector array<double>")
    schema = "read_id string, read string, sample_id string, grp string, predict bigint"
    batches = [[(f"a{i}", "ACGT", f"s{i % 5}", "x", i % 3) for i in range(30)], [("b", "ACG", "s0", "x", 0)], [("c", "CGT", "new", "y", 7), ("d", "A", "s0", "x", 0)]]
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        J.stream_sample_embedding(J.read_stream(spark, src, schema), vectors, 2, out, ck, compact_every=2).awaitTermination()
        assert spark.read.parquet(f"{out}/deltas/batch={n}").count() == [15, 1, 1][n]
    # two batches are in the snapshot, the third is read on top of it
    assert spark.read.parquet(f"{out}/finished").first().upto == 1 == J._snapshot(spark, out)
    whole = spark.createDataFrame(sum(batches, []), schema).filter("length(read) > 2")
    want = read_embedding(whole, vectors, 2).groupBy("sample_id", "grp", "predict").agg(F.count("*").alias("n"), F.sum(F.col("embedding")[0]).alias("x"), F.sum(F.col("embedding")[1]).alias("y"))
    want = {(r.sample_id, r.grp, r.predict): (r.n, pytest.approx(r.x), pytest.approx(r.y)) for r in want.collect()}
    cells = lambda: {(r.sample_id, r.grp, r.genome): (r["count"], *r.embedding) for r in J.current_cells(spark, out).collect()}
    assert cells() == want and len(want) == 16
    # a batch that is run again replaces its own rows, and a further snapshot changes nothing
    again = spark.read.parquet(f"{out}/deltas/batch=2").collect()
    spark.createDataFrame(again).write.mode("overwrite").parquet(f"{out}/deltas/batch=2")
    assert J.compact_cells(spark, out) == 2 == J.compact_cells(spark, out) and cells() == want
    tabular = {r.sample_id: r.embedding for r in J.current_tabular(spark, out).collect()}
    # of CG and the complement of GT only CG is known
    assert len(tabular) == 6 and tabular["new"] == pytest.approx([0.0, 1.0])
    # nothing new: no batch, no row
    J.stream_sample_embedding(J.read_stream(spark, src, schema), vectors, 2, out, ck).awaitTermination()
    assert spark.read.parquet(f"{out}/deltas").agg(F.max("batch")).first()[0] == 2
