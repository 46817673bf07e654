"""Operators whose results or groups grow with the number of genomes."""

import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strandframe.operators import datasets as D
from strandframe.operators import metrics as M
from strandframe.operators import sample as G


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_abundance_has_rows_for_more_genomes_than_a_pivot_has_columns(spark):
    counts = spark.createDataFrame(
        [("a", "x", 1, 3), ("a", "x", 2, 1), ("b", None, 3, 5), ("b", None, None, 5), ("c", "x", 4, 2)],
        "sample_id string, grp string, genome bigint, count bigint",
    )
    got = {(r.sample_id, r.grp, r.genome): r.abundance for r in G.abundance_table(counts, wide=False).collect()}
    wide = G.abundance_table(counts)
    want = {(r.sample_id, r.grp, None if g == "null" else int(g)): r[g] for r in wide.collect() for g in wide.columns[2:]}
    assert got == want and len(got) == 15
    listed = {(r.sample_id, r.genome): r.abundance for r in G.abundance_table(counts, [2, 7], wide=False).collect()}
    assert listed == {("a", 2): 0.25, ("b", 2): 0.0, ("c", 2): 0.0, ("a", 7): 0.0, ("b", 7): 0.0, ("c", 7): 0.0}
    spark.conf.set("spark.sql.pivotMaxValues", 3)
    try:
        with pytest.raises(AnalysisException):
            G.abundance_table(counts)
        assert G.abundance_table(counts, wide=False).count() == 15
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_cells_without_threshold_or_mates_shuffle_predictions_once(spark):
    vectors = spark.createDataFrame([("A", [1.0])], "kmer string, vector array<double>")
    reads = spark.createDataFrame([("s", "g", f"r{i}", "AAC") for i in range(9)], "sample_id string, grp string, read_id string, read string")
    # a prediction of a read that isn't there, one of a read without id, a read with two
    pred = [("s", "r1", 1, 0.5), ("s", "r1", 2, 0.5), ("s", "gone", 3, 0.9), ("s", None, 4, 0.9)]
    pred = spark.createDataFrame(pred, "sample_id string, read_id string, predict bigint, prob double")
    cells = G.sample_cells(reads, vectors, 1, pred, 0.0, paired=False)
    assert "Semi" not in plan(cells)
    assert re.search(r"rangepartitioning\([^)]*genome\S* ASC[^)]*__part", plan(cells))
    assert {r.genome: (r["count"], r.embedding[0]) for r in cells.collect()} == {1: (1, 1.0), 2: (1, 1.0), None: (8, 8.0)}


def test_cells_are_embedded_once_and_summed_by_genome(spark):
    vectors = spark.createDataFrame([("A", [1.0, 0.0]), ("C", [0.0, 1.0])], "kmer string, vector array<double>")
    rows = [("s1" if i % 3 else "s2", "g", f"r{i}", "AAC" if i % 2 else "CC") for i in range(60)]
    reads = spark.createDataFrame(rows, "sample_id string, grp string, read_id string, read string")
    pred = [(s, r, int(r[1:]) % 4, 0.5) for s, _, r, _ in rows if r != "r7"]
    pred = spark.createDataFrame(pred, "sample_id string, read_id string, predict bigint, prob double")
    cells = G.sample_cells(reads, vectors, 1, pred, 0.0, paired=False)
    assert re.search(r"rangepartitioning\(sample_id\S* ASC[^)]*genome", plan(cells))
    out = G.collect_samples(cells, 2)
    got = {(r.sample_id, r.genome): r.embedding for r in out["mil"].collect()}
    want = {}
    for s, _, r, text in rows:
        if r != "r7":
            e = want.setdefault((s, int(r[1:]) % 4), [0.0, 0.0])
            e[0] += text.count("A") / len(text)
            e[1] += text.count("C") / len(text)
    assert got.keys() == want.keys()
    assert all(abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k]))
    assert sum(r["count"] for r in cells.collect()) == 60
    # the three tables read the written cells, not the reads
    assert not any("Python" in plan(df) or "Arrow" in plan(df) for df in out.values())


def test_mates_meet_in_one_shuffle(spark):
    rows = [("a", "f/1", 1, 0.5), ("a", "f/2", 2, 0.7), ("a", "g/1", 3, 0.4), ("a", "g/2", 4, 0.4), (None, "f/1", 5, None), (None, "f/2", 6, 0.9), ("a", None, 7, 0.9)]
    df = spark.createDataFrame(rows, "sample_id string, read_id string, predict bigint, prob double")
    out = G.pair_consensus(df)
    got = {(r.sample_id, r.read_id): (r.predict, r.prob) for r in out.collect()}
    assert got == {("a", "f/1"): (2, 0.7), ("a", "f/2"): (2, 0.7), ("a", "g/1"): (3, 0.4), ("a", "g/2"): (3, 0.4), (None, "f/1"): (5, None), (None, "f/2"): (5, None)}
    assert "Join" not in plan(out)


def test_confusion_matrix_is_completed_without_a_join_of_label_pairs(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 3), (None, 1), (3, None)], "tax_id bigint, predict bigint")
    out = M.confusion_matrix(df)
    got = {(r.true, r.pred): r.share for r in out.collect()}
    want = {(t, p): 0.0 for t in (1, 2, 3, None) for p in (1, 2, 3)}
    assert got == {**want, (1, 1): 2 / 3, (1, 2): 1 / 3, (2, 3): 1.0} and out.count() == 12
    labels = spark.createDataFrame([(2,), (1,), (9,)], "label int")
    got = sorted((r.true, r.pred, r.share) for r in M.confusion_matrix(df, labels).collect())
    assert got == [(1, 1, 2 / 3), (1, 2, 1 / 3), (1, 9, 0.0), (2, 1, 0.0), (2, 2, 0.0), (2, 9, 0.0), (9, 1, 0.0), (9, 2, 0.0), (9, 9, 0.0)]
    assert not re.search(r"Join[^\n]*pred#", plan(out))


def test_split_of_small_strata_sorts_each_once(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"r{i}", t, f"s{i % 2}") for i, t in enumerate(rng.choices([1, 2, 3, None], [50, 20, 4, 6], k=300))]
    reads = spark.createDataFrame(rows, "read_id string, tax_id bigint, species string")
    split = lambda: D.stratified_split(reads, ["read_id"])
    small = split()
    assert "__mf_b" not in plan(small)
    want = sorted((r.read_id, r.part) for r in small.collect())
    for t in (1, 2, 3, None):
        n = sum(r[1] == t for r in rows)
        assert sum(part == "valid" for read, part in want if rows[int(read[1:])][1] == t) == int(0.3 * n + 0.5)
    for most in (0, 30):  # all strata cut by a histogram, and only the large ones
        monkeypatch.setattr(D, "SORTED_ROWS", most)
        assert sorted((r.read_id, r.part) for r in split().collect()) == want
    lone = reads.unionByName(spark.createDataFrame([("x", 8, "s1")], reads.schema))
    got = D.stratified_split(lone, ["read_id"]).groupBy("species").agg(F.count("*").alias("n"), F.sum((F.col("part") == "valid").cast("int")).alias("v"))
    assert {r.species: r.v for r in got.collect()} == {r.species: int(0.3 * r.n + 0.5) for r in got.collect()}
    assert D.stratified_split(reads.limit(0), ["read_id"]).count() == 0


def test_split_and_shares_shuffle_little(spark, monkeypatch):
    rows = [(f"r{i}", i % 3 if i % 7 else None, "s", f"sim{i % 2}" if i % 5 else None) for i in range(60)]
    reads = spark.createDataFrame(rows, "read_id string, tax_id bigint, species string, sim_id string")
    # the 32 letters of a row's order are made behind the shuffle
    split = D.stratified_split(reads, ["read_id"])
    assert plan(split).index("md5(") < plan(split).index("REPARTITION_BY_COL")
    assert split.count() == 60
    # reads stay where they are while the shares are few, and the result is that of the shuffle
    few = D.class_proportion(reads)
    assert "Exchange hashpartitioning" not in plan(few)
    monkeypatch.setattr(D, "SHARES", 0)
    got = {r.read_id: r.prop for r in few.collect()}
    assert got == {r.read_id: r.prop for r in D.class_proportion(reads).collect()} and len(got) == 60
    sizes = {s: sum(r[3] == s for r in rows) for s in (None, "sim0", "sim1")}
    assert got == {r[0]: pytest.approx(sum(x[1] == r[1] and x[3] == r[3] for x in rows) / sizes[r[3]]) for r in rows}


def test_dataset_of_reads_is_labelled_and_split_once(spark):
    fastq = spark.createDataFrame([(f"@r{i}-1", "ACGT") for i in range(4)], "read_id string, read string")
    mapping = spark.createDataFrame([(f"r{i}", "genome_1", "x") for i in range(4)], "anonymous_read_id string, genome_id string, tax_id string")
    genomes = spark.createDataFrame([("genome_1", 5)], "genome_id string, NCBI_ID bigint")
    taxonomy = spark.createDataFrame([(5, 1)], "tax_id bigint, species bigint")
    out = D.read2genome_dataset(fastq, mapping, genomes, taxonomy)
    assert out.filter("part = 'valid'").count() == 1 and out.count() == 4
    assert out.inputFiles() and all("strandframe-" in f for f in out.inputFiles())


def test_rows_of_pairs_are_copied_a_bounded_number_of_times():
    from strandframe.operators import distance as DI

    for n in (6_000, 60_000, 360_000):
        assert -(-n // DI.block_rows(n, 64)) <= DI.BLOCKS
    # blocks of wide vectors and of huge sets still fit a task
    assert DI.block_rows(1 << 30, 1) == DI.MOST_ROWS and DI.block_rows(1 << 30, 1 << 13) * (1 << 13) <= DI.MOST_NUMBERS


def test_pairs_are_handed_on_in_parts(spark, monkeypatch):
    from strandframe.operators import distance as DI

    rng = random.Random(5)
    rows = [(i, [rng.random(), rng.random()]) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    want = {(r.i, r.j): r.distance for r in DI.genome_distance(df).collect()}
    assert len(want) == 190
    monkeypatch.setattr(DI, "PAIRS", 10)
    got = {(r.i, r.j): r.distance for r in DI.genome_distance(df, block=7).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert DI.genome_distance(df.limit(0)).count() == 0


def test_no_row_holds_a_whole_block_of_a_matrix(spark, monkeypatch):
    from strandframe.operators import distance as DI

    monkeypatch.setattr(DI, "STRIP", 2)
    cells = spark.createDataFrame([(r, c, float(r * 9 + c)) for r in range(9) for c in range(9)], "r bigint, c bigint, v double")
    strips = DI._matrix_blocks(cells, "v", 5, False).collect()
    assert len(strips) == 4 * 3 and max(len(s.numbers) for s in strips) == 2 * 5 * 8
    rng = random.Random(6)
    pairs = [(i, j, rng.random(), rng.random()) for i in range(11) for j in range(i + 1, 11)]
    x, y = (spark.createDataFrame([(i, j, v[k]) for i, j, *v in pairs], "i bigint, j bigint, distance double") for k in (0, 1))
    for part in (x, x.where("i <> 4 OR j <> 7")):
        assert DI.mantel(part, y, 19, block=4, at_once=7).first() == pytest.approx(DI.mantel(part, y, 19).first())
