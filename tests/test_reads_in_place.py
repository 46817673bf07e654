"""Reads are tokenized and counted where they are; shared and null keys have the results of the grouping."""

import random

from strandframe.operators import embed as E
from strandframe.operators import kmers as K
from strandframe.operators import tokens as TK
from strandframe.plans import counting as C

READS = "read_id string, sample_id string, read string"


def rows():
    rng = random.Random(8)
    ids = ["a", "b", "b", None, None, *map(str, range(40))]
    return [(i, "s", "".join(rng.choice("ACGTACGTNU") for _ in range(rng.randrange(0, 30)))) for i in ids] + [("z", "s", None)]


def plain(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_tokens_equal_those_of_the_join(spark):
    df = spark.createDataFrame(rows(), READS)
    vocab = spark.createDataFrame([("AAC", 7), ("CGT", 3), ("ACA", None), ("CCC", 0), ("<unk>", 9), ("AC", 5), (None, 4)], "kmer string, id int")
    for v in (vocab, vocab.where("kmer <> '<unk>'"), vocab.limit(0)):
        for options in ({}, {"max_length": 9, "min_length": 12}):
            got = TK.tokenize(df, v, 3, **options)
            assert plain(got) == plain(TK.tokenize(df, v, 3, table_rows=-1, **options))
    assert TK.code_table(vocab.union(vocab), 3) is None


def test_hashed_counts_equal_those_of_the_grouping(spark):
    df = spark.createDataFrame(rows(), READS)
    assert plain(E.kmer_hash_embedding(df, 3)) == plain(E._hash_grouped(df, 3, ["read_id"], "revcomp"))


def test_pruned_sentences_equal_those_of_the_join(spark):
    df = spark.createDataFrame(rows(), READS)
    vocab = spark.createDataFrame([("AAC",), ("CGT",), ("ACA",), ("CCC",)], "kmer string")
    got = C.pruned_sentences(df, vocab, 3).where("size(words) > 0")
    assert plain(got) == plain(C._pruned_joined(df, vocab, 3))


def test_distinct_reads_are_not_shuffled(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] not in (None, "b")], READS)
    vocab = spark.createDataFrame([("AAC", 7), ("CGT", 3)], "kmer string, id int")
    kept = C.pruned_sentences(df, vocab, 3)
    for frame in (TK.tokenize(df, vocab, 3), E.kmer_hash_embedding(df, 3), kept):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_gathered_counts_are_the_same(spark):
    df = spark.createDataFrame(rows(), READS)
    plan = K.kmer_count(df, 3, by=["read_id"], gather=True)
    assert plain(plan) == plain(K.kmer_count(df, 3, by=["read_id"]))


def test_equal_pairs_are_oriented_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandframe.operators import context as X

    pairs = X.context_pairs(spark.createDataFrame(rows(), READS), 2, 2, 1)
    want = plain(X.orient(pairs).groupBy("kmer", "context").agg(F.count("*")))
    seen, orient = [], X.orient
    monkeypatch.setattr(X, "orient", lambda df: seen.append(df) or orient(df))
    assert plain(C.oriented_counts(pairs)) == want
    assert seen[0].count() == pairs.distinct().count() < pairs.count()


def test_first_and_last_words_equal_those_of_the_grouping(spark):
    from pyspark.sql import functions as F

    from strandframe.plans.filters import first_and_last

    df = spark.createDataFrame([(i, r and r * 3) for i, _, r in rows()], "read_id string, read string")
    kept = K.filter_acgt(TK.kmer_positions(df, 9, ["read_id"], strand=None))
    want = kept.groupBy("read_id").agg(F.count("*"), F.min("kmer"), F.max("kmer"))
    assert plain(first_and_last(df)) == plain(want) != []
    alone = first_and_last(df.where("read_id NOT IN ('b')"))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    lists = spark.createDataFrame([(["ACG", "ANG", None, ""],), (None,), ([],)], "kmer array<string>")
    assert [r.kmer for r in K.filter_acgt(lists).collect()] == [["ACG", ""], None, []]


def test_vectors_in_blocks_equal_those_of_the_join(spark, monkeypatch):
    df = spark.createDataFrame(rows(), READS)
    vectors = spark.createDataFrame([(a + b, [float(i), 1.0 - j, 3.0]) for i, a in enumerate("ACG") for j, b in enumerate("ACGT")], "kmer string, vector array<double>")
    monkeypatch.setattr(E, "BLOCK_BYTES", 64)
    values = lambda df: sorted((repr(r.read_id), repr(r.read), [round(x, 9) for x in r.e]) for r in df.collect())
    unit = E.unit_vectors(vectors)
    assert len(E._vector_blocks(unit, 2)[0]) > 1
    for agg in ("mean", "sum"):
        for strand in ("complement", "revcomp"):
            want = E._embed_by_join(df, unit, 2, agg, strand, "read", ["read_id"], "e")
            got = E.read_embedding(df, vectors, 2, agg, strand=strand, out="e", max_bytes=0)
            assert values(got) == values(want)
    alone = E.read_embedding(df.where("read_id NOT IN ('b')"), vectors, 2, max_bytes=0)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    for odd in ([("AN", [1.0])], [("AC", [1.0]), ("AC", [2.0])], [("AC", [None])], [("AC", [1.0]), ("AG", [1.0, 2.0])]):
        assert E._vector_blocks(spark.createDataFrame(odd, "kmer string, vector array<double>"), 2) is None


def test_wide_vectors_come_from_the_tasks(spark):
    df = spark.createDataFrame(rows(), READS)
    vectors = spark.createDataFrame([("A", [1.0, 0.5]), ("C", [-1.0, 0.25])], "kmer string, vector array<double>")
    got = E.read2vec(df, vectors, 1, drop_col=False, digits=3)
    want = E.read2vec(df, vectors, 1, drop_col=False, digits=3, max_bytes=0)
    assert got.columns == ["read_id", "sample_id", "read", "0", "1"] == want.columns
    assert plain(got) == plain(E.read_embedding(df, vectors, 1).selectExpr(*READS.replace(" string", "").split(", "), "round(embedding[0], 3) + 0.0D", "round(embedding[1], 3) + 0.0D"))
    assert "Project" not in got._jdf.queryExecution().executedPlan().toString()
