"""The batch kernels against the plain expressions they stand for."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandframe.functions import seq as S
from strandframe.functions import vectors as V
from strandframe.functions import words as W
from strandframe.operators import kmers as K


def reads(n=200, letters="ACGTACGTACGTACGTNUacgRY"):
    rng = random.Random(5)
    return [None, "", "A", "é" * 9, "ACGéTTGCA"] + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


def plain_words(read, k, s=1):
    """C6 word by word, as Spark's own expressions make them."""
    return F.transform(S.kmer_starts(read, k, s), lambda i: S.canonical(F.substr(F.col(read), i, F.lit(k))))


def test_sentences_equal_the_plain_expressions(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reads())], "id int, read string")
    for k, s in ((3, 1), (5, 2), (4, 3)):
        known = F.filter(plain_words("read", k, s), lambda w: ~w.rlike("[^ACGT]"))
        marked = F.transform(plain_words("read", k, s), lambda w: F.when(w.rlike("[^ACGT]"), F.lit("<unk>")).otherwise(w))
        marked = F.regexp_replace(F.array_join(marked, " "), "<unk>( <unk>)+", "<unk>")
        rows = df.select(
            known.alias("a"), S.kmers("read", k, s, remove_unk=True).alias("b"), marked.alias("c"), S.kmer_sentence_unk("read", k, s).alias("d")
        ).collect()
        assert all(r.a == r.b and r.c == r.d for r in rows)
    # reads are coded in batches, not by an expression per word
    assert "ArrowEval" in df.select(S.kmer_sentence_unk("read", 3))._jdf.queryExecution().toString()


def test_whole_sentences_equal_the_plain_expressions(spark):
    # a batch with letters outside ASCII and one without
    for rows in (reads(), [r for r in reads() if r is None or r.isascii()]):
        df = spark.createDataFrame([(r,) for r in rows], "read string")
        for k in (1, 3, 6):
            want = F.array_join(plain_words("read", k), " ")
            assert all(r.a == r.b for r in df.select(want.alias("a"), S.kmer_sentence("read", k).alias("b")).collect())
    assert "ArrowEval" in df.select(S.kmer_sentence("read", 3))._jdf.queryExecution().toString()


def test_sums_of_rows_of_any_number(monkeypatch):
    rng = np.random.default_rng(2)
    matrix, sizes = rng.normal(size=(9, 3)), rng.integers(1, 40, 300)
    starts, row = np.cumsum(sizes) - sizes, rng.integers(0, 9, sizes.sum())
    for group, long in ((256, 1024), (7, 5), (1, 1)):
        monkeypatch.setattr(V, "GROUP", group)
        monkeypatch.setattr(V, "LONG", long)
        assert np.allclose(V.row_sums(matrix, row, starts, sizes), np.add.reduceat(matrix[row], starts, axis=0))


def test_codes_do_not_depend_on_the_other_letters_of_a_batch():
    texts = [r for r in reads() if r]
    for k in (1, 2, 5, 12, 15, 16, 31):
        for strand in ("revcomp", "complement", None):
            owner, code = V.kmer_codes(texts, k, strand, turned=True)
            for i, t in enumerate(texts[:40]):
                assert code[owner == i].tolist() == V.kmer_codes([t], k, strand, turned=True)[1].tolist()
                assert (owner == i).sum() == max(0, len(t) - k + 1)


def test_codes_of_lists_equal_the_codes_of_words(spark):
    df = spark.createDataFrame([(r,) for r in reads()], "read string").withColumn("w", S.kmers("read", 5, strand=None))
    df = df.withColumn("w", F.when(F.length("read") != 1, F.concat("w", F.array(F.lit("ACG"), F.lit(None), F.lit("")))))
    rows = df.select(F.transform("w", S.kmer_to_int).alias("a"), S.kmers_to_int("w").alias("b")).collect()
    assert all(r.a == r.b for r in rows) and any(r.a is None for r in rows)


def test_counts_equal_the_plain_count_whatever_a_task_holds(spark, monkeypatch):
    rows = [(None if i % 7 == 0 else f"s{i % 3}", i % 2, r) for i, r in enumerate(reads())]
    df = spark.createDataFrame(rows, "a string, b int, read string").repartition(3)
    for k, s, strand, by in ((3, 1, "revcomp", ["a"]), (4, 2, "complement", ["a", "b"]), (12, 1, "revcomp", []), (5, 3, None, ["b"])):
        words = df.select(*by, "read", F.explode(S.kmer_starts("read", k, s)).alias("p")).select(*by, F.substr("read", "p", F.lit(k)).alias("kmer"))
        words = words.filter(~F.col("kmer").rlike("[^ACGT]")).withColumn("kmer", S.canonical("kmer", strand))
        want = {tuple(r) for r in words.groupBy(*by, "kmer").agg(F.count("*")).collect()}
        got = K.kmer_count(df, k, s, by, strand)
        assert got.columns == [*by, "kmer", "count"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_counts_without_groups_add_up_where_they_are(monkeypatch):
    import pyarrow as pa

    # one group whatever the number of reads: k-mers are counted by place, not sorted
    monkeypatch.setattr(np, "lexsort", None)
    monkeypatch.setattr(W, "HELD", 1 << 10)
    batch = pa.record_batch({"read": pa.array(["ACGTN", None, "AACG"] * 100, pa.string())})
    got = {r["code"]: r["n"] for t in W.counter(3, 1, None, [])(iter([batch])) for r in t.to_pylist()}
    assert got == {0b100100: 200, 0b111001: 100, 0b010000 | 0b000000: 100}


def test_long_reads_are_cut_into_pieces_with_every_window_once(monkeypatch):
    read = "".join(random.Random(3).choice("ACGT") for _ in range(97))
    for s in (1, 3):
        pieces = [(o, p) for rows, ps in W.tiled(np.array([4, 5]), [read, "ACGTA"], 5, s, 10) for o, p in zip(rows, ps)]
        starts = lambda r: [r[i : i + 5] for i in range(0, len(r) - 4, s)]
        assert [w for o, p in pieces if o == 4 for w in starts(p)] == starts(read)
        assert max(len(p) for _, p in pieces) <= 14


def test_plain_words_are_substrings(spark):
    for rows in (reads(), [r for r in reads() if r is None or r.isascii()]):
        df = spark.createDataFrame([(r,) for r in rows], "read string")
        want = F.transform(S.kmer_starts("read", 4, 3), lambda i: F.substr("read", i, F.lit(4)))
        assert all(r.a == r.b for r in df.select(want.alias("a"), S.kmers("read", 4, 3, strand=None).alias("b")).collect())


def test_near_words_equal_a_plain_count(spark, monkeypatch):
    from collections import Counter

    import pyarrow as pa

    rng = random.Random(4)
    lists = [None, [], [None], *[[rng.choice(["a", "b", "c", None]) for _ in range(rng.randrange(9))] for _ in range(40)]]
    want = Counter()
    for words in lists:
        for i, a in enumerate(words or []):
            for d, b in enumerate(words[i + 1 : i + 4], 1):
                want[a, b, d] += 1
    for most in (W.LETTERS, 5):
        monkeypatch.setattr(W, "LETTERS", most)
        batches = [pa.record_batch({"words": pa.array(part, pa.list_(pa.string()))}) for part in (lists[:9], lists[9:])]
        got = [(*r[:3], r[3]) for b in W.pair_counter(3)(iter(batches)) for r in zip(*[c.to_pylist() for c in b.columns])]
        assert {r[:3]: r[3] for r in got} == +want and len(got) == len(+want)
