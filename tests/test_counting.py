"""Counts, vocabularies, ranks and token sequences."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from strandframe.operators import kmers as K
from strandframe.operators.embed import kmer_idf, read_embedding, sentence_embedding
from strandframe.operators.filters import limit_reads
from strandframe.operators.ranking import number_rows
from strandframe.operators.ranking import first_rows, mark_first, row_number_by, running_sum
from strandframe.operators.tiling import tile
from strandframe.operators.tokens import pad_tokens, tokenize

FLIP = str.maketrans("ACGT", "TGCA")


def canon(w, strand="revcomp"):
    if w[0] in "AC":
        return w
    w = w.translate(FLIP)
    return w[::-1] if strand == "revcomp" else w


def counts(spark, rows):
    return spark.createDataFrame(rows, "kmer string, count bigint")


def random_reads(n, rng, alphabet="ACGTN"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def test_word_count_literals(spark):
    df = spark.createDataFrame([("ATGCGGT",), ("ATGCGG",)], "read string")
    got = K.kmer_count(df, 6, by=(), strand=None).collect()
    assert sorted(map(tuple, got)) == [("ATGCGG", 2), ("TGCGGT", 1)]


def test_kmer_count_brute_force_both_plans(spark):
    texts = random_reads(200, random.Random(1)) + ["AAAAAAAAAAAAAAAAAAAAAAAA"] * 100
    df = spark.createDataFrame([(t,) for t in texts], "read string")
    for k in (3, 13):
        for s in (1, 2):
            want = Counter(
                canon(t[i : i + k]) for t in texts for i in range(0, len(t) - k + 1, s) if set(t[i : i + k]) <= set("ACGT")
            )
            got = {r.kmer: r["count"] for r in K.kmer_count(df, k, s, by=()).collect()}
            assert got == want


def test_merge_and_index_literals(spark):
    a = counts(spark, [("ATGCGG", 4), ("TGCGGT", 1), ("GGTAGG", 3)])
    b = counts(spark, [("ATGCGG", 4), ("AAAAAA", 2)])
    merged = {r.kmer: r["count"] for r in K.merge_counts(a, b).collect()}
    assert merged == {"ATGCGG": 8, "TGCGGT": 1, "GGTAGG": 3, "AAAAAA": 2}
    assert K.merge_counts(None, b) is b and K.merge_counts(a, None) is a
    assert {r.kmer: r.id for r in K.add_index(a).collect()} == {"ATGCGG": 1, "GGTAGG": 2, "TGCGGT": 3}


def test_vocabulary_and_cutoffs(spark):
    rows = [("AAA", 50), ("<unk>", 30), ("CCC", 9), ("ACA", 9), ("CAC", 2)]
    got = {r.kmer: (r["count"], r.id) for r in K.vocabulary(counts(spark, rows)).collect()}
    assert got["<unk>"] == (30, 0) and got["<msk>"] == (0, 4)
    assert [got[w][1] for w in ("AAA", "ACA", "CCC", "CAC")] == [5, 6, 7, 8]
    # one word spans several cutoffs: one cutoff per position
    total, cum, want, i = 100, 0, [], 1
    for pos, (_, c) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0]))):
        cum += c
        if cum * 10 > i * total:
            want.append(pos)
            i += 1
            if i == 10:
                break
    got = [r.cutoff for r in K.softmax_cutoffs(counts(spark, rows), 10).orderBy("part").collect()]
    assert got[: len(want)] == want


def test_gc_mean_literal(spark):
    df = spark.createDataFrame([("GAGTCGGCGGCCGCCTAGGTTCCC",), ("CTAGGCTT",)], "read string")
    assert K.gc_mean(df).first()[0] == 0.625


def test_matrix_columns():
    assert K.matrix_columns(2)[:3] == ["AA", "CA", "AC"] and len(K.matrix_columns(6)) == 2048


def test_ranks_with_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.randrange(50)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])), 1):
            want[r[1]] = n
    ranked = row_number_by(df, ["g"], [F.floor(F.col("v") / 7)], [F.col("v"), F.col("id")])
    assert {r.id: r["rank"] for r in ranked.collect()} == want
    two_levels = row_number_by(df, ["g"], [F.floor(F.col("v") / 7), F.col("v")], [F.col("v"), F.col("id")])
    assert {r.id: r["rank"] for r in two_levels.collect()} == want
    first = mark_first(df, ["g"], F.floor(F.col("v") / 7), [F.col("v"), F.col("id")], F.lit(37))
    assert {r.id: r.first for r in first.collect()} == {i: n <= 37 for i, n in want.items()}
    top = first_rows(df, ["g"], [F.col("v"), F.col("id")], 5, F.col("id"))
    assert {r.id for r in top.collect()} == {i for i, n in want.items() if n <= 5}
    sums = running_sum(df, [], [F.col("v")], [F.col("v"), F.col("id")], F.col("v"), "s")
    cum = dict(zip([r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))], np.cumsum(sorted(r[2] for r in rows))))
    assert {r.id: r.s for r in sums.collect()} == cum


def test_tiles_cover_each_window_once(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("ACGT") for _ in range(5000))
    df = spark.createDataFrame([(1, text), (2, "ACG"), (3, "")], "id int, seq string")
    got = Counter()
    for r in tile(df, "seq", 16, 5).collect():
        got.update((r.id, r.seq[i : i + 6]) for i in range(len(r.seq) - 5))
    assert got == Counter((1, text[i : i + 6]) for i in range(len(text) - 5))


def vectors(spark, words, dim=4, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(w, i, [float(x) for x in rng.normal(size=dim)]) for i, w in enumerate(words)]
    return rows, spark.createDataFrame(rows, "kmer string, id int, vector array<double>")


def tokens_of(text, k, index, unk, strand="complement"):
    out, before = [], False
    for i in range(len(text) - k + 1):
        w = canon(text[i : i + k], strand)
        if w in index:
            out.append(index[w])
        elif not before:
            out.append(unk)
        before = w not in index
    return out


def test_tokens_brute_force(spark):
    rng = random.Random(6)
    texts = random_reads(100, rng)
    df = spark.createDataFrame(list(enumerate(texts)), "read_id int, read string")
    for extra, unk in (([], -1), (["<unk>"], 3)):
        rows, table = vectors(spark, ["AAC", "CCA", "ACG", *extra])
        index = {w: i for w, i, _ in rows}
        got = {r.read_id: r.tokens for r in tokenize(df, table, 3).collect()}
        assert got == {i: tokens_of(t, 3, index, unk) for i, t in enumerate(texts)}
    padded = [r.tokens for r in pad_tokens(tokenize(df, table, 3)).collect()]
    assert len({len(t) for t in padded}) == 1
    long = {r.read_id: r.tokens for r in tokenize(df, table, 3, min_length=30).collect()}
    assert all(long[i] == got[i] + [-2] * (30 - max(len(t), 2)) for i, t in enumerate(texts))


def test_embedding_table_and_join_agree_with_brute_force(spark):
    rng = random.Random(7)
    texts = random_reads(120, rng) + ["", "AC", "NNNNNN"]
    df = spark.createDataFrame(list(enumerate(texts)), "read_id int, read string")
    for words in (["AAC", "CCA", "ACG"], ["AAC", "CCA", "ACG", "<unk>"]):
        rows, table = vectors(spark, words)
        unit = {i: np.array(v) / np.linalg.norm(v) for _, i, v in rows}
        index = {w: i for w, i, _ in rows}
        unk = index.get("<unk>", -1)
        for strand in ("complement", "revcomp"):
            for agg, how in (("mean", np.mean), ("sum", np.sum)):
                want = {}
                for i, t in enumerate(texts):
                    vs = [unit[x] for x in tokens_of(t, 3, index, unk, strand) if x >= 0]
                    want[i] = how(vs, axis=0) if vs else np.zeros(4)
                for limit in (1 << 20, 0):
                    got = read_embedding(df, table, 3, agg, strand=strand, max_bytes=limit).collect()
                    assert all(np.allclose(r.embedding, want[r.read_id]) for r in got) and len(got) == len(texts)


def test_sentences_by_table_and_join(spark):
    table = spark.createDataFrame([("AC", [3.0, 4.0]), ("G", [0.0, 2.0]), ("<unk>", [1.0, 0.0])], "kmer string, vector array<double>")
    texts = ["AC G AC", "AC", "", "no such", None, "G <unk>  G", "T"]
    want = [[0.4, 2.6 / 3], [0.6, 0.8], [0, 0], [0, 0], [0, 0], [1 / 3, 2 / 3], [0, 0]]
    df = spark.createDataFrame(list(enumerate(texts)), "read_id int, sentence string")
    for limit in (1 << 20, 0):
        got = {r.read_id: r.embedding for r in sentence_embedding(df, table, max_bytes=limit).collect()}
        assert len(got) == 7 and all(np.allclose(got[i], w) for i, w in enumerate(want))


def test_idf(spark):
    vocab = counts(spark, [("AAC", 0), ("CCA", 0)])
    got = {r.kmer: r.idf for r in kmer_idf(vocab, counts(spark, [("AAC", 2), ("ACG", 6)])).collect()}
    assert abs(got["AAC"] - np.log(4)) < 1e-12 and got["CCA"] == 1.0


def test_numbers_of_rows_across_ranges(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice("abc") * rng.randrange(0, 3), i) for i in range(400)]
    df = spark.createDataFrame(rows, "grp string, word string, key int").repartition(7)
    got = number_rows(df, ["grp"], [F.col("word"), F.col("key")], "n").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [(r.grp, r.word, r.key) for r in sorted((r for r in got if r.grp == g), key=lambda r: r.n)] == own
        assert sorted(r.n for r in got if r.grp == g) == list(range(1, len(own) + 1))
    whole = number_rows(df, [], [-F.col("key")], "n").collect()
    assert [r.key for r in sorted(whole, key=lambda r: r.n)] == list(range(399, -1, -1)) and {r.n for r in whole} == set(range(1, 401))
    assert number_rows(df.limit(0), [], [F.col("key")], "n").count() == 0
    limited = limit_reads(df.withColumnsRenamed({"grp": "sample_id", "key": "read_id"}), 2)
    assert sorted((r.read_id for r in limited.collect() if r.sample_id == "hot")) == [r[2] for r in sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[2])][:2]
