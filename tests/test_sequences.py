"""Literal values of the sequence functions, and their invariants."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import seq as S
from strandframe.functions.align import align_scores, needleman_wunsch
from strandframe.operators.context import context_counts, context_pairs, context_probability, cooccurrence, orient

lit = F.lit


def test_codes(values):
    assert values(S.kmer_to_int(lit("ATAG")), S.kmer_to_int(lit("ACC"))) == (140, 20)
    assert values(S.kmer_to_int(lit("ANC"))) is None
    assert values(S.int_to_kmer(lit(140), 4), S.int_to_kmer(lit(0), 5)) == ("ATAG", "AAAAA")
    word = "".join(random.Random(1).choice("ACGT") for _ in range(31))
    assert values(S.int_to_kmer(S.kmer_to_int(lit(word)), 31)) == word


def test_flips(values):
    assert values(S.reverse_complement(lit("CGAGCT"))) == "AGCTCG"
    assert values(S.complement(lit("GTT")), S.complement(lit("ACGTN"))) == ("CAA", "TGCAN")
    got = values(*[S.canonical(lit(w)) for w in ("GATACA", "TAGGA", "AGATACCA", "CGAGCT", "NAC")])
    assert got == ("TGTATC", "TCCTA", "AGATACCA", "CGAGCT", "GTN")
    assert values(S.canonical(lit("GATACA"), "complement")) == "CTATGT"


def test_kmers(values):
    plain = lambda w, k, s=1: values(S.kmers(lit(w), k, s, strand=None))
    assert plain("GTATAG", 2) == ["GT", "TA", "AT", "TA", "AG"]
    assert plain("AATTGCGCCA", 3, 2) == ["AAT", "TTG", "GCG", "GCC"]
    assert plain("AC", 3) == [] and plain("", 3) == []
    assert values(S.kmers(lit("ACNTA"), 2, remove_unk=True)) == ["AC", "TA"]
    assert values(S.kmers(lit("NNNN"), 2, remove_unk=True)) == []


def test_sentences(values):
    assert values(S.kmer_sentence(lit("ACGTACGT"), 3, 5)) == "ACG CGT ACG".replace("ACG CGT ACG", "ACG CGT TAC")
    assert values(S.kmer_sentence_unk(lit("ACNNNAC"), 2)) == "AC <unk> AC"
    assert values(S.kmer_sentence_unk(lit("ACNNNAC"), 2, remove_unk=True)) == "AC AC"
    assert values(S.kmer_sentence_unk(lit("CCCCCAA"), 3, 3, "b")) == "CCC CCA"
    assert values(S.kmer_sentence_unk(lit("CCCCCAA"), 3, 3, "e")) == "CCC CAA"


def test_rates_and_pieces(values):
    assert values(S.gc_rate(lit("GAGTCGGCGGCCGCCTAGGTTCCC")), S.gc_rate(lit("CTAGGCTT"))) == (0.75, 0.5)
    assert values(S.gc_rate(lit(""))) is None
    assert values(S.acgt_length(lit("ACGTNRacgt"))) == 4
    assert values(S.fragments(lit("ACNNNGTNACGTA"), 4)) == ["ACGT", "NACG"]
    assert values(S.hamming(lit("ACGT"), lit("ACCA"))) == 2
    letters = random.Random(2)
    for n in (0, 1, 14, 15, 16, 30, 61):
        a, b = ("".join(letters.choice(S.IUPAC) for _ in range(n)) for _ in range(2))
        assert values(S.hamming(lit(a), lit(b))) == sum(x != y for x, y in zip(a, b))


def test_ids(values):
    assert values(S.clean_anonymous_id(lit("@S0-R1-2")), S.mate_key(lit("x/1")), S.mate_key(lit("x/3"))) == ("S0-R1", "x", "x/3")
    assert values(S.pair_suffix(lit("a/b/2")), S.pair_suffix(lit("ab"))) == ("2", "ab")


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("GTA", "CAT", ("ATG", "TAC")),
        ("ATA", "GTA", ("ATA", "GTA")),
        ("GTA", "CAA", ("GTA", "CAA")),
        ("GA", "TATAT", ("AT", "ATATC")),
        ("GATA", "TAT", ("ATAT", "ATC")),
    ],
)
def test_orient_pair(values, a, b, want):
    assert tuple(values(S.orient_pair(lit(a), lit(b)))) == want


def reads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "read string")


def pairs(df):
    return sorted((r.kmer, r.context) for r in df.collect())


def test_contexts(spark):
    # Expected pairs of the public unit tests
    one = [("AA", "CT"), ("AA", "CG"), ("AC", "TC"), ("CT", "AA"), ("CT", "CG"), ("TC", "AC"), ("CG", "CT"), ("CG", "AA")]
    assert pairs(context_pairs(reads(spark, "AACTCG"), 2, 2, 2)) == sorted(one)
    two = [("AA", "CT"), ("AA", "CG"), ("TC", "AC"), ("TC", "GG")]
    assert pairs(context_pairs(reads(spark, "AACTCGG"), 2, 2, 2, s=3)) == sorted(two)
    three = [
        ("AA", "CTC"), ("AA", "GGA"), ("AC", "TCG"), ("CT", "CGG"), ("TC", "AAC"),
        ("TC", "GGA"), ("CG", "ACT"), ("GG", "CTC"), ("GA", "TCG"), ("GA", "AAC"),
    ]
    assert pairs(context_pairs(reads(spark, "AACTCGGA"), 2, 3, 2)) == sorted(three)
    turned = [
        ("AC", "TA"), ("CG", "TA"), ("AG", "TC"), ("GT", "TA"), ("CG", "AC"), ("CT", "GA"), ("CG", "GT"), ("CG", "TA"),
    ]
    assert pairs(orient(context_pairs(reads(spark, "TAGTCG"), 2, 2, 2))) == sorted(turned)


def test_context_counts(spark):
    got = context_counts(reads(spark, "ATGCGGT", "GGATTC"), 3, 3, 1).collect()
    assert sorted(map(tuple, got)) == [("ACC", "GCA", 1), ("ATG", "CGG", 1), ("GGA", "TTC", 1)]
    p = context_probability(spark.createDataFrame([("ATG", "TTT", 2), ("CCC", "TGA", 4)], "kmer string, context string, count bigint"))
    assert {r.kmer: r.probability for r in p.collect()} == {"ATG": 2 / 6, "CCC": 4 / 6}


def test_cooccurrence_brute_force(spark):
    rng = random.Random(3)
    lines = [[rng.choice("abcd") for _ in range(rng.randrange(0, 9))] for _ in range(40)]
    want = {}
    for words in lines:
        for p, a in enumerate(words):
            for d in range(1, 4):
                if p + d < len(words):
                    b = words[p + d]
                    want[a, b] = want.get((a, b), 0) + 1 / d
                    want[b, a] = want.get((b, a), 0) + 1 / d
    df = spark.createDataFrame([(w,) for w in lines], "words array<string>")
    got = {(r.a, r.b): r.weight for r in cooccurrence(df, "words", 3).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def needle(a, b):
    score = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    score[:, 0], score[0, :] = -np.arange(len(a) + 1), -np.arange(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            score[i, j] = max(score[i - 1, j - 1] + (1 if x == y else -1), score[i - 1, j] - 1, score[i, j - 1] - 1)
    return int(score[-1, -1])


def test_alignment_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 7)))
    cases = [(word(), word()) for _ in range(200)]
    want = [needle(a, b) for a, b in cases]
    assert align_scores([a for a, _ in cases], [b for _, b in cases]).tolist() == want
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)] + [(len(cases), None, "A")], "i int, a string, b string")
    got = [r.s for r in df.select("i", needleman_wunsch("a", "b").alias("s")).orderBy("i").collect()]
    assert got == want + [None]


def test_scores_of_long_and_foreign_words_equal_the_recurrence():
    import random

    rng = random.Random(3)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    cases = [(word(rng.randrange(0, 130), x), word(rng.randrange(0, 130), x)) for x in ("ACGTN", "ACé𝄞") for _ in range(20)]

    def plain(a, b):
        last = [-j for j in range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            now = [-i]
            for j, y in enumerate(b, 1):
                now.append(max(last[j - 1] + (1 if x == y else -1), last[j] - 1, now[-1] - 1))
            last = now
        return last[-1]

    assert align_scores([a for a, _ in cases], [b for _, b in cases]).tolist() == [plain(*c) for c in cases]


def test_pairs_are_aligned_where_they_are(spark):
    from strandframe.plans.sequences import aligned

    got = aligned(spark.createDataFrame([("x", "ACGT", "ACT"), ("y", "ACGT", "ACT"), ("z", None, "A")], "read_id string, a string, b string"))
    assert sorted(map(tuple, got.collect())) == [("x", 2), ("y", 2)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
