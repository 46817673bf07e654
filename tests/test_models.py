"""Projection, reconstruction and the classifier benchmark against closed forms and easy cases."""

import math

import numpy as np
import pytest

from strandframe.operators import embed as E
from strandframe.operators import models as MO
from strandframe.operators import skipgram as G


@pytest.fixture(scope="module")
def shifted(spark):
    x = np.random.default_rng(3).normal(size=(60, 5))
    x[:, 2] += 10.0  # a mean far outside the plane of the components
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, embedding array<double>")
    return x, df


def test_reconstruction_error_is_the_residual_of_centred_vectors(shifted):
    x, df = shifted
    centred = x - x.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    for k in (1, 2, 4):
        want = ((centred - centred @ axes[:k].T @ axes[:k]) ** 2).sum(1)
        got = dict((r.id, r.error) for r in MO.reconstruction_error(df, ["id"], k=k).collect())
        assert [got[i] for i in range(60)] == pytest.approx(want.tolist())


def test_projection_keeps_the_largest_variance(shifted):
    x, df = shifted
    got = np.array([[r.x0, r.x1] for r in MO.project_2d(df).orderBy("id").collect()])
    largest = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.cov(got.T) == pytest.approx(np.diag(largest), abs=1e-9)


def test_word_vectors_of_words_in_one_context_are_closer(spark):
    rng = np.random.default_rng(1)
    pick = lambda words: [str(rng.choice(words)) for _ in range(12)]
    rows = [(pick(["AAA", "AAC", "AAG"]) if i % 2 else pick(["CCA", "CCC", "CCG"]),) for i in range(300)]
    sentences = spark.createDataFrame(rows, "words array<string>")
    for train in (E.kmer2vec_train, E.word2vec_train):
        got = {r.kmer: np.array(r.vector) for r in train(sentences, vector_size=16, iterations=3).collect()}
        cos = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
        assert set(got) == {"AAA", "AAC", "AAG", "CCA", "CCC", "CCG"}
        assert min(cos("AAA", "AAC"), cos("CCA", "CCG")) > max(cos("AAA", "CCC"), cos("AAG", "CCA"))


def test_word2vec_trains_in_a_task_per_core(spark, monkeypatch):
    given, plain = [], E.Word2Vec
    monkeypatch.setattr(E, "Word2Vec", lambda **options: given.append(options["numPartitions"]) or plain(**options))
    sentences = spark.createDataFrame([(["AAA", "AAC", "CCA"],)] * 20, "words array<string>")
    for least in (1, 7):
        got = E.word2vec_train(sentences, vector_size=4, iterations=1, num_partitions=least).collect()
        assert {r.kmer for r in got} == {"AAA", "AAC", "CCA"}
    assert given == [max(1, spark.sparkContext.defaultParallelism), 7]


def plain_pairs(sentences, window):
    out = {}
    for s in sentences:
        for i, a in enumerate(s or ()):
            for j, b in enumerate(s):
                if i != j and abs(i - j) <= window and a is not None and b is not None:
                    out[a, b] = out.get((a, b), 0) + window + 1 - abs(i - j)
    return out


def test_context_weights_equal_the_plain_count(spark):
    sentences = [["A", "B", "A", "C"], ["B", None, "B"], [], None, ["C"], ["A", "A", "A", "A", "A", "B"]]
    df = spark.createDataFrame([(s,) for s in sentences], "words array<string>")
    got = {(r.word, r.context): r.weight for r in G.context_weights(df, 3).collect()}
    assert got == plain_pairs(sentences, 3)


def test_skipgram_meets_its_closed_form_in_any_number_of_blocks(spark):
    n = {(0, 0): 30, (0, 1): 10, (1, 0): 10, (1, 1): 30}
    df = spark.createDataFrame([(w, c, x) for (w, c), x in n.items()], "w long, c long, weight long")
    want = [math.log(x * 80 / (40 * 40)) for x in n.values()]
    for blocks, iterations, steps in ((1, 2, 600), (2, 12, 8)):
        train = lambda rows: {
            r.id: (np.array(r.vector), np.array(r.out_vector))
            for r in G.train_pairs(rows, 4, iterations, 0.3, 1, blocks, steps, 1.0).collect()
        }
        got = train(df)
        assert [got[w][0] @ got[c][1] for w, c in n] == pytest.approx(want, abs=0.1)
        if blocks == 2:
            again = train(df.orderBy("weight", "c").repartition(3))
            assert all((got[i][0] == again[i][0]).all() and (got[i][1] == again[i][1]).all() for i in got)


def test_word_vectors_of_empty_and_lonely_words(spark):
    sentences = [(None,), ([],), (["AAA"],), (["CCC"],), (["AAA"],)]
    df = spark.createDataFrame(sentences, "words array<string>")
    got = E.kmer2vec_train(df, vector_size=3, iterations=1, min_count=1).orderBy("id").collect()
    assert [(r.kmer, r.id, len(r.vector)) for r in got] == [("AAA", 0, 3), ("CCC", 1, 3)]
    assert E.kmer2vec_train(df.limit(0), vector_size=3, iterations=1).count() == 0


def test_classifiers_separate_what_is_separable(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, float(i % 2 + rng.normal() * 0.1), float(rng.normal())) for i in range(60)]
    x = spark.createDataFrame(rows, "id_subject int, label int, `0` double, `1` double")
    folds = spark.createDataFrame([(s, i, "valid" if (i // 2 + s) % 3 == 0 else "train") for s in (0, 1) for i in range(60)], "split int, id_subject int, part string")
    got = MO.benchmark_classifiers(x, folds, ["0", "1"], models=["random_forest", "svm"], n_iter=2).collect()
    assert len(got) == 8 and {(r.model, r.fold, r.side) for r in got} == {(m, s, p) for m in ("random_forest", "svm") for s in (0, 1) for p in ("train", "test")}
    assert all(r.accuracy >= 0.9 and r.fit_seconds > 0 and r.score_seconds > 0 for r in got)


def test_the_best_of_several_draws_is_taken(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    class Draw:
        made = 0

        def __init__(self):
            Draw.made += 1
            self.good, self.fits = Draw.made == MO.DRAWS, []

        def fit(self, rows):
            self.fits.append(rows)
            return self

        def transform(self, df):
            right = F.col("label") if self.good else 1 - F.col("label")
            return df.withColumn("prediction", right).withColumn("probability", array_to_vector(F.array(1 - right, right)))

    draws = []
    monkeypatch.setattr(MO, "_estimator", lambda name, rng: draws.append(Draw()) or draws[-1])
    x = spark.createDataFrame([(i, i % 2, [float(i)]) for i in range(40)], "id_subject int, label int, features array<double>")
    folds = spark.createDataFrame([(0, i, "valid" if i >= 30 else "train") for i in range(40)], "split int, id_subject int, part string")
    got = MO.benchmark_on_embedding(x, folds, models=["svm"]).collect()
    assert [r.accuracy for r in got] == [1.0, 1.0]
    assert len({r.fit_seconds for r in got}) == 1
    # each draw is fitted on several inner splits with the same number of subjects of each label
    assert len(draws) == MO.DRAWS > 1 and len(draws[-1].fits) == MO.INNER + 1
    # after two of three splits the others cannot come up to the last one
    assert all(len(d.fits) == MO.INNER - 1 for d in draws[:-1])
    sides = [sorted((r.label, r["count"]) for r in rows.groupBy("label").count().collect()) for rows in draws[-1].fits[: MO.INNER]]
    assert sides == [[(0.0, 12), (1.0, 12)]] * MO.INNER


def test_models_score_in_a_session_that_has_observed_a_query(spark):
    from pyspark.ml.classification import LinearSVC, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    rows = spark.createDataFrame([(float(i % 2), [float(i % 2)]) for i in range(20)], "label double, f array<double>")
    rows.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 20}
    rows = rows.select("label", array_to_vector("f").alias("features"))
    for estimator in (RandomForestClassifier(numTrees=3), LinearSVC(maxIter=3)):
        assert all(r.y == r.pred for r in MO._scored(estimator.fit(rows), rows).collect())
