"""The pipeline's stages in a row, each against a plain version on what it was given; and the registered queries."""

from collections import Counter

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from strandframe.session import materialize
from tools.check import duck, rows

from . import cases

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    names = queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "packed_sequences"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages(spark):
    # ids and texts are unique here; rows with clashing columns are in the operators' tests
    given = [r[:5] for r in cases.documents() if r[0] is not None]
    given = list(dict.fromkeys(given))
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, ""))
        assert docs.columns == COLUMNS
        seen.append(({r.doc_id: r.text for r in before.collect()}, [tuple(r) for r in docs.collect()]))
    (_, good), (clean, single), (parted, left), (mixed, copies) = seen
    assert {49, 50, 51, 52, 46, 47, 48}.isdisjoint(r[0] for r in good)
    want = cases.similar(list(clean.items()), 5, 80)
    assert sorted(r[0] for r in single) == sorted(i for i, (_, c) in want.items() if c == i)
    want = cases.uncovered(list(parted.items()))
    texts = {i: w[3].decode("utf-8", "ignore") for i, w in want.items()}
    assert {r[0]: r[1] for r in left} == {i: t for i, t in texts.items() if cases.words(t)}
    assert all(r[4] == len(r[1]) for r in left)
    assert set(r[0] for r in copies) <= set(mixed) and max(Counter(r[0] for r in copies).values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in copies}


def test_an_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""))
    assert docs.count() == 0


def test_mixing_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = queries()["op7_source_mixing"](spark, sf).toPandas()
    assert rows(got) == rows(duck(sf).execute(oracle_sql()["op7_source_mixing"]).df())
