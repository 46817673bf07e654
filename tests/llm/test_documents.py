"""Operators on documents against plain versions, on rows with nulls, empties, copies and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandframe.llm import brown, licenses, mixing, packing, quality, shingle_join, suffix, tokens
from strandframe.llm.chunks import pieces

from . import cases

ROWS = cases.documents()
TEXT = {r[0]: r[1] for r in ROWS if r[0] is not None}
UNIQUE = sorted(TEXT.items())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def ids():
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: np.array(coder.encode(t or "", add_special_tokens=False).ids, "<u4") for i, t in UNIQUE}


def test_quality_counts_and_outliers(docs, empty):
    got = quality.quality(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            n, chars, symbols, lines, repeats = want = cases.base_counts(TEXT[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
            assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {46, 47, 48, 49, 50, 51, 52}
    assert set(range(43)) | {53, 55} <= kept
    assert quality.quality(empty).count() == 0
    good = quality.good_documents(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept


def test_chi2():
    # closed form for two degrees of freedom
    assert quality.chi2_cdf(3.0, 2) == pytest.approx(1 - math.exp(-1.5))
    assert quality.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05))


def test_outliers_found_in_a_contaminated_group(spark):
    # a quarter of a group is junk of one kind: plain mean and covariance would take it in
    rng = np.random.default_rng(1)
    plain = [(i, cases.prose(random.Random(i), int(rng.integers(40, 200))), "en", "a") for i in range(200)]
    junk = [(i, " ".join(w.upper() + "!!" for w in cases.prose(random.Random(i), 90).split()), "en", "a") for i in range(200, 260)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[i] for i in range(200, 260))


def test_class_model(docs, empty):
    setting = brown.Setting(head=30, classes=4, endings=3, rounds=3, heavy=20)
    got = brown.score(docs, setting).collect()
    assert len(got) == len(ROWS)
    train = Counter()
    for doc_id, *_ in ROWS:
        text = next(r[1] for r in ROWS if r[0] == doc_id)
        if doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2:
            train.update([*cases.words(cases.lower(text)), ""])
    total, types = sum(train.values()), len(train)
    for r in got:
        if r.doc_id is None:
            continue
        found = [*cases.words(cases.lower(TEXT[r.doc_id])), ""]
        base = sum(math.log10((train[w] + 1) / (total + types + 1)) for w in found)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(found), sum(train[w] > 0 for w in found), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base) and r.score < 0
    # the same model whatever share of the counts is joined
    other = brown.score(docs, brown.Setting(head=30, classes=4, endings=3, rounds=3, heavy=10_000)).collect()
    assert sorted((r.doc_id or -1, round(r.score, 6)) for r in got) == sorted((r.doc_id or -1, round(r.score, 6)) for r in other)
    assert brown.score(empty, setting).count() == 0


def test_class_probabilities_sum_to_one(docs):
    setting = brown.Setting(head=30, classes=4, endings=3, rounds=3, heavy=10_000)
    model, counts = brown.fit(docs.select("doc_id", "text"), setting)
    count = {r.word: r.c for r in counts.collect()}
    head, s = model.words[: model.setting.head], model.setting
    own = lambda w: int(model.kind[head.index(w)]) if w in head else s.kinds - 1 if w == "" else s.classes + brown.ending(w, s.endings)
    after = lambda k, w: 10 ** (model.log_next[k, own(w)] - model.log_class[own(w)]) * (count.get(w, 0) + brown.ADD)
    unknown = {}
    for w in (f"u{i}" for i in range(200)):
        if w not in count:
            unknown.setdefault(brown.ending(w, s.endings), w)
    assert len(unknown) == s.endings
    for k in {own(w) for w in count} | {s.classes + e for e in range(s.endings)}:
        # after any class: all known words and the end, and an unknown word of each ending
        assert sum(after(k, w) for w in [*count, *unknown.values()]) == pytest.approx(1.0, abs=1e-9)
    # scores are the sums of the same probabilities, text by text
    for r in brown.score(docs, setting).collect():
        if r.doc_id is not None:
            found = ["", *cases.words(cases.lower(TEXT[r.doc_id])), ""]
            assert r.score == pytest.approx(sum(math.log10(after(own(a), b)) for a, b in zip(found, found[1:])))


def test_an_empty_class_takes_no_probability():
    setting = brown.Setting(head=2, classes=3, endings=1)
    matrix = np.array([[0, 2, 0, 1, 1], [3, 0, 0, 0, 0], [0, 0, 0, 0, 0], [1, 0, 0, 0, 0], [0, 1, 0, 0, 0]], float)
    n_types = np.array([1, 1, 0, 1, 1])
    log_next, log_class = brown.probabilities(matrix, n_types, setting)
    sums = matrix.sum(0) + brown.ADD * (n_types + np.array([0, 0, 0, 1, 0]))
    full = n_types > 0
    assert (10 ** log_next[:, full] * sums[full] / 10 ** log_class[full]).sum(1) == pytest.approx(np.ones(5))
    assert np.isneginf(log_next[:, 2]).all() and np.isfinite(log_class).all()


def test_clustered_words_grow_with_the_corpus(spark):
    few = spark.createDataFrame([(f"w{i}", 10) for i in range(100)] + [("", 50)], "word string, c long")
    assert brown.head_size(few, brown.Setting(head=30)) == 80
    assert brown.head_size(few, brown.Setting(head=90)) == 90
    assert brown.head_size(few.limit(0), brown.Setting(head=7)) == 7 and brown.HEAD >= 20_000


def test_exchange_finds_the_better_class():
    # two kinds of words that alternate: x y x y; z behaves like x and starts in y's class
    matrix = np.array([[0.0, 50.0, 0.0], [60.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    after, before = np.array([0.0, 10.0, 0.0]), np.array([0.0, 10.0, 0.0])
    matrix[1, 1] += 20.0
    assert brown.best_class(1, after, before, 0.0, matrix, 2) == 0


def test_packing(docs, empty, ids):
    got = packing.pack(docs, 256).collect()
    rows = Counter()
    for r in got:
        if r.doc_id is not None:
            whole = np.append(ids[r.doc_id], packing.END).astype("<u4")
            assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(whole)
            rows[r.doc_id] += r.length
    assert all(rows[i] == (len(x) + 1) * (2 if i == 12 else 1) for i, x in ids.items())
    spans = {}
    for r in got:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padding = 0
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
        padding += 0 if at & (at - 1) == 0 else 256 - at
    assert padding < 0.08 * sum(r.length for r in got)
    assert packing.pack(empty).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(40):
        at = np.concatenate(([0], np.cumsum(rng.integers(1, 9, rng.integers(1, 14)))))
        cost = rng.integers(0, 6, len(at))
        length = 16
        pad = lambda n: 0 if n & (n - 1) == 0 else length - n
        best = [0] + [10**9] * (len(at) - 1)
        for i in range(1, len(at)):
            best[i] = cost[i] + min(best[j] + pad(int(at[i] - at[j])) for j in range(i) if at[i] - at[j] <= length)
        cuts = packing.best_cuts(at, cost, length)
        price = {int(a): int(c) for a, c in zip(at, cost)}
        assert cuts[0] == 0 and cuts[-1] == at[-1]
        assert sum(pad(int(b - a)) + price[int(b)] for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_pieces_join_to_the_text():
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*(t or "" for t in TEXT.values()), " a  b", "x \n y\n\n z", "a  b \nc", "don't 's  's", "\x1c a\x85 b"]:
        found = pieces(text)
        assert "".join(found) == text
        whole = coder.encode(text, add_special_tokens=False).ids
        assert [i for p in found for i in coder.encode(p, add_special_tokens=False).ids] == whole


def test_token_counts(docs, empty, ids):
    for heavy in (10, 100_000):
        got = tokens.token_counts(docs, limit=100, heavy=heavy).collect()
        assert len(got) == len(ROWS)
        for r in got:
            if r.doc_id is not None:
                n = len(ids[r.doc_id])
                assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((TEXT[r.doc_id] or "").encode()), n, n > 100)
    assert tokens.token_counts(empty).count() == 0


def test_license_rules(spark, empty):
    texts = [
        "This work is licensed under the GNU General Public License, version 3.",
        "All rights reserved. all RIGHTS reserved",
        "Licensed under CC BY-NC 4.0. cc by cc by",
        "See the Apache License, Version 2.0, or SPDX-License-Identifier: MIT License",
        "no such words, reserved",
        None,
        "",
    ]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    view = lambda i: (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels)
    assert view(0) == (12, 1, 7, 7, "gpl", "gpl,gpl-3.0")
    assert view(1) == (6, 2, 0, 3, "reserved", "reserved")
    assert view(2) == (11, 3, 2, 9, "cc-by", "cc-by,cc-by-nc")
    assert view(3)[5] == "apache-2.0,mit"
    assert view(4) == (4, 0, None, None, "", "")
    assert view(5) == view(6) == (0, 0, None, None, "", "")
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].score == 0
    assert licenses.license_labels(empty).count() == 0


def test_every_rule_matches_only_texts_with_its_keywords():
    scanner, found = licenses.Scanner(), licenses.rules()
    assert len(found) > 300 and len({r.pattern for r in found}) == len(found)
    # the inner of two detections is suppressed
    line = b" released under the gnu general public license version 3 "
    assert [x[2] for x in scanner.detections(line)] == ["gpl-3.0"]


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS) and mixing.mix(empty).count() == 0
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r.size == len(cases.words(r.text)) and 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(x for x in size if x is not None) + [None]
    weight = {x: [1, 2, 3][i % 3] for i, x in enumerate(names)}
    left, open_ = float(sum(size.values())), set(names)
    want = {}
    while open_:
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] > 3 * size[x]}
        if not full:
            want |= share
            break
        for x in full:
            want[x] = 3 * size[x]
            left -= want[x]
        open_ -= full
    for x in names:
        assert target[x] == pytest.approx(want[x]) and abs(taken[x] - target[x]) <= 0.5 + 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)
    copies = Counter(r.doc_id for r in mixing.mixed_copies(docs).collect())
    for r in got:
        if r.doc_id not in (None, 12):
            assert copies[r.doc_id] == math.ceil(r.taken / r.size) if r.size else not copies[r.doc_id]


def test_repeated_passages(docs, empty):
    want = cases.uncovered(UNIQUE)
    got = suffix.digests(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is not None:
            size, gone, spans, left = want[r.doc_id]
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, gone, spans, hashlib.sha256(left).hexdigest()), r.doc_id
    assert sum(w[1] for w in want.values()) > 2000
    # seven batches or more: three levels, merged twice
    small = sum(len((t or "").encode()) for _, t in UNIQUE) // 7
    assert sorted(map(repr, suffix.digests(docs, batch_bytes=small).collect())) == sorted(map(repr, got))
    assert suffix.digests(empty).count() == 0
    left = {r.doc_id: r.text for r in suffix.without_repeats(docs).collect()}
    assert all(left[i] == w[3].decode("utf-8", "ignore") for i, w in want.items() if i in left and i != 49)
    assert 44 not in left and 45 not in left and 52 in left


def test_ngram_join(docs, empty):
    for width, percent in ((3, 90), (5, 80)):
        want = cases.similar(UNIQUE, width, percent)
        got = shingle_join.similar_documents(docs, width, percent).collect()
        assert len(got) == len(ROWS)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert any(v[1] != k for k, v in want.items() if 30 <= k < 42)
    assert shingle_join.similar_documents(empty).count() == 0
    kept = [r.doc_id for r in shingle_join.one_of_each(docs).collect()]
    assert sorted(x for x in kept if x is not None) == [i for i in sorted(want) if want[i][1] == i] and None in kept


def test_ngram_join_of_a_large_group(spark, monkeypatch):
    # lists above the bound go through leaders, then through what is left apart
    monkeypatch.setattr(shingle_join, "HOT", 3)
    rows = [(i, t) for i, t in UNIQUE if 28 <= i < 46]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 2):
        monkeypatch.setattr(shingle_join, "ROUNDS", rounds)
        got = {r.doc_id: r.component_id for r in shingle_join.similar_documents(df, 3, 90).collect()}
        assert got == {i: c for i, (_, c) in cases.similar(rows, 3, 90).items()}


def test_brown_scores_do_not_depend_on_the_parts(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(i % 5 + 1)) + " É\tw1") for i in range(30)] + [(30, None), (31, ""), (None, "w1 w2"), (31, "rare Rare RARE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    setting = brown.Setting(head=5, classes=2, endings=2, rounds=1, heavy=6)
    plain = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in brown.score(docs, setting).collect())
    whole = plain()
    assert len(whole) == len(rows)
    monkeypatch.setattr(brown, "PART", 20)
    assert plain() == whole


def test_brown_rounds_add_up_a_unit_where_its_counts_are(spark, monkeypatch):
    monkeypatch.setattr(brown, "FOLDS", 3)
    monkeypatch.setattr(brown, "STRIP", 4)
    monkeypatch.setattr(brown, "FLUSH", 20)
    setting = brown.Setting(head=6, classes=2, endings=2)
    rng, kind = np.random.default_rng(0), np.array([0, 1, 0, 1, 1, 0, 2, 3, 4])
    counts = {(int(a), int(b)): int(rng.integers(1, 2**40)) for a, b in rng.integers(0, 9, (60, 2))}
    pairs = spark.createDataFrame([(a * setting.units + b, n) for (a, b), n in counts.items()], "code long, n long").repartition(4)
    strips = brown.neighbours(pairs, setting)
    assert strips.select("fold", F.spark_partition_id()).distinct().count() == 3
    rows = brown.profiles(strips, spark.sparkContext.broadcast(kind), setting).collect()
    want, k = {}, setting.kinds
    for (a, b), n in counts.items():
        cells = [(a, kind[b]), (b, k + kind[a])] + [(a, 2 * k)] * (a == b)
        for unit, cell in cells:
            want[unit, int(cell)] = want.get((unit, int(cell)), 0) + n
    assert {(r.unit, c): n for r in rows for c, n in zip(r.cells, r.n)} == want
    # a row a unit, not one a neighbour
    assert len(rows) == len({r.unit for r in rows})


def test_good_documents_work_out_the_statistics_once_a_row(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i % 7} " * 8, "en", None) for i in range(40)], "doc_id long, text string, lang string, source string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # windows of words are hashed by this expression alone
    assert plan(quality.good_documents(docs)).count("sequence(0") == plan(quality.statistics(docs)).count("sequence(0") > 0
