"""Operators 11 to 13 against plain versions, on rows with nulls, empties, copies and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from strandframe.llm import alignment, ranked, windows

from . import cases

ODD = [" leading", "trailing ", "a  b   c", "a▁b", "<s> x </s>", "<0x0A> <|endoftext|>", "\n\n x\t y", " no　break", "\x1c\x85 x", "é é ﬁ ①", "🙂🙂 ok", "\0 nul", "1234567 89'll don't", "x" * 300, "日本語" * 50 + " end"]
ROWS = cases.documents() + [(100 + i, t, "en", "a", len(t), "x", -1.0, 7) for i, t in enumerate(ODD)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, cases.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def plain_alignment(text, aligner):
    """(ids a, ids b, groups, links) of a whole text, or None."""
    if not text:
        return None
    whole = (" " + text).encode()
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    ends = []
    for ids, spelled in ((a, aligner.bytes_a), (b, aligner.bytes_b)):
        parts = [spelled[i] for i in ids]
        if b"".join(parts) != whole:
            return None
        ends.append(dict(zip(np.cumsum([len(x) for x in parts]).tolist(), range(1, len(ids) + 1))))
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        groups.append(",".join(map(str, a[i : ends[0][cut]])) + "|" + ",".join(map(str, b[j : ends[1][cut]])))
        i, j = ends[0][cut], ends[1][cut]
        links.append((a[i - 1], b[j - 1]))
    return a, b, groups, links


def test_alignment_equals_whole_texts(docs, empty):
    aligner = alignment.Aligner()
    plain = {t: plain_alignment(t, aligner) for t in {r[1] for r in ROWS}}
    pairs, best = Counter(), Counter()
    for r in ROWS:
        pairs.update(plain[r[1]][3] if plain[r[1]] else [])
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    want = []
    for r in ROWS:
        p = plain[r[1]]
        if p is None:
            want.append((r[0], 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = p
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            want.append((r[0], len(a), len(b), len(groups), len(links), sum(pairs[x] == best[x[1]] for x in links), sum(pairs[x] for x in links), digest))
    got = alignment.align(docs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert plain["a▁b"] is None and plain[" leading"] is not None
    assert alignment.align(empty).count() == 0


def test_pairs_are_bounded_by_the_vocabularies(docs):
    texts = alignment.aligned_texts(docs, groups=True)
    assert {"text", "groups"} <= set(texts.columns)
    spelled = {r.text: r.groups for r in texts.collect()}
    assert len(spelled) == len({r[1] for r in ROWS if r[1]})
    aligner = alignment.Aligner()
    assert spelled["two words"] == ";".join(plain_alignment("two words", aligner)[2])
    for r in alignment.pair_counts(texts).collect():
        x, y = aligner.bytes_a[r.pair >> 16], aligner.bytes_b[r.pair & 0xFFFF]
        assert x.endswith(y) or y.endswith(x)


def test_a_small_memory_changes_nothing():
    text = [" ".join(random.Random(i).choices(cases.VOCABULARY, k=30)) for i in range(20)]
    wanted = [alignment.units(x) for x in text]
    aligner, forgetful = alignment.Aligner(), alignment.Aligner(cache=5)
    assert aligner.look_up(wanted) == [forgetful.look_up([x])[0] for x in wanted]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items):
    found = [(r[0], TERM.findall(cases.lower(r[1]))) for r in rows]
    n = sum(bool(t) for _, t in found)
    length = sum(len(t) for _, t in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, ts in found:
            tf, m = Counter(ts), 100 - 90 + (90 * len(ts) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(TERM.findall(cases.lower(text))))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, k, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:10], 1)]
    return out


ITEM = "item_id long, text string, doc_id long, score string"


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(3)
    texts = [cases.prose(rng, n) for n in (1, 3, 10, 40, 200)] + [ROWS[12][1], ROWS[33][1], "changed balis", "CHANGED", "nothing here", "", None, " .!", "日本語の文 naïve \0", "x" * 300]
    rows = [(i, t, 1, "y") for i, t in enumerate(texts)] + [(None, "two words", 1, "y"), (2, texts[2], 1, "y")]
    return rows, spark.createDataFrame(rows, ITEM)


@pytest.mark.parametrize("options", [{}, {"segment": 7, "block": 3, "short": 0.0}, {"segment": 40, "block": 4, "short": 0.3, "block_terms": 30}, {"short": 1.0, "block": 1}])
def test_search_equals_scoring_all(docs, items, options):
    rows, df = items
    got = ranked.search(docs, df, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    want = plain_search(ROWS, [(r[0], r[1] or "") for r in rows])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_search_of_nothing(docs, empty, items, spark):
    _, df = items
    assert ranked.search(empty, df).count() == 0
    assert ranked.search(docs, spark.createDataFrame([], ITEM)).count() == 0


def test_skipping_reads_fewer_blocks(monkeypatch):
    # one rare term in the first block; the frequent term cannot lift a document of another block to its score
    ids = list(range(2000))
    segment = ranked.Segment(ranked.Segment.of(ids, [10] * 2000, [[0, 1] if i < 20 else [1] for i in ids]))
    segment.weigh(2000, 20000, 100)
    seen = []
    plain = ranked.accumulate
    monkeypatch.setattr(ranked, "accumulate", lambda lists: seen.append(sum(len(d) for d, _ in lists)) or plain(lists))
    best = ranked.best_of(segment, [(0, 5000), (1, 1)])
    assert [d for d, _ in best] == list(range(10))
    # the 20 short postings, then the same as accumulators of the only block not skipped
    assert seen == [20, 20]


def plain_windows(rows, width):
    found = [(r[0], cases.words(r[1])) for r in rows]
    first = {}
    for doc_id, ws in found:
        for i in range(len(ws) - width + 1 if doc_id is not None else 0):
            key = tuple(ws[i : i + width])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, ws in found:
        gone = set()
        for i in range(len(ws) - width + 1 if doc_id is not None else 0):
            if first[tuple(ws[i : i + width])] < doc_id:
                gone.update(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("options", [{}, {"window": 7, "chunk": 50}, {"window": 20, "chunk": 1}, {"chunk": 300, "cells_per_print": 1}])
def test_removed_words_equal_all_windows(docs, options):
    got = windows.removed_words(docs, texts=True, **options)
    want = plain_windows(ROWS, options.get("window", 50))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 500


def test_chunks_are_written_a_few_at_a_time(docs, monkeypatch):
    # a row group is held by its writer and its reader, and a chunk has megabytes
    written, plain = [], windows.materialize
    monkeypatch.setattr(windows, "materialize", lambda df, **options: written.append(plain(df, **options)) or written[-1])
    got = windows.removed_words(docs.coalesce(1), chunk=1)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in written[0].inputFiles()]
    sizes = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(sizes) > 50 and max(sizes) <= 8
    assert got.count() == len(ROWS)


def test_removed_words_of_nothing(empty):
    assert windows.removed_words(empty).count() == 0


def test_a_full_sketch_loses_no_window(docs, monkeypatch):
    # one cell a row: every window is estimated as repeated, and the exact pass decides
    monkeypatch.setattr(windows, "TILE_BITS", (1, 1))
    monkeypatch.setattr(windows, "CELLS", 0)
    got = windows.removed_words(docs, window=20, cells_per_print=0).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((w[:4] for w in plain_windows(ROWS, 20)), key=repr)


def test_gaps_go_on():
    x = np.array([0, 1, 65534, 65535, 65536, 200000, 200000 + 65535, 10**7], np.uint64)
    assert windows.unpacked(windows.packed(x)).tolist() == x.tolist()


def test_estimates_are_never_below_counts():
    words = np.random.default_rng(4).integers(0, 5, 4000)
    text = b" ".join(b"w%d" % i for i in words) + b"\n"
    w = windows.Windows(6)
    half = len(text) // 2 + text[len(text) // 2 :].index(b" ") + 1
    w.load([1, 2], np.array([half, len(text)]), text)
    prints = w.fingerprints()
    parts = list(windows.partition_sketch(w, prints, 12, 12))
    answers = [{"row": r, "tile": t, "marks": twice} for r, t, _, twice in parts]
    high, low = w.hashes(w.valid)
    seen = {}
    for h, x, d in zip(high.tolist(), low.tolist(), w.doc[w.valid].tolist()):
        seen.setdefault((h, x), set()).add(d)
    both = np.array([len(seen[h, x]) > 1 for h, x in zip(high.tolist(), low.tolist())])
    assert both.any() and not (both & ~windows.estimated(w, prints, answers, 12, 12)).any()
