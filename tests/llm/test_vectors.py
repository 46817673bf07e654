"""NN-descent against brute force."""

import numpy as np
import pytest

from strandframe.llm import nndescent

from . import cases

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string"


def brute(rows, limit=0.98):
    good = {}
    for i, v, label, _ in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = (label, len(x), x / np.linalg.norm(x))
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a][:2] == good[b][:2] and good[a][2] @ good[b][2] >= limit]
    top = groups = cases.groups([r[0] for r in rows if r[0] is not None], links)
    degree = {i: 0 for i in groups}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return {i: (degree[i], top[i]) for i in groups}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:160] = x[100] + rng.normal(size=(60, 16)).astype(np.float32) * 0.05  # more near copies than a list holds
    x[200:210] = x[200]  # equal vectors
    for i in range(210, 240):  # chains of near copies
        x[i] = x[i - 1] + rng.normal(size=16).astype(np.float32) * 0.12
    out = [(i, [float(v) for v in x[i]], int(i % 2 if i < 100 else 0), "clash") for i in range(400)]
    odd = [None, [], [0.0] * 16, [1.0] * 8, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15]
    out += [(400 + i, v, 0, "clash") for i, v in enumerate(odd)]
    out += [(420, out[200][1], None, "clash"), (421, [2 * v for v in out[300][1]], 0, "clash")]
    return out


def test_near_vectors(spark, rows):
    got = nndescent.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (*want[r.vec_id], want[r.vec_id][1] == r.vec_id), r.vec_id
    assert max(n for n, _ in want.values()) > 2 * nndescent.NEIGHBOURS


def test_no_vectors(spark):
    assert nndescent.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = nndescent.near_vectors(spark.createDataFrame([(None, [1.0], 0, ""), (5, None, None, "")], SCHEMA)).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got) == [(-1, 0, -1), (5, 0, 5)]


def clump(rng, center, n, cos):
    noise = rng.normal(size=(n, len(center)))
    noise -= np.outer(noise @ center, center)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return center + noise * np.sqrt(1 / cos - 1)


def test_links_between_clumps_larger_than_lists(spark):
    rng = np.random.default_rng(8)
    out, at = [], 0
    for label, sizes in enumerate([(100, 100), (300, 100, 40)]):
        first, second = np.linalg.qr(rng.normal(size=(32, 2)))[0].T
        for j, n in enumerate(sizes):
            angle = j * np.arccos(0.985)
            for v in clump(rng, np.cos(angle) * first + np.sin(angle) * second, n, 0.9996):
                out.append((at, [float(y) for y in v], label, ""))
                at += 1
    want = brute(out)
    assert want[0][0] > 150 and len({c for _, c in want.values()}) == 2
    got = nndescent.near_vectors(spark.createDataFrame(out, SCHEMA).repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_audit_sees_pairs_beside_a_hot_group(spark):
    rng = np.random.default_rng(9)
    hot = clump(rng, np.eye(32)[0], 300, 0.9996)
    pairs = [x for _ in range(40) for x in clump(rng, np.linalg.qr(rng.normal(size=(32, 1)))[0][:, 0], 2, 0.9996)]
    rows = [(i, "p", [float(y) for y in v], 50 if i < 300 else 1) for i, v in enumerate([*hot, *pairs])]
    nodes = spark.createDataFrame(rows, "node long, part string, embedding array<double>, size long")
    member = lambda linked: spark.createDataFrame([(i, 0 if i < 300 else i - i % 2) for i in range(linked)], "node long, component long")
    for linked, whole in ((300, False), (380, True)):
        links = nndescent.link_counts(nodes, member(linked), 0.98)
        recall, missed = nndescent.audit(nodes, member(linked), links, 0.98)
        assert (recall >= nndescent.RECALL, missed.isEmpty()) == (whole, whole)
    edges = {(r.a, r.b) for r in nndescent.all_edges(nodes, 0.98).collect()}
    assert cases.groups(range(380), edges) == {i: 0 if i < 300 else i - i % 2 for i in range(380)}
