"""Operator 3: near-duplicate embeddings by NN-descent."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import components, group_key

LIMIT = 0.98
NEIGHBOURS = 8
TABLES = 8
BITS = 24
BUCKET = 128
BLOCK = 512
ROUNDS = 4
SALTS = 16
SAMPLE = 256
RECALL = 0.98
ENLARGED = 2
#: Nodes of a small group.
SMALL = 32


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(vectors: DataFrame) -> DataFrame:
    """Adds ``part``, the group within which vectors can link (label and length), and ``node``, one per distinct
    vector of a part; both null for rows that link with nothing."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    fine = F.coalesce(fine & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = rows.withColumn("part", F.when(fine, F.concat(group_key(F.col("label")), F.lit("/"), F.size("embedding"))))
    return rows.withColumn("node", F.when(fine, F.xxhash64("part", "embedding")))


def signatures(nodes: DataFrame, turn: int = 0) -> DataFrame:
    """Adds ``signs``: per table, ``BITS`` signs of random projections, others in each turn."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            signs = []
            for row in batch.column(1).to_pylist():
                x = np.array(row, np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng((len(x), turn)).normal(size=(len(x), TABLES * BITS))
                bits = (x / np.abs(x).max() @ planes[len(x)] > 0).reshape(TABLES, BITS)
                signs.append((bits << np.arange(BITS)).sum(1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signs, pa.list_(pa.int64()))], ["node", "signs"])

    return nodes.join(nodes.select("node", "embedding").mapInArrow(run, "node long, signs array<long>"), "node")


def nearest(k: int):
    """Per group of rows (node, embedding, component): each node's ``k`` nearest of the group outside its component."""

    def run(group: pa.Table) -> pa.Table:
        ids, x = group.column("node").to_numpy(), matrix(group.column("embedding"))
        near = x @ x.T
        component = group.column("component").to_numpy()
        near[component[:, None] == component[None]] = -2
        m = min(k, len(ids) - 1)
        if m < 1:
            return pa.table({"node": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        top = np.argpartition(-near, m - 1, axis=1)[:, :m]
        cos = np.take_along_axis(near, top, 1).ravel()
        other = cos > -1.5
        return pa.table({"node": np.repeat(ids, m)[other], "other": ids[top.ravel()][other], "cos": cos[other]})

    return run


EDGES = "node long, other long, cos double"


def best(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest of each node's candidates; a node has a bounded number of them."""
    rows = candidates.groupBy("node", "other").agg(F.max("cos").alias("cos"))
    order = Window.partitionBy("node").orderBy(F.desc("cos"), "other")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def first_graph(nodes: DataFrame, k: int, turn: int = 0) -> DataFrame:
    """Neighbour lists from groups of about ``BUCKET`` nodes that agree in signs of random projections.

    The number of signs follows the size of the label. Groups that are still larger, such as many
    near copies, are split by a hash that differs between the tables.
    """
    sizes = nodes.groupBy("part").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(BITS), F.ceil(F.log2(F.col("n") / BUCKET)).cast("int")))
    rows = signatures(nodes, turn).join(sizes, "part").select("part", "node", "component", "embedding", bits.alias("bits"), F.posexplode("signs").alias("table", "sign"))
    rows = rows.withColumn("sign", F.col("sign").bitwiseAND(F.expr("shiftleft(1L, bits) - 1")))
    key = ["part", "table", "sign"]
    full = rows.groupBy(*key).agg(F.count("*").alias("m"))
    rows = rows.join(full, key)
    rows = rows.withColumn("split", F.pmod(F.xxhash64("table", "node"), F.ceil(F.col("m") / (2 * BUCKET))))
    found = rows.select(*key, "split", "node", "component", "embedding").groupBy(*key, "split").applyInArrow(nearest(k), EDGES)
    return best(found, k)


def refined(nodes: DataFrame, graph: DataFrame, k: int, own: DataFrame | None = None) -> DataFrame:
    """One round of NN-descent: neighbours of a node, in both directions, are held against each other.

    A node's reverse neighbours are cut to its ``k`` nearest (in two steps, so that a node in very
    many lists is not sorted in one task): the usual bound of the method; recall is audited later.
    Lists ``own`` are followed too.
    """
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "cos").withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)))
    for part in (["node", "salt"], ["node"]):
        order = Window.partitionBy(*part).orderBy(F.desc("cos"), "other")
        back = back.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    around = graph.select("node", "other").unionByName(back.select("node", "other"))
    if own is not None:
        around = around.unionByName(own.select("node", "other"))
    around = around.unionByName(around.select("node", F.col("node").alias("other"))).distinct()
    members = around.withColumnsRenamed({"node": "center", "other": "node"}).join(nodes.select("node", "component", "embedding"), "node")
    found = members.select("center", "node", "component", "embedding").groupBy("center").applyInArrow(nearest(k), EDGES)
    return best(found.unionByName(graph), k)


def settled(nodes: DataFrame, graph: DataFrame, k: int, own: DataFrame | None = None) -> DataFrame:
    """The graph after rounds of NN-descent, until few lists still change."""
    for _ in range(ROUNDS):
        new = materialize(refined(nodes, graph, k, own))
        moved = new.join(graph, ["node", "other"], "left_anti").count()
        graph = new
        if moved <= 0.001 * max(1, graph.count()):
            break
    return graph


def across(nodes: DataFrame, graph: DataFrame, edges: DataFrame, limit: float, k: int) -> DataFrame:
    """(node, component) of ``edges`` (a, b) and of links that full lists of ``graph`` had no room for.

    A link is in neither list of its nodes only if both lists are full of links. Such nodes are searched
    again, with lists of nodes outside their component alone; what is found joins components, and so on
    until nothing new is found. A list that is full again joined k others and is searched in the next round.
    """
    full = graph.where(F.col("cos") >= limit).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    full = materialize(nodes.drop("component").join(full.select("node"), "node", "left_semi"))
    for turn in count(1):
        member = materialize(components(edges))
        rows = full.join(member, "node")
        several = rows.groupBy("part").agg((F.min("component") != F.max("component")).alias("several")).where("several")
        rows = materialize(rows.join(several, "part", "left_semi"))
        if rows.isEmpty():
            return member
        own = graph.join(rows.select("node"), "node", "left_semi")
        found = settled(rows, materialize(first_graph(rows, k, turn)), k, own).where(F.col("cos") >= limit)
        if found.isEmpty():
            return member
        edges = member.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found.select(F.col("node").alias("a"), F.col("other").alias("b")))


def paired(nodes: DataFrame, member: DataFrame) -> DataFrame:
    """Rows (component, low, high, block, node, embedding, size): every pair of blocks of a component."""
    sizes = member.groupBy("component").agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    rows = nodes.select("node", "embedding", "size").join(member, "node").join(sizes, "component")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "against").alias("low"), F.greatest("block", "against").alias("high"), "block", "node", "embedding", "size")
    return rows


def link_counts(nodes: DataFrame, member: DataFrame, limit: float) -> DataFrame:
    """(node, links): vectors that a node links with, counted within its component.

    This enlarges saturated lists to all that they can hold: the members of a component are
    compared whole, block by block; only counts leave a block, never pairs.
    """

    def count(group: pa.Table) -> pa.Table:
        low, high, block = (group.column(c).to_numpy() for c in ("low", "high", "block"))
        ids, size, x = group.column("node").to_numpy(), group.column("size").to_numpy(), matrix(group.column("embedding"))
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        near = x[a] @ x[b].T >= limit
        if low[0] == high[0]:
            np.fill_diagonal(near, False)
            node, n = ids[a], near @ size[b]
        else:
            node, n = np.concatenate((ids[a], ids[b])), np.concatenate((near @ size[b], size[a] @ near))
        return pa.table({"node": node, "links": n.astype(np.int64)})

    rows = paired(nodes, member).groupBy("component", "low", "high")
    return rows.applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def all_edges(nodes: DataFrame, limit: float) -> DataFrame:
    """(a, b): edges with the components of all links, by comparing all nodes of a part in blocks.

    Of the links among the nodes of two blocks, only edges to the first node of each component leave.
    """

    def join(group: pa.Table) -> pa.Table:
        ids, x = group.column("node").to_numpy(), matrix(group.column("embedding"))
        near, name = x @ x.T >= limit, np.arange(len(ids))
        while True:
            new = np.minimum(name, np.where(near, name[None], len(ids)).min(1))
            new = new[new]
            if (new == name).all():
                break
            name = new
        rest = name != np.arange(len(ids))
        return pa.table({"a": ids[rest], "b": ids[name[rest]]})

    member = nodes.select("node", F.xxhash64("part").alias("component"))
    return paired(nodes, member).groupBy("component", "low", "high").applyInArrow(join, "a long, b long")


def audit(nodes: DataFrame, member: DataFrame, links: DataFrame, limit: float, turn: int = 0) -> tuple[float, DataFrame]:
    """(recall, edges): the worst recall of three kinds of nodes, by brute force of samples against all nodes,
    and edges (a, b) to the components that the sampled nodes should have been linked with.

    Links inside a component are counted whole, so those missed lead out of it. Members of groups of up to
    ``SMALL`` nodes and of larger ones: the mean over ``SAMPLE`` nodes of each one's share of links that were
    found. Nodes without links: linked nodes as a share of those that should be, where the sample tells how
    many more there are.
    """
    sizes = member.groupBy("component").agg(F.count("*").alias("m"))
    rows = nodes.drop("component").join(member, "node", "left").join(sizes, "component", "left")
    kind = F.when(F.col("component").isNull(), 0).when(F.col("m") <= SMALL, 1).otherwise(2)
    rows = materialize(rows.select("node", "part", "embedding", "size", F.coalesce("component", "node").alias("component"), kind.alias("kind")))
    numbers = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    if not numbers:
        return 1.0, rows.select(F.col("node").alias("a"), F.col("node").alias("b"))
    order = F.xxhash64(F.lit(turn), "node")
    samples = [rows.where(F.col("kind") == i).orderBy(order).limit(SAMPLE) for i in numbers]
    sample = samples[0]
    for x in samples[1:]:
        sample = sample.unionByName(x)
    sample = sample.join(links, "node", "left").select("node", "part", "embedding", "component", "kind", F.coalesce("links", F.lit(0)).alias("links")).toArrow()
    ids, component = sample.column("node").to_numpy(), sample.column("component").to_numpy()
    parts, vectors = np.array(sample.column("part").to_pylist()), sample.column("embedding").to_pylist()
    shared = nodes.sparkSession.sparkContext.broadcast((ids, parts, component, vectors))

    def missed(batches):
        ids, parts, component, vectors = shared.value
        group = {p: np.flatnonzero(parts == p) for p in set(parts.tolist())}
        unit = {p: matrix(pa.array([vectors[i] for i in at])) for p, at in group.items()}
        for batch in batches:
            part = np.array(batch.column(1).to_pylist())
            node, size, names = (batch.column(i).to_numpy() for i in (0, 3, 4))
            for p, at in group.items():
                here = np.flatnonzero(part == p)
                if not len(here):
                    continue
                near = (matrix(batch.column(2).take(pa.array(here))) @ unit[p].T >= limit) & (names[here][:, None] != component[at][None])
                for j in np.flatnonzero(near.any(0)):
                    found = here[near[:, j]]
                    _, first, place = np.unique(names[found], return_index=True, return_inverse=True)
                    n = np.bincount(place, size[found]).astype(np.int64)
                    a = np.full(len(first), ids[at[j]])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(node[found[first]]), pa.array(n)], ["a", "b", "n"])

    found = materialize(rows.select("node", "part", "embedding", "size", "component").mapInArrow(missed, "a long, b long, n long"))
    lost = {r["a"]: r["n"] for r in found.groupBy("a").agg(F.sum("n").alias("n")).collect()}
    shares: dict[int, list[float]] = {}
    for node, kind, n in zip(ids.tolist(), sample.column("kind").to_pylist(), sample.column("links").to_pylist()):
        more = lost.get(node, 0)
        shares.setdefault(kind, []).append(float(more > 0) if kind == 0 else n / (n + more) if n + more else 1.0)
    recall = [float(np.mean(x)) for kind, x in shares.items() if kind]
    if 0 in shares:
        linked = numbers.get(1, 0) + numbers.get(2, 0)
        more = np.mean(shares[0]) * numbers[0]
        recall.append(linked / (linked + more) if more else 1.0)
    return min(recall), found.select("a", "b")


def near_vectors(vectors: DataFrame, limit: float = LIMIT, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of a label are one node with a size. NN-descent refines neighbour lists of the
    nodes within their label until they settle; edges of at least ``limit`` stay and give
    components. Lists full of such edges are searched again outside their component, and enlarged
    to the whole component, compared in blocks. Recall is audited by brute force on bounded samples
    of unlinked nodes and of small and large groups against all nodes; below ``RECALL`` the lists
    are doubled and refined again, with other projections, and after ``ENLARGED`` such turns all
    nodes of a label are compared in blocks.

    Null labels, and vectors that are null, zero or hold null or non-finite components, link with
    nothing and are their own component; vectors of different lengths do not link. A null vec_id
    has a null component. Repeated ids are rows with one id: each is a vector of its own.
    """
    vectors = vectors.select(F.col("vec_id").cast("bigint"), "embedding", "label")
    rows = materialize(keyed(vectors))
    nodes = rows.where("node is not null").groupBy("node", "part")
    nodes = nodes.agg(F.min("vec_id").alias("first"), F.count("*").alias("size"), F.min_by("embedding", "vec_id").alias("embedding"))
    nodes = materialize(nodes.dropDuplicates(["node"]))
    nodes = nodes.withColumn("component", F.col("node"))
    k, graph = neighbours, None
    for turn in range(ENLARGED + 1):
        first = first_graph(nodes, k, turn)
        graph = settled(nodes, materialize(first if graph is None else best(first.unionByName(graph), k)), k)
        edges = graph.where(F.col("cos") >= limit).select(F.col("node").alias("a"), F.col("other").alias("b"))
        member = across(nodes, graph, edges, limit, k)
        links = materialize(link_counts(nodes, member, limit))
        recall, missed = audit(nodes, member, links, limit, turn)
        if not missed.isEmpty():
            # found by the audit, so they are not left out
            member = materialize(components(member.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(missed)))
            links = materialize(link_counts(nodes, member, limit))
        if recall >= RECALL:
            break
        k *= 2
    else:
        member = materialize(components(all_edges(nodes, limit)))
        links = materialize(link_counts(nodes, member, limit))
    named = nodes.select("node", "first", "size").join(member, "node", "left").join(links, "node", "left")
    lowest = named.where("component is not null").groupBy("component").agg(F.min("first").alias("lowest"))
    named = named.join(lowest, "component", "left")
    named = named.select("node", F.coalesce("lowest", "first").alias("component"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    linked = rows.where("node is not null").select("vec_id", "node").join(named, "node").select("vec_id", "n", "component")
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("bigint").alias("n"), F.col("vec_id").alias("component"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
