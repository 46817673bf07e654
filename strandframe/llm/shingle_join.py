"""Operator 10: n-gram Jaccard join by vertical partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import RangeHash, components, mixed, text_bytes

FRAGMENTS = 8
SHARED = 3
FREQUENT = 10
FREQUENT_MOST = 1 << 20
HOT = 64
ROUNDS = 2
BLOCK = 1 << 22
SEED = 10


def shingles(text: bytes, width: int, hasher: RangeHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``width`` words; a shorter text is one shingle."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(found) + b" ", np.uint8)
    end = np.flatnonzero(data == 32)
    start = np.concatenate(([0], end[:-1] + 1))
    last = min(width, len(found)) - 1
    hasher.load(data)
    return np.unique(hasher.ranges(start[: len(start) - last], end[last:]))


def signature(h: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that stand for the whole set."""
    sums = np.array([h.sum(dtype=np.uint64), mixed(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
    return tuple(sums.view(np.int64).tolist())


def required(n: np.ndarray | int, percent: int):
    """Members that a set of ``n`` shares at least with any set it links with."""
    return -(-percent * n // 100)


def frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of frequent shingles, at most ``FREQUENT_MOST``: they end the global order.

    The order decides only how much work a document's prefix makes, so counts that tasks see
    twice or more in a block of texts are enough.
    """

    def count(batches):
        hasher = RangeHash(SEED)
        held, seen, size = [], set(), 0

        def out():
            values, n = np.unique(np.concatenate(held), return_counts=True)
            many = n > 1
            return pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(n[many], pa.int64())], ["h", "n"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                h = shingles(text, width, hasher)
                if len(h) and (key := signature(h)) not in seen:
                    seen.add(key)
                    held.append(h)
                    size += len(h)
                if size > BLOCK:
                    yield out()
                    held, seen, size = [], set(), 0
        if held:
            yield out()

    counts = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(FREQUENT_MOST).select("h").toArrow()
    return np.sort(most.column(0).to_numpy().astype(np.int64).view(np.uint64))


def text_digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def signed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, the set's signature (s1, s2) and the prefix of the set in the global order.

    Two sets that link share ``required`` members at least, hence at least ``SHARED`` (or all
    required, if fewer) among the first n - required + SHARED of each.
    """
    common = docs.sparkSession.sparkContext.broadcast(frequent(docs, width))

    def run(batches):
        hasher, late = RangeHash(SEED), common.value
        for batch in batches:
            size, one, two, prefix, offsets = [], [], [], [], [0]
            for text in text_bytes(batch.column(1)):
                h = shingles(text, width, hasher)
                n = len(h)
                a, b = signature(h)
                is_late = np.zeros(n, bool)
                if len(late):
                    is_late = late[np.minimum(np.searchsorted(late, h), len(late) - 1)] == h
                need = required(n, percent)
                keep = n - need + min(SHARED, need)
                first = h[~is_late][:keep]
                prefix.append(np.concatenate((first, h[is_late][: keep - len(first)])))
                offsets.append(offsets[-1] + keep)
                size.append(n)
                one.append(a)
                two.append(b)
            flat = np.concatenate([np.zeros(0, np.uint64), *prefix]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), *(pa.array(x, pa.int64()) for x in (size, one, two)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                ["doc_id", "digest", "n", "s1", "s2", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", text_digest().alias("digest"))
    return rows.mapInArrow(run, "doc_id long, digest long, n long, s1 long, s2 long, prefix array<long>")


def fragments(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """(doc, frag, part): the sets of the ``chosen`` (doc, s1, s2), cut into ranges of the global order."""

    def run(batches):
        hasher = RangeHash(SEED)
        shift = np.uint64(64 - (FRAGMENTS - 1).bit_length())
        for batch in batches:
            doc, frag, part, offsets = [], [], [], [0]
            want = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for doc_id, text, key in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), want):
                h = shingles(text, width, hasher)
                if signature(h) != key:
                    continue
                cuts = np.searchsorted(h >> shift, np.arange(FRAGMENTS + 1, dtype=np.uint64))
                for k in range(FRAGMENTS):
                    if cuts[k] < cuts[k + 1]:
                        doc.append(doc_id)
                        frag.append(k)
                        part.append(h[cuts[k] : cuts[k + 1]])
                        offsets.append(offsets[-1] + len(part[-1]))
            flat = np.concatenate([np.zeros(0, np.uint64), *part]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(frag, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                ["doc", "frag", "part"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").join(chosen, "doc")
    return rows.select("doc", "text", "s1", "s2").mapInArrow(run, "doc long, frag int, part array<long>").dropDuplicates(["doc", "frag"])


def linked(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Those ``pairs`` (a, b, na, nb) that link: overlaps are counted per fragment and summed per pair."""
    left = parts.select(F.col("doc").alias("a"), "frag", F.col("part").alias("pa"))
    right = parts.select(F.col("doc").alias("b"), "frag", F.col("part").alias("pb"))
    both = pairs.join(left, "a").join(right, ["b", "frag"])
    shared = both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("shared"))
    total = shared.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return total.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id) per row of ``docs``; ``digest`` is that of ``text_digest``.

    Documents with equal sets are one class, found by the sets' signatures. Among the classes:

    1. A global order of shingles puts frequent ones last. Only the prefixes of the sets in that
       order meet; classes that share too few prefix shingles for a link are dropped by counting.
    2. The order is cut into fragments. For each candidate pair the overlap is counted within
       each fragment, and the partial counts are summed per pair.
    3. A shingle in more than ``HOT`` prefixes (many near copies of one text) does not emit pairs
       of all its classes: all are held against one leader, for some rounds. What is then still
       apart is paired with all classes that share the shingle and belong elsewhere, so no link
       between two components is lost. As rare shingles come first, a near copy's own changes stand
       before what it shares, and pairs whose changes alone exceed the bound are not compared.

    Null and empty text: no shingles, a component of its own. Texts of fewer words than ``width``
    are one shingle. Rows with one doc_id and different texts are classes of their own under that
    id; a null doc_id has a null component and links with nothing.
    """
    rows = materialize(signed(docs, width, percent))
    valid = rows.where("n > 0 and doc_id is not null")
    classes = materialize(valid.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc")))
    heads = rows.withColumnRenamed("doc_id", "doc").join(classes, ["doc", "n", "s1", "s2"]).dropDuplicates(["doc", "s1"])
    postings = heads.select("doc", "n", "s1", "s2", F.posexplode("prefix").alias("pos", "h"))
    lists = postings.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    postings = materialize(postings.join(lists, "h"))

    close = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    # what stands before the first shared shingle is not shared: both sets share what follows at most
    near = lambda apart, na, nb: apart * (100 + percent) <= (100 - percent) * (na + nb)
    apart = lambda na, pa, nb, pb: F.greatest(nb - na + 2 * pa, na - nb + 2 * pb)
    left = postings.where(F.col("m") <= HOT).select("h", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    right = left.select("h", F.col("a").alias("b"), F.col("na").alias("nb"), F.col("pa").alias("pb"))
    hot = materialize(postings.where(F.col("m") > HOT).select("h", "doc", "n", "pos"))
    in_hot = hot.groupBy("doc").agg(F.count("*").alias("hot"))
    counts = left.join(right, "h").where("a < b").where(close)
    counts = counts.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.min(apart(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"))).alias("apart"))
    counts = counts.join(in_hot.select(F.col("doc").alias("a"), F.col("hot").alias("ha")), "a", "left")
    counts = counts.join(in_hot.select(F.col("doc").alias("b"), F.col("hot").alias("hb")), "b", "left")
    least = F.least(F.lit(SHARED), F.ceil(F.least("na", "nb") * percent / 100))
    both_hot = F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0)))
    maybe = (F.col("c") + both_hot >= least) & ((both_hot > 0) | near(F.col("apart"), F.col("na"), F.col("nb")))
    pairs = materialize(counts.where(maybe).select("a", "b", "na", "nb"))

    chosen = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).unionByName(hot.select("doc")).distinct()
    chosen = classes.select("doc", "s1", "s2").join(chosen, "doc")
    parts = materialize(fragments(docs, chosen, width))
    edges = linked(pairs, parts, percent)
    label = components(edges)

    def labelled() -> DataFrame:
        found = hot.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100))
        found = found.join(label.withColumnRenamed("node", "doc"), "doc", "left")
        found = found.select("h", "doc", "n", "pos", F.coalesce("component", "doc").alias("label"))
        # classes that are too far even from the list's foremost one have their link, if any, elsewhere
        foremost = found.groupBy("h").agg(F.min("pos").alias("least"))
        found = found.join(foremost, "h").where(near(F.col("pos") + F.col("least"), F.col("n"), F.col("n") * 100 / percent)).drop("least")
        found = materialize(found)
        several = found.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("h")
        return materialize(found.join(several, "h"))

    def merge(more: DataFrame) -> DataFrame:
        """Labels after the links ``more``: only labels are contracted, then exchanged."""
        names = label.select(F.col("node").alias("a"), F.col("component").alias("la"))
        links = more.join(names, "a", "left").join(names.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b", "left")
        links = links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
        new = components(links)
        moved = label.join(new.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        moved = moved.select("node", F.coalesce("to", "component").alias("component"))
        return materialize(moved.unionByName(new).groupBy("node").agg(F.min("component").alias("component")))

    def ordered(df: DataFrame, x: str, y: str) -> DataFrame:
        """Pairs with the smaller id first, once each."""
        swap = F.col(f"{x}.doc") > F.col(f"{y}.doc")
        pick = lambda field: (F.when(swap, F.col(f"{y}.{field}")).otherwise(F.col(f"{x}.{field}")), F.when(swap, F.col(f"{x}.{field}")).otherwise(F.col(f"{y}.{field}")))
        (a, b), (na, nb) = pick("doc"), pick("n")
        return df.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb")).where(close).distinct()

    for turn in range(ROUNDS + 1):
        open_lists = labelled()
        if open_lists.isEmpty():
            break
        x = open_lists.alias("x")
        if turn < ROUNDS:
            first = F.struct("pos", F.xxhash64(F.lit(turn), "doc").alias("k"), "doc", "n", "label")
            lead = open_lists.groupBy("h").agg(F.min(first).alias("y")).select("h", "y.pos", "y.doc", "y.n", "y.label").alias("y")
            met = x.join(lead, F.col("x.h") == F.col("y.h"))
        else:
            sizes = open_lists.groupBy("h", "label").agg(F.count("*").alias("c"))
            main = sizes.groupBy("h").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
            lesser = open_lists.join(main, "h").where("label <> main").alias("y")
            once = (F.col("x.label") == F.col("y.main")) | (F.col("x.doc") < F.col("y.doc"))
            met = x.join(lesser, F.col("x.h") == F.col("y.h")).where(once)
        gap = apart(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
        met = met.where("x.label <> y.label").where(near(gap, F.col("x.n"), F.col("y.n")))
        label = merge(linked(materialize(ordered(met, "x", "y")), parts, percent))

    named = classes.join(label.withColumnRenamed("node", "doc"), "doc", "left")
    named = named.select("n", "s1", "s2", F.coalesce("component", "doc").alias("component"))
    out = rows.select("doc_id", "digest", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "digest", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their component (the smallest doc_id), with their columns.

    Of rows with equal id and text one stays. Rows without an id, a word or a text link with nothing and stay.
    """
    found = similar_documents(docs.select("doc_id", "text"), width, percent)
    heads = found.where("component_id = doc_id").select(F.col("doc_id").alias("j_id"), F.col("digest").alias("j_digest")).distinct()
    rows = docs.withColumns({"j_id": F.col("doc_id").cast("bigint"), "j_digest": text_digest()})
    with_id = rows.join(heads, ["j_id", "j_digest"], "left_semi").dropDuplicates(["j_id", "j_digest"])
    return with_id.unionByName(rows.where("doc_id is null")).drop("j_id", "j_digest")
