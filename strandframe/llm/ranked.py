"""Operator 12: ranked lexical search, short lists term at a time, long lists document at a time."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

TOP = 10
#: Documents of a segment, and postings after which one ends.
SEGMENT = 1 << 15
POSTINGS = 1 << 22
#: Documents of a block of a segment, and the share of a segment up to which a list is short.
BLOCK = 1 << 10
SHORT = 1 / 32
#: Terms of a block of items (of one item at least).
TERMS = 1 << 20

# Terms are ASCII letters, digits and everything beyond ASCII; only A-Z become lower case.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def raw(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): the distinct terms of every row of ``items``; ``item`` tells rows apart."""

    def run(batches):
        item = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = [list(dict.fromkeys(terms(x))) for x in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(item, item + len(found)), pa.int64()), batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "item_id", "terms"]
            )
            item += len(found)

    return items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(run, "item long, item_id long, terms array<binary>")


class Segment:
    """Postings of some documents, by term; documents by ascending id, null last.

    ``start[t]`` to ``start[t + 1]`` are the places of term ``t`` in ``doc`` (ascending) and ``tf``.
    """

    COLUMNS = ["doc_ids", "null_ids", "sizes", "terms", "counts", "doc", "tf"]
    SCHEMA = ", ".join(f"{c} binary" for c in COLUMNS)

    @staticmethod
    def of(ids: list, sizes: list[int], found: list[list[int]]) -> dict:
        """A row of the index from documents' ids, numbers of terms, and wanted terms with repeats."""
        numbers = np.array([0 if x is None else x for x in ids], np.int64)
        missing = np.array([x is None for x in ids], bool)
        order = np.lexsort((numbers, missing))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(place, [len(x) for x in found])
        term = np.fromiter((t for x in found for t in x), np.int64, len(doc))
        key, tf = np.unique(term * len(ids) + doc, return_counts=True) if len(doc) else (np.zeros(0, np.int64),) * 2
        own, counts = np.unique(key // max(1, len(ids)), return_counts=True)
        parts = [numbers[order], missing[order], np.array(sizes, np.int64)[order], own, counts, (key % max(1, len(ids))).astype(np.int32), tf.astype(np.int32)]
        return {c: p.tobytes() for c, p in zip(Segment.COLUMNS, parts)}

    def __init__(self, row: dict):
        types = [np.int64, bool, np.int64, np.int64, np.int64, np.int32, np.int32]
        self.ids, self.missing, self.sizes, self.terms, self.counts, self.doc, self.tf = (np.frombuffer(row[c], t) for c, t in zip(self.COLUMNS, types))
        self.start = np.concatenate(([0], np.cumsum(self.counts)))

    def weigh(self, documents: int, length: int, block: int = BLOCK) -> None:
        """Impacts of all postings, and the highest of every list in every block of documents."""
        m = 100 - 90 + (90 * self.sizes * documents) // max(1, length)
        tf = self.tf.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.block = block
        self.blocks = -(-len(self.ids) // block)
        self.high = np.zeros((len(self.terms), self.blocks), np.int64)
        if len(self.doc):
            cell = np.repeat(np.arange(len(self.terms)), self.counts) * self.blocks + self.doc // block
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            self.high.reshape(-1)[cell[first]] = np.maximum.reduceat(self.impact, first)

    def postings(self, t: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
        where = slice(self.start[t], self.start[t + 1])
        return self.doc[where], weight * self.impact[where]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One list of ascending documents with their summed scores: short lists taken term at a time."""
    if not lists:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    doc, back = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    score = np.zeros(len(doc), np.int64)
    np.add.at(score, back, np.concatenate([s for _, s in lists]))
    return doc, score


def probe(doc: np.ndarray, score: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Scores of ``wanted`` documents in a list, 0 where they are not in it."""
    at = np.minimum(np.searchsorted(doc, wanted), len(doc) - 1)
    return np.where(doc[at] == wanted, score[at], 0)


def best_of(segment: Segment, query: list[tuple[int, int]], top: int = TOP, short: float = SHORT) -> list[tuple[int, int]]:
    """(document's place, score) of the ``top`` documents of a segment with a score above 0, highest first, then by place.

    ``query`` has (term's place, weight). Short lists are summed into one list of accumulators. It
    and the long lists are then read document at a time, a block of documents after the other, with
    the ``top``-th score so far as threshold: a block is skipped if the highest impacts in it stay
    below, and in a block the lists that together stay below only answer for the documents of the
    others, as long as those can still come up to the threshold. The accumulators are a list like
    the long ones there, bounded by its highest sum in the block. Places ascend, so a document that
    comes up to the threshold but not beyond it can never win a tie.
    """
    limit = max(1, int(len(segment.ids) * short))
    few = [(t, w) for t, w in query if segment.counts[t] <= limit]
    long = [(t, w) for t, w in query if segment.counts[t] > limit]
    lists = [accumulate([segment.postings(t, w) for t, w in few])] if few else []
    edges = np.arange(segment.blocks + 1) * segment.block
    bounds = []
    if few:
        doc, score = lists[0]
        high = np.zeros(segment.blocks, np.int64)
        np.maximum.at(high, doc // segment.block, score)
        bounds.append(high)
    for t, w in long:
        lists.append(segment.postings(t, w))
        bounds.append(w * segment.high[t])
    if not lists:
        return []
    cuts = [np.searchsorted(d, edges) for d, _ in lists]
    bounds = np.array(bounds)
    ceiling = bounds.sum(0)
    # partial sums are never above a score, so the threshold may start with them
    threshold = 0
    for _, score in lists:
        if len(score) >= top:
            threshold = max(threshold, int(np.partition(score, -top)[-top]) - 1)
    best: list[tuple[int, int]] = []
    for b in np.flatnonzero(ceiling > threshold).tolist():
        if ceiling[b] <= threshold:
            continue
        order = np.argsort(bounds[:, b], kind="stable")
        upto = np.cumsum(bounds[order, b])
        essential = int(np.searchsorted(upto, threshold, "right"))
        parts = {int(i): slice(cuts[i][b], cuts[i][b + 1]) for i in order.tolist()}
        doc, score = accumulate([(lists[i][0][parts[i]], lists[i][1][parts[i]]) for i in order[essential:].tolist()])
        for place in range(essential - 1, -1, -1):
            live = score + upto[place] > threshold
            doc, score = doc[live], score[live]
            i = int(order[place])
            if len(doc) and parts[i].stop > parts[i].start:
                score = score + probe(lists[i][0][parts[i]], lists[i][1][parts[i]], doc)
        live = score > threshold
        if live.any():
            best += zip((-score[live]).tolist(), doc[live].tolist())
            best.sort()
            del best[top:]
            if len(best) == top:
                threshold = max(threshold, -best[-1][0])
    return [(doc, -score) for score, doc in best]


def build_segments(docs: DataFrame, vocabulary: dict[bytes, int], segment: int = SEGMENT, postings: int = POSTINGS) -> DataFrame:
    """The index, a row per ``Segment``: postings of the ``vocabulary`` in all documents, consecutive ones of a partition together."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        get = table.value.get
        ids, sizes, found, total = [], [], [], 0

        def row():
            return pa.RecordBatch.from_pydict({c: pa.array([x], pa.binary()) for c, x in Segment.of(ids, sizes, found).items()})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                own = terms(text)
                ids.append(doc_id)
                sizes.append(len(own))
                found.append([t for t in map(get, own) if t is not None])
                total += len(found[-1])
                if len(ids) >= segment or total >= postings:
                    yield row()
                    ids, sizes, found, total = [], [], [], 0
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, Segment.SCHEMA)


def statistics(segments: DataFrame, vocabulary: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and how many documents hold each term of the vocabulary."""

    def run(batches):
        df, documents, length = np.zeros(vocabulary, np.int64), 0, 0
        for batch in batches:
            for sizes, own, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sizes = np.frombuffer(sizes, np.int64)
                documents += int((sizes > 0).sum())
                length += int(sizes.sum())
                df[np.frombuffer(own, np.int64)] += np.frombuffer(counts, np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array([-2, -1, *at.tolist()], pa.int64()), "n": pa.array([documents, length, *df[at].tolist()], pa.int64())})

    sums = segments.select("sizes", "terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # collected once: rows of two runs may come in different orders
    table = sums.toArrow()
    found = dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
    df = np.zeros(vocabulary, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return found.get(-2, 0), found.get(-1, 0), df


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = TERMS, segment: int = SEGMENT, block: int = BLOCK, short: float = SHORT) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its ``top`` documents with a score above 0.

    Items are a query set: blocks of about ``block_terms`` terms of them are sent to the tasks, one
    block after the other. For a block, every partition of the documents becomes index segments with
    the postings of the block's terms; the segments' counts give the weights; every segment gives
    each item's best documents by ``best_of``, and a window settles the ``top`` of all segments.

    Null and empty texts have no terms: such a document counts for nothing, such an item has no row.
    Equal scores go by ascending doc_id, null last; repeated documents each take a rank, and repeated
    items each give their rows. Empty tables give no row; very long texts are indexed whole; other
    columns are not looked at.
    """
    spark = docs.sparkSession
    asked = materialize(item_terms(items).where(F.size("terms") > 0))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    out = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).toArrow()
        names = [x.as_py() for x in part.column("terms").combine_chunks().flatten().unique()] if len(part) else []
        vocabulary = {t: k for k, t in enumerate(names)}
        segments = materialize(build_segments(docs, vocabulary, segment))
        documents, length, df = statistics(segments, len(names))
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()]
        queries = [
            (item, item_id, [(vocabulary[t], weight[vocabulary[t]]) for t in own])
            for item, item_id, own in zip(*(part.column(c).to_pylist() for c in ("item", "item_id", "terms")))
        ]
        shared = spark.sparkContext.broadcast(queries)
        found = segments.mapInArrow(_scorer(shared, documents, length, top, block, short), "item long, item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def _scorer(shared, documents: int, length: int, top: int, block: int, short: float):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                own = Segment({c: batch.column(k)[i].as_py() for k, c in enumerate(Segment.COLUMNS)})
                own.weigh(documents, length, block)
                place = {t: k for k, t in enumerate(own.terms.tolist())}
                rows = []
                for item, item_id, query in shared.value:
                    here = [(place[t], w) for t, w in query if w and t in place]
                    rows += [(item, item_id, None if own.missing[d] else int(own.ids[d]), score) for d, score in best_of(own, here, top, short)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["item", "item_id", "doc_id", "score"])

    return run
