"""Operator 8: repeated passages by a logarithmic family of sparse suffix arrays."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shared_dir
from .common import RangeHash

MATCH = 100
GRAM = 32
#: Texts come in at least this many batches, and in as many more as keep a batch below ``BATCH_BYTES``.
BATCHES = 4
BATCH_BYTES = 1 << 40
FLUSH = 1 << 20
#: Windows that are compared together, after those of an anchor; the last is 1.
STEPS = (8, 1)
#: Order of rows without an id of their own: after every id.
LATE = 1 << 62


class Anchors:
    """Sampled suffixes of a text: in every ``match`` bytes in a row the leftmost gram of smallest hash.

    What is sampled depends on those bytes only, so equal strings of ``match`` bytes have their
    anchor at the same offset, and comparing anchored suffixes finds every such match.
    """

    def __init__(self, match: int, gram: int):
        self.match, self.gram = match, gram
        self.grams, self.bytes = RangeHash(81), RangeHash(82)

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, key, first window, last window) of the anchors; windows are named by their first byte."""
        none = np.zeros(0, np.int64)
        if len(data) < self.match:
            return none, none, none, none
        self.grams.load(data)
        h = self.grams.grams(self.gram)
        low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        width, size = self.match - self.gram + 1, 1
        while 2 * size <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        place = place[first]
        return place, (h[place] >> np.uint64(16)).astype(np.int64), first, last

    def candidates(self, data: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
        """(key, hash of the context, first window, windows, place) of the repeated anchors."""
        place, key, first, last = self.find(data)
        use = np.isin(key, repeated)
        place, key, first, last = place[use], key[use], first[use], last[use]
        if not len(key):
            return key, key, key, key, key
        self.bytes.load(data)
        return key, self.bytes.ranges(first, last + self.match).view(np.int64), first, last - first + 1, place


def packed(docs: DataFrame) -> DataFrame:
    """(id, digest, z): texts compressed, for the shuffle."""

    def run(batches):
        coder = zstandard.ZstdCompressor(level=5)
        for batch in batches:
            z = [coder.compress(x) for x in batch.column(2).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(z, pa.binary())], ["id", "digest", "z"])

    return docs.select("id", "digest", "text").mapInArrow(run, "id long, digest long, z binary")


def unpacked(column: pa.Array):
    coder = zstandard.ZstdDecompressor()
    for z in column.to_pylist():
        yield np.frombuffer(coder.decompress(z), np.uint8)


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed and sorted by ``column``: joins on it need no shuffle."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), "suffix_" + uuid.uuid4().hex
    writer = df.repartition(n, column).write.bucketBy(n, column).sortBy(column).option("compression", "zstd")
    writer.option("path", shared_dir(spark)).saveAsTable(name)
    return spark.table(name)


def anchor_rows(texts: DataFrame, match: int, gram: int) -> DataFrame:
    """(id, h, first, again) of a batch's anchors, sorted by h in each task; texts are scanned once.

    ``first`` marks one row per fingerprint and task, ``again`` every row whose fingerprint occurs
    twice or more in the task, in one document or in several. Rows are distinct.
    """

    def run(batches):
        find = Anchors(match, gram).find
        keys, docs, twice = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), unpacked(batch.column(1))):
                key, n = np.unique(find(data)[1], return_counts=True)
                keys.append(key)
                docs.append(np.full(len(key), doc))
                twice.append(n > 1)
        key, doc, again = np.concatenate(keys), np.concatenate(docs), np.concatenate(twice)
        order = np.argsort(key, kind="stable")
        key, doc, again = key[order], doc[order], again[order]
        same = key[1:] == key[:-1]
        first = np.ones(len(key), bool)
        first[1:] = ~same
        again[1:] |= same
        again[:-1] |= same
        use = first | again
        key, doc, first, again = key[use], doc[use], first[use], again[use]
        for i in range(0, len(key), FLUSH):
            at = slice(i, i + FLUSH)
            yield pa.RecordBatch.from_arrays([pa.array(x[at]) for x in (doc, key, first, again)], ["id", "h", "first", "again"])

    return texts.select("id", "z").mapInArrow(run, "id long, h long, first boolean, again boolean")


def discard(written: DataFrame) -> None:
    """Removes the folder of a written table that nothing reads any more."""
    files = written.inputFiles()
    if files:
        spark = written.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def batch_array(rows: DataFrame) -> DataFrame:
    """The sparse suffix array of a batch: (h, docs) by h, the fingerprint that suffixes begin with.

    Order by fingerprint serves as well as order by letters, as only equal beginnings matter. A task
    gives one document per fingerprint (those marked ``again`` are reported anyway), so ``docs`` has
    at most one entry per task.
    """
    return rows.where("first").groupBy("h").agg(F.collect_list("id").alias("docs"))


class Family:
    """Levels of sparse suffix arrays, each twice the size of the one before it."""

    def __init__(self) -> None:
        self.levels: dict[int, DataFrame] = {}

    def scan(self, array: DataFrame) -> DataFrame:
        """(id, h) of entries that the array shares with a level, or holds twice itself; a merge of sorted tables."""
        own = array.where(F.size("docs") > 1).select(F.explode("docs").alias("id"), "h")
        for level in self.levels.values():
            both = array.join(level.withColumnRenamed("docs", "old"), "h")
            own = own.unionByName(both.select(F.explode(F.concat("docs", "old")).alias("id"), "h"))
        return own

    def insert(self, array: DataFrame) -> None:
        """Adds a batch's array; levels of equal size are merged. Of a fingerprint one entry stays: the others are reported by then."""
        size, table = 0, array
        while size in self.levels:
            both = self.levels.pop(size).unionByName(table).groupBy("h").agg(F.min("docs").alias("docs"))
            size, table = size + 1, both
        self.levels[size] = table if size == 0 else bucketed(table, "h")


def repeated(texts: DataFrame, batches: int, match: int, gram: int) -> DataFrame:
    """(id, h): anchors that occur more than once, found batch by batch in the order of ids.

    What a batch finds is written before the next one, so plans stay small however many batches there are.
    """
    cuts = texts.agg(F.percentile_approx("id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    found, family = [], Family()
    for i in range(len(cuts) + 1):
        batch = texts
        if i:
            batch = batch.where(F.col("id") > cuts[i - 1])
        if i < len(cuts):
            batch = batch.where(F.col("id") <= cuts[i])
        rows = materialize(anchor_rows(batch, match, gram))
        array = bucketed(batch_array(rows), "h")
        own = rows.where("again").select("id", "h")
        found.append(materialize(own.unionByName(family.scan(array))))
        discard(rows)
        if i < len(cuts):
            family.insert(array)
    return reduce(DataFrame.unionByName, found)


ROW = "kind byte, g long, c long, id long, key long, lo int, n int, at int"


def sorted_rows(held: list[tuple]) -> pa.RecordBatch:
    """One batch of ``ROW``: kind 1 has an equal (g, c) earlier among the rows held."""
    columns = [np.concatenate([x[i] for x in held]) for i in range(7)]
    g, c, _, key, lo = columns[:5]
    order = np.lexsort((lo, key, c, g))
    columns = [x[order] for x in columns]
    g, c = columns[:2]
    kind = np.zeros(len(g), np.int8)
    kind[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
    arrays = [pa.array(kind), *(pa.array(x, pa.int64()) for x in columns[:4]), *(pa.array(x, pa.int32()) for x in columns[4:])]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "g", "c", "id", "key", "lo", "n", "at"])


def contexts(texts: DataFrame, found: DataFrame, match: int, gram: int) -> DataFrame:
    """``ROW`` of repeated anchors g: ``n`` windows from ``lo`` on that the anchor stands for, and the hash c of all their bytes."""

    def run(batches):
        tool = Anchors(match, gram)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for id_, key, data, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpacked(batch.column(2)), batch.column(3).to_pylist()):
                h, c, lo, n, at = tool.candidates(data, np.array(known, np.int64))
                held.append((h, c, np.full(len(h), id_), np.full(len(h), key), lo, n, at))
                size += len(h)
            if size > FLUSH:
                yield sorted_rows(held)
                held, size = [], 0
        if held:
            yield sorted_rows(held)

    lists = found.groupBy("id").agg(F.collect_set("h").alias("known"))
    return texts.join(lists, "id").select("id", "key", "z", "known").mapInArrow(run, ROW)


def parts(texts: DataFrame, chosen: DataFrame, match: int, step: int) -> DataFrame:
    """``ROW`` of the ``chosen`` (id, key, lo, n, at) in parts of at most ``step`` windows, counted from ``at``.

    All windows of a part hold the same bytes; their hash is g, that of all the part's bytes c. So
    equal windows are in parts of equal g.
    """

    def run(batches):
        cores, whole = RangeHash(83), RangeHash(82)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for id_, key, data, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), unpacked(batch.column(2)), batch.column(3).to_pylist()):
                own = [(x["lo"], x["n"], x["at"]) for x in spans if x["key"] == key]
                if not own:
                    continue
                lo, n, at = np.array(own, np.int64).T
                one = np.repeat(np.arange(len(lo)), n)
                s = np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n) + lo[one]
                begin = at[one] + (s - at[one]) // step * step
                first = np.ones(len(s), bool)
                first[1:] = (one[1:] != one[:-1]) | (begin[1:] != begin[:-1])
                start, begin = s[first], begin[first]
                count = np.diff(np.append(np.flatnonzero(first), len(s)))
                cores.load(data)
                whole.load(data)
                g = cores.ranges(begin + step - 1, begin + match).view(np.int64)
                c = whole.ranges(start, start + count - 1 + match).view(np.int64)
                held.append((g, c, np.full(len(g), id_), np.full(len(g), key), start, count, start))
                size += len(g)
            if size > FLUSH:
                yield sorted_rows(held)
                held, size = [], 0
        if held:
            yield sorted_rows(held)

    lists = chosen.groupBy("id").agg(F.collect_list(F.struct("key", "lo", "n", "at")).alias("spans"))
    return texts.join(lists, "id").select("id", "key", "z", "spans").mapInArrow(run, ROW)


def compared(rows: DataFrame, match: int) -> tuple[DataFrame, DataFrame]:
    """(covered, chosen): bytes (id, key, lo, hi) of rows that repeat an earlier row, and the first rows
    that share g with a row of other bytes, to be compared more finely.

    Tasks have reduced equal rows to one each, so the window over equal (g, c) is small.
    """
    order = Window.partitionBy("g", "c").orderBy("key", "lo")
    ranked = rows.where("kind = 0").withColumn("again", F.row_number().over(order) > 1).drop("kind", "c")
    ranked = materialize(ranked)
    covered = rows.where("kind = 1").select("id", "key", "lo", "n").unionByName(ranked.where("again").select("id", "key", "lo", "n"))
    heads = ranked.where("not again")
    mixed = heads.groupBy("g").agg(F.count("*").alias("m")).where("m > 1")
    chosen = heads.join(mixed, "g").select("id", "key", "lo", "n", "at")
    return covered.select("id", "key", "lo", (F.col("lo") + F.col("n") - 1 + match).alias("hi")), chosen


def remaining(texts: DataFrame, covered: DataFrame, with_text: bool) -> DataFrame:
    """(key, n_removed, n_spans, sha, left): what stays of every text without its ``covered`` (id, key, lo, hi).

    ``left`` is that text, if asked for, without bytes of characters that were cut.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, data, spans in zip(batch.column(0).to_pylist(), unpacked(batch.column(1)), batch.column(2).to_pylist()):
                own = [(x["lo"], x["hi"]) for x in spans or () if x["key"] == key]
                mark = np.zeros(len(data) + 1, np.int64)
                if own:
                    lo, hi = np.array(own).T
                    np.add.at(mark, lo, 1)
                    np.add.at(mark, hi, -1)
                gone = np.cumsum(mark)[:-1] > 0
                left = data[~gone].tobytes()
                starts = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((key, int(gone.sum()), starts, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["key", "n_removed", "n_spans", "sha", "left"])

    lists = covered.groupBy("id").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("spans"))
    rows = texts.join(lists, "id", "left").select("key", "z", "spans")
    return rows.mapInArrow(run, "key long, n_removed long, n_spans long, sha string, left string")


def named(docs: DataFrame) -> DataFrame:
    """Adds id, digest, digest2 and n_bytes. A row without doc_id gets an id after all others from its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn("text", text)
    late = F.lit(LATE) + F.abs(F.xxhash64(F.lit("none"), "text") % LATE)
    return rows.withColumns(
        {
            "id": F.coalesce(F.col("doc_id").cast("bigint"), late),
            "digest": F.xxhash64("text"),
            "digest2": F.xxhash64(F.lit(2), "text"),
            "n_bytes": F.octet_length("text").cast("bigint"),
        }
    )


def deduplicated(docs: DataFrame, with_text: bool = False, match: int = MATCH, gram: int = GRAM, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): the rows of ``docs`` with their text's key and the key of its first copy, and what
    is left of each first copy by key.

    1. Equal texts are one; later copies of ``match`` bytes or more go whole.
    2. Texts arrive in batches in the order of ids, whose number follows their bytes. Each batch gets
       a sparse suffix array; it is merge-scanned against the levels of the index family, then added
       to it, and levels of equal size merge. What is found: anchors that occur more than once.
    3. The windows of ``match`` bytes that such anchors stand for are compared by the hash of the
       anchor's whole context; where an anchor has different contexts, in smaller parts, and at last
       one by one. All but the first of equal windows are removed.
    """
    small = named(docs.select("doc_id", "text")).select("doc_id", "id", "digest", "digest2", "n_bytes", F.when(F.col("n_bytes") < match, F.sha2("text", 256)).alias("sha0"))
    one = small.groupBy("id").agg(F.min("digest").alias("lowest"))
    extra = F.lit(LATE) + F.abs(F.xxhash64("id", "digest") % LATE)
    rows = small.join(one, "id").withColumn("key", F.when(F.col("digest") == F.col("lowest"), F.col("id")).otherwise(extra)).drop("lowest")
    rows = materialize(rows)
    copies = rows.groupBy("digest", "digest2", "n_bytes").agg(F.min("key").alias("first"))
    rows = materialize(rows.join(copies, ["digest", "digest2", "n_bytes"]))
    firsts = rows.where("key = first").select("id", "digest", "key").distinct()
    texts = bucketed(packed(named(docs.select("doc_id", "text"))).join(firsts, ["id", "digest"]).dropDuplicates(["key"]).select("id", "key", "z"), "id")

    n_bytes = rows.where("key = first").agg(F.sum("n_bytes")).first()[0] or 0
    found = repeated(texts, max(BATCHES, -(-n_bytes // batch_bytes)), match, gram)
    covered, chosen = compared(materialize(contexts(texts, found, match, gram)), match)
    for step in STEPS:
        more, chosen = compared(materialize(parts(texts, chosen, match, step)), match)
        covered = covered.unionByName(more)
    return rows, remaining(texts, covered, with_text)


def digests(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 per row of ``docs`` (doc_id, text).

    Bytes go that a string of ``MATCH`` bytes covers which also starts earlier: in a smaller doc_id,
    or earlier in the document. Null text is empty and keeps its nothing. Rows that repeat id and
    text are the same document and get the same result; if an id repeats with another text, or is
    null, the row counts as later than all documents (in an order by hashes). Very long texts are
    scanned whole. Columns besides doc_id and text are not looked at, whatever their names; an empty
    table gives no rows. The number of batches changes no result.
    """
    rows, texts = deduplicated(docs, batch_bytes=batch_bytes)
    out = rows.join(texts.drop("left").withColumnRenamed("key", "first"), "first")
    empty = hashlib.sha256(b"").hexdigest()
    copy, long = F.col("key") != F.col("first"), F.col("n_bytes") >= MATCH
    pick = lambda gone, same: F.when(copy & long, gone).when(copy, F.lit(0)).otherwise(same)
    return out.select(
        "doc_id",
        "n_bytes",
        pick(F.col("n_bytes"), F.col("n_removed")).alias("n_removed"),
        pick(F.lit(1), F.col("n_spans")).cast("bigint").alias("n_spans"),
        F.when(copy & long, empty).when(copy, F.col("sha0")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut from text (n_chars follows), without documents of which no word is left.

    Documents that had no word before stay as they are.
    """
    rows, texts = deduplicated(docs.select("doc_id", "text"), with_text=True)
    keys = rows.select("id", "digest", "key", "first").distinct()
    short = F.when(F.col("n_bytes") < MATCH, F.col("text"))
    meta = named(docs).withColumn("text", short).join(keys, ["id", "digest"])
    meta = meta.where((F.col("key") == F.col("first")) | (F.col("n_bytes") < MATCH))
    out = meta.join(texts.select("key", "left"), "key", "left").withColumn("text", F.coalesce("left", "text"))
    out = out.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") | (F.col("n_bytes") < MATCH))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
