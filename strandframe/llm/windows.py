"""Operator 13: repeated windows of words, found with count-min sketches and settled exactly."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import RangeHash, mixed

WINDOW = 50
#: Words of a chunk: consecutive documents of a partition, one at least.
CHUNK = 1 << 18
#: Rows of the sketch, and its cells per row and counted fingerprint.
DEPTH = 2
CELLS = 8
#: A row is cut into this many tiles, of at most 2^26 cells.
TILES = 64
TILE_BITS = (12, 26)
#: Windows of one range of hashes in the exact pass, and ranges at least.
RANGE = 1 << 20
RANGES = 64

COLUMNS = ["chunk", "doc_ids", "ends", "n_words", "data"]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chunk, doc_ids, ends, n_words, data): documents in a row as bytes, each with a line feed after it.

    Every document of ``docs`` lies in one chunk, in the order of its partition.
    """

    def run(batches):
        chunk, held, ids, words = TaskContext.get().partitionId() << 32, [], [], 0

        def row():
            ends = np.cumsum([len(x) + 1 for x in held])
            return pa.RecordBatch.from_pydict(
                {"chunk": [chunk], "doc_ids": [ids], "ends": [ends], "n_words": [words], "data": pa.array([b"\n".join(held) + b"\n"], pa.binary())},
                schema=pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n_words", pa.int64()), ("data", pa.binary())]),
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                text = text or b""
                held.append(text)
                ids.append(doc_id)
                words += len(text.split())
                if words >= size:
                    yield row()
                    chunk, held, ids, words = chunk + 1, [], [], 0
        if held:
            yield row()

    schema = "chunk long, doc_ids array<long>, ends array<long>, n_words long, data binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


class Windows:
    """The windows of a chunk that lie in one document with an id, by their first word.

    A window's fingerprint is the least hash of the runs of ``width`` / 2 words in it. Equal windows
    have one fingerprint, so its count is never below a window's; neighbours mostly share theirs,
    so there are far fewer of them than windows.
    """

    def __init__(self, width: int = WINDOW):
        self.width = width
        self.letters = RangeHash(131)

    def load(self, doc_ids: list, ends: np.ndarray, data: bytes) -> None:
        text = np.frombuffer(data, np.uint8)
        space = _SPACE[text]
        before = np.concatenate(([True], space[:-1]))
        starts, stops = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        self.letters.load(text)
        self.words = self.letters.ranges(starts, stops)
        self.doc = np.searchsorted(ends, starts, "right")
        self.ids = np.array([-1 if x is None else x for x in doc_ids], np.int64)
        self.has_id = np.array([x is not None for x in doc_ids], bool)
        n = max(0, len(self.words) - self.width + 1)
        one = self.doc[:n] == self.doc[self.width - 1 :] if n else np.zeros(0, bool)
        self.valid = np.flatnonzero(one & self.has_id[self.doc[:n]])

    def runs(self, width: int, base: int) -> np.ndarray:
        """Hashes of all ``width`` words in a row."""
        n = len(self.words) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        up = RangeHash.powers(base, len(self.words))
        down = RangeHash.powers(pow(base, -1, 2**64), n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * up)))
        return mixed((sums[width:] - sums[:-width]) * down)

    def fingerprints(self) -> np.ndarray:
        """The fingerprint of every valid window."""
        short = self.width // 2
        least, span, want = self.runs(short, 0x9E3779B97F4A7C15), 1, self.width - short + 1
        while span < want:
            step = min(span, want - span)
            least = np.minimum(least[: len(least) - step], least[step:])
            span += step
        return least[self.valid]

    def hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash of the windows at ``at``."""
        high, low = self.runs(self.width, 0xD1342543DE82EF95), self.runs(self.width, 0xAF251AF3B0F025B5)
        return high[at], (low[at] >> np.uint64(32)).astype(np.uint32)

    def counted(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct fingerprints in order, and whether several documents have them."""
        if not len(prints):
            return prints, np.zeros(0, bool)
        doc = self.doc[self.valid]
        new = np.concatenate(([True], (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])))
        prints, doc = prints[new], doc[new]
        order = np.lexsort((doc, prints))
        prints, doc = prints[order], doc[order]
        first = np.concatenate(([True], prints[1:] != prints[:-1]))
        other = ~first
        other[1:] &= doc[1:] != doc[:-1]
        return prints[first], np.logical_or.reduceat(other, np.flatnonzero(first))


def cells(prints: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of every fingerprint in each row of a sketch of 2^bits cells a row."""
    return [mixed(prints + np.uint64(1 + row)) >> np.uint64(64 - bits) for row in range(DEPTH)]


def packed(sorted_cells: np.ndarray) -> bytes:
    """Ascending numbers as 16-bit gaps; 65535 stands for a gap that goes on."""
    gaps = np.diff(sorted_cells.astype(np.int64), prepend=0)
    on = gaps // 65535
    out = np.full(len(gaps) + int(on.sum()), 65535, np.uint16)
    out[np.cumsum(on) + np.arange(len(gaps))] = gaps % 65535
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint16)
    return np.cumsum(gaps, dtype=np.int64)[gaps != 65535]


def by_tile(cell: np.ndarray, tile_bits: int):
    """(tile, from, to) of the runs of ascending ``cell`` in one tile."""
    tile = cell >> np.uint64(tile_bits)
    first = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1]))) if len(cell) else np.zeros(0, np.int64)
    return zip(tile[first].tolist(), first.tolist(), [*first[1:].tolist(), len(cell)])


def partition_sketch(windows: Windows, prints: np.ndarray, bits: int, tile_bits: int):
    """(row, tile, cells, twice) of a chunk's own sketch, without its empty cells; counts end at 2."""
    values, many = windows.counted(prints)
    for row, cell in enumerate(cells(values, bits)):
        order = np.argsort(cell, kind="stable")
        cell, often = cell[order], many[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        twice = np.diff(first, append=len(cell)) > 1
        if len(first):
            twice |= np.logical_or.reduceat(often, first)
        cell = cell[first]
        for tile, a, b in by_tile(cell, tile_bits):
            yield row, tile, packed(cell[a:b] & np.uint64((1 << tile_bits) - 1)), np.packbits(twice[a:b]).tobytes()


def estimated(windows: Windows, prints: np.ndarray, answers: list[dict], bits: int, tile_bits: int) -> np.ndarray:
    """For each of ``prints`` whether all its cells of the merged sketch count 2 or more."""
    values, at = np.unique(prints, return_inverse=True)
    found = {(x["row"], x["tile"]): x["marks"] for x in answers}
    out = np.ones(len(values), bool)
    for row, cell in enumerate(cells(values, bits)):
        own, back = np.unique(cell, return_inverse=True)
        marks = np.zeros(len(own), bool)
        for tile, a, b in by_tile(own, tile_bits):
            marks[a:b] = np.unpackbits(np.frombuffer(found[row, tile], np.uint8), count=b - a)
        out &= marks[back]
    return out[at]


def merge_tile(table):
    """The sum of one tile of all partition sketches, and for each of their cells whether it is 2 or more."""
    size, lists = 0, []
    for data in table.column("cells").to_pylist():
        lists.append(unpacked(data))
        size = max(size, int(lists[-1][-1]) + 1)
    total = np.zeros(size, np.uint8)
    for own, twice in zip(lists, table.column("twice").to_pylist()):
        total[own] = np.minimum(total[own] + 1 + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(own)), 2)
    marks = pa.array([np.packbits(total[own] > 1).tobytes() for own in lists], pa.binary())
    return pa.table({"chunk": table.column("chunk"), "row": table.column("row"), "tile": table.column("tile"), "marks": marks})


def first_holders(table):
    """For each window of each chunk whether another chunk has it in a document with a smaller id."""
    sizes, high, low, ids = [], [], [], []
    for h, w, i in zip(*(table.column(c).to_pylist() for c in ("high", "low", "ids"))):
        high.append(np.frombuffer(h, np.uint64))
        low.append(np.frombuffer(w, np.uint32))
        ids.append(np.frombuffer(i, np.int64))
        sizes.append(len(ids[-1]))
    h, w, i = np.concatenate(high), np.concatenate(low), np.concatenate(ids)
    order = np.lexsort((i, w, h))
    h, w, sorted_ids = h[order], w[order], i[order]
    first = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
    least = np.empty(len(i), np.int64)
    least[order] = sorted_ids[np.flatnonzero(first)][np.cumsum(first) - 1]
    parts = np.split(least < i, np.cumsum(sizes)[:-1])
    return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "marks": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})


class Candidates:
    """The windows of a chunk that the merged sketch estimates as repeated, in the order of their hashes."""

    def __init__(self, windows: Windows, answers: list[dict], bits: int, tile_bits: int):
        prints = windows.fingerprints()
        at = windows.valid[estimated(windows, prints, answers, bits, tile_bits)] if answers else windows.valid[:0]
        high, low = windows.hashes(at)
        ids = windows.ids[windows.doc[at]]
        order = np.lexsort((ids, low, high))
        self.at, self.ids, high, low = at[order], ids[order], high[order], low[order]
        new = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        first = np.concatenate(([True], new)) if len(at) else np.zeros(0, bool)
        self.first, self.group = np.flatnonzero(first), np.cumsum(first) - 1
        self.high, self.low, self.least = high[self.first], low[self.first], self.ids[self.first]

    def ranges(self, number: int):
        """(range, from, to) of the distinct windows."""
        part = ((self.high >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
        return by_tile(part, 0)

    def repeated(self, answers: list[dict], number: int) -> np.ndarray:
        """The first words of the windows that a document with a smaller id has too."""
        elsewhere = np.zeros(len(self.first), bool)
        found = {x["range"]: x["marks"] for x in answers}
        for part, a, b in self.ranges(number):
            elsewhere[a:b] = np.unpackbits(np.frombuffer(found[part], np.uint8), count=b - a)
        return self.at[elsewhere[self.group] | (self.ids > self.least[self.group])]


def removed_words(docs: DataFrame, window: int = WINDOW, chunk: int = CHUNK, cells_per_print: int = CELLS, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row of ``docs``; with ``texts`` also ``kept``, the words that stay.

    A word goes if a ``window`` of words around it also starts in a document with a smaller id.

    First pass: every chunk of documents counts its windows' fingerprints in a count-min sketch,
    sized by the corpus and kept without its empty cells; sketches are summed tile by tile, and
    each chunk learns which of its cells reach 2. As sums of cells are never below a window's
    count, no repeated window is lost. Second pass: the windows whose cells all reach 2 are grouped
    by 96 bits of hash, each distinct one once per chunk with its least id, and each chunk learns
    which of its windows have a smaller id elsewhere. So a window of very many documents comes once
    per chunk to a task, and nothing is sent to all tasks or to the driver but the number of words.

    Null and empty texts have no words. Rows with a null id keep all words and take none from
    others; rows with one id take nothing from each other (neither is smaller), so repeated rows
    give equal rows. An empty table gives none; a very long text is a chunk by itself; other
    columns of ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    # a chunk is a row of megabytes
    held = materialize(chunks(docs, chunk), wide=True)
    n_words = held.agg(F.sum("n_words")).first()[0] or 0
    # a window's fingerprint changes about twice every width - width // 2 + 1 words
    prints = max(1, 2 * n_words // (window - window // 2 + 2))
    bits = max(TILE_BITS[0], (cells_per_print * prints - 1).bit_length())
    tile_bits = min(max(TILE_BITS[0], bits - TILES.bit_length() + 1), TILE_BITS[1])
    ranges = max(RANGES, -(-n_words // RANGE))

    def rows_of(batches, columns):
        windows = Windows(window)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(columns)}
                windows.load(row["doc_ids"], np.array(row["ends"], np.int64), row["data"])
                yield row, windows

    def sketch(batches):
        for row, windows in rows_of(batches, COLUMNS):
            found = list(partition_sketch(windows, windows.fingerprints(), bits, tile_bits))
            if found:
                numbers, tiles, own, twice = zip(*found)
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([row["chunk"]] * len(own)), "row": pa.array(numbers, pa.int32()), "tile": pa.array(tiles, pa.int64()), "cells": pa.array(own, pa.binary()), "twice": pa.array(twice, pa.binary())}
                )

    sketches = held.mapInArrow(sketch, "chunk long, row int, tile long, cells binary, twice binary")
    merged = sketches.groupBy("row", "tile").applyInArrow(merge_tile, "chunk long, row int, tile long, marks binary")
    marks = materialize(merged.groupBy("chunk").agg(F.collect_list(F.struct("row", "tile", "marks")).alias("marks")))

    def ask(batches):
        for row, windows in rows_of(batches, [*COLUMNS, "marks"]):
            found = Candidates(windows, row["marks"], bits, tile_bits)
            parts = list(found.ranges(ranges))
            if parts:
                cut = lambda x: pa.array([x[a:b].tobytes() for _, a, b in parts], pa.binary())
                yield pa.RecordBatch.from_pydict(
                    {"chunk": pa.array([row["chunk"]] * len(parts)), "range": pa.array([p for p, _, _ in parts], pa.int64()), "high": cut(found.high), "low": cut(found.low), "ids": cut(found.least)}
                )

    asked = held.join(marks, "chunk").mapInArrow(ask, "chunk long, range long, high binary, low binary, ids binary")
    settled = asked.groupBy("range").applyInArrow(first_holders, "chunk long, range long, marks binary")
    holders = materialize(settled.groupBy("chunk").agg(F.collect_list(F.struct("range", "marks")).alias("holders")))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")

    def finish(batches):
        for row, windows in rows_of(batches, [*COLUMNS, "marks", "holders"]):
            at = Candidates(windows, row["marks"] or [], bits, tile_bits).repeated(row["holders"] or [], ranges)
            change = np.zeros(len(windows.words) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            keep = np.cumsum(change[:-1]) == 0
            bounds = np.searchsorted(windows.doc, np.arange(len(row["ends"]) + 1))
            kept = np.concatenate(([0], np.cumsum(keep)))[bounds]
            n, stay = np.diff(bounds), np.diff(kept)
            out, start = [], 0
            for i, end in enumerate(row["ends"]):
                found = row["data"][start : end - 1].split()
                if stay[i] < n[i]:
                    found = compress(found, keep[bounds[i] : bounds[i + 1]].tolist())
                out.append(b" ".join(found))
                start = end
            columns = [row["doc_ids"], n, n - stay, [hashlib.sha256(x).hexdigest() for x in out]]
            arrays = [pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 3 + [pa.string()])]
            if texts:
                arrays.append(pa.array(out, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    # Spark sends the answers to all tasks only where it finds them below its own size bound
    answered = marks.join(holders, "chunk", "left")
    whole = held.join(answered, "chunk", "left").select(*COLUMNS, "marks", "holders")
    return whole.mapInArrow(finish, schema)
