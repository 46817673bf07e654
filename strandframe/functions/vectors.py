"""Vector expressions and the batch kernel of read embedding (inventory E2, E4, K2)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import read_folder

DENSE_MAX_K = 11
# reads whose vectors are added up at once, as their sums stay in a core's cache, and vectors of a read that goes by itself
GROUP = 256
LONG = 1_024


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column | str) -> Column:
    """E4. x / |x|, unchanged when the norm is 0. The norm is bound once, not per element."""
    v = _col(v)
    scaled = F.transform(F.array(norm(v)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))
    return F.get(scaled, F.lit(0))


def cosine(a: Column | str, b: Column | str) -> Column:
    """K2. dot / (|a| |b|), 0 when a norm is 0."""
    scale = norm(a) * norm(b)
    return F.coalesce(dot(a, b) / F.nullif(scale, F.lit(0.0)), F.lit(0.0))


def vector_sums(v: str, dim: int, how=F.sum) -> Column:
    """Array of per-dimension aggregates of an array column."""
    return F.array(*[how(F.get(v, F.lit(i))) for i in range(dim)])


@dataclass
class VectorTable:
    """Vectors by k-mer code, for tasks that hold the whole table.

    Broadcasts carry its ``fields`` only: plain values load on workers that don't have this package.
    """

    k: int
    codes: np.ndarray
    matrix: np.ndarray
    unk_row: int

    def fields(self) -> tuple:
        return self.k, self.codes, self.matrix, self.unk_row

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, -1 when unknown."""
        if not len(self.codes):
            return np.full(len(codes), -1, dtype=np.int64)
        if len(self.codes) == 1 << (2 * self.k) and np.array_equal(self.codes, np.arange(len(self.codes))):
            return codes
        if self.k <= DENSE_MAX_K and 1 << (2 * self.k) <= len(codes):
            # the last place is that of code -1
            place = np.full((1 << (2 * self.k)) + 1, -1, np.int64)
            place[self.codes] = np.arange(len(self.codes))
            return place[codes]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)


DIGIT = np.full(256, 4, dtype=np.int64)
for _i, _base in enumerate(b"ACGT"):
    DIGIT[_base] = _i


_DIGIT = DIGIT.astype(np.uint8)


def _joined(x: np.ndarray, k: int, join) -> np.ndarray:
    """Value of every window of ``k`` places from values of single ones, by windows of 1, 2, 4, ... places.

    ``join(x, y, s, k)`` makes the value of ``k`` places of those of its first and of its last ``s``.
    """
    s = 1
    while s < k:
        span = min(2 * s, k)
        x = join(x[: len(x) - (span - s)], x[span - s :], s, span)
        s = span
    return x


def _plain(x: np.ndarray, y: np.ndarray, s: int, k: int) -> np.ndarray:
    return x | y >> 2 * (2 * s - k) << 2 * s


def _back(x: np.ndarray, y: np.ndarray, s: int, k: int) -> np.ndarray:
    return x << 2 * (k - s) | y & (1 << 2 * (k - s)) - 1


def kmer_codes(reads: list[str], k: int, strand: str | None, turned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(read number, code) of every k-mer window in order; code -1 for ambiguous ones.

    ``turned`` looks for ambiguous letters in the canonical k-mer (C5): a U, whose complement is A, is none
    there if the k-mer is flipped. Without ``strand`` k-mers stay as they are.
    """
    lengths = np.fromiter((len(r) for r in reads), dtype=np.int64, count=len(reads))
    text = "".join(reads).encode("ascii", "replace")
    n = len(text) - k + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty
    letters = np.frombuffer(text, dtype=np.uint8)
    digit = _DIGIT[letters]
    # a window with a U counts only if it is flipped
    rna = letters == ord("U") if turned and strand is not None and b"U" in text else None
    if rna is not None:
        digit = np.where(rna, np.uint8(3), digit)
    either = lambda x, y, s, k: x | y
    bad = _joined(digit > 3, k, either)
    if rna is not None:
        bad = bad | _joined(rna, k, either) & (digit[:n] <= 1)
    known = (digit & 3).astype(np.int32 if k <= 15 else np.int64)
    code = _joined(known, k, _plain)
    if strand is not None:
        # a letter's complement is 3 less its digit
        flipped = (1 << (2 * k)) - 1 - (_joined(known, k, _back) if strand == "revcomp" else code)
        code = np.where(digit[:n] <= 1, code, flipped)
    code[bad] = -1
    # windows that go on into the next read
    inside = np.ones(len(text), bool)
    ends = np.cumsum(lengths)
    for i in range(1, k):
        inside[ends[lengths >= i] - i] = False
    return np.repeat(np.arange(len(reads)), np.maximum(lengths - (k - 1), 0)), code[inside[:n]].astype(np.int64)


def row_sums(matrix: np.ndarray, row: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the rows ``row`` of a matrix, ``sizes`` of them from ``starts`` on, one after the other.

    The first rows of ``GROUP`` sums are added, then their second ones and so on, the longest sums first.
    """
    out = np.zeros((len(starts), matrix.shape[1]))
    for i in np.flatnonzero(sizes > LONG):
        for at in range(starts[i], starts[i] + sizes[i], LONG):
            out[i] += matrix[row[at : min(at + LONG, starts[i] + sizes[i])]].sum(0)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] <= LONG]
    part = np.empty((min(GROUP, len(order)), matrix.shape[1]))
    for first in range(0, len(order), GROUP):
        own = order[first : first + GROUP]
        size = sizes[own]
        places = np.arange(size[0])
        rows = np.take(row, starts[own] + places[:, None], mode="clip")
        total = matrix[rows[0]]
        # how many sums have more than i rows
        for i, m in enumerate(np.searchsorted(-size, -places, "left").tolist()):
            if i:
                total[:m] += np.take(matrix, rows[i, :m], axis=0, out=part[:m], mode="clip")
        out[own] = total
    return out


def _sums(reads: list[str], table: VectorTable, strand: str, turned: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Per read the sum of the vectors of its known k-mers, and their number."""
    out = np.zeros((len(reads), table.matrix.shape[1]))
    owner, code = kmer_codes(reads, table.k, strand, turned)
    row = table.rows(code)
    if table.unk_row >= 0 and len(row):
        unknown = row < 0
        follows = np.zeros(len(row), dtype=bool)
        follows[1:] = unknown[:-1] & (owner[1:] == owner[:-1])
        row = np.where(unknown & ~follows, table.unk_row, row)
    known = row >= 0
    n = np.bincount(owner[known], minlength=len(reads))
    ids = np.flatnonzero(n)
    if len(ids):
        out[ids] = row_sums(table.matrix, row[known], (np.cumsum(n) - n)[ids], n[ids])
    return out, n


def embed_batch(reads: list[str], table: VectorTable, strand: str, mean: bool) -> np.ndarray:
    """Per read the mean (or sum) of the vectors of its known k-mers; zeros when there are none."""
    out, n = _sums(reads, table, strand)
    if mean:
        out /= np.maximum(n, 1)[:, None]
    return out


def embedder(shared, strand: str, mean: bool):
    """Arrow function read -> vector over the broadcast fields of a ``VectorTable``."""

    def run(reads: pa.Array) -> pa.Array:
        texts = [r or "" for r in reads.to_pylist()]
        vectors = embed_batch(texts, VectorTable(*shared.value), strand, mean)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * vectors.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

    run.__annotations__ = {"reads": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))


# the block a Python worker read last; tasks with a table of one block read it once
_LAST: dict = {}


def _load_vectors(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes, matrix) of a block of vectors (code, vector), by code; empty if there is none."""
    if folder not in _LAST:
        _LAST.clear()
        found = read_folder(folder, ["code", "vector"], [pa.int64(), pa.list_(pa.float64())]).combine_chunks()
        codes, vectors = (pa.concat_arrays(found.column(c).chunks) if len(found) else pa.array([]) for c in ("code", "vector"))
        codes = codes.to_numpy().astype(np.int64)
        matrix = vectors.flatten().to_numpy().reshape(len(codes), -1) if len(codes) else np.zeros((0, 0))
        order = np.argsort(codes, kind="stable")
        _LAST[folder] = codes[order], matrix[order]
    return _LAST[folder]


# rows and letters that a task holds while it goes through the blocks
HELD_ROWS = 1 << 17
HELD_LETTERS = 1 << 24


def block_embedder(folders: list[str], dim: int, k: int, strand: str, mean: bool, at: int, out: str):
    """Function of batches that appends the vector of the read in column ``at``, from blocks of the vector table.

    A task goes through all blocks once for the reads it holds and adds up what each block knows of a read.
    """

    def embedded(held: list[pa.RecordBatch]):
        texts = [[r or "" for r in batch.column(at).to_pylist()] for batch in held]
        sums = [np.zeros((len(t), dim)) for t in texts]
        counts = [np.zeros(len(t), np.int64) for t in texts]
        for folder in folders:
            table = VectorTable(k, *_load_vectors(folder), -1)
            if not len(table.codes):
                continue
            for text, total, n in zip(texts, sums, counts):
                found, known = _sums(text, table, strand, turned=True)
                total += found
                n += known
        for batch, total, n in zip(held, sums, counts):
            if mean:
                total[n > 0] /= n[n > 0, None]
            offsets = np.arange(len(total) + 1, dtype=np.int32) * dim
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, out])

    def run(batches):
        held, rows, letters = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            letters += batch.column(at).nbytes
            if rows >= HELD_ROWS or letters >= HELD_LETTERS:
                yield from embedded(held)
                held, rows, letters = [], 0, 0
        if held:
            yield from embedded(held)

    return run


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, without a negative zero."""
    scale = 10.0**digits
    return np.copysign(np.floor(np.abs(values) * scale + 0.5) / scale, values) + 0.0


def wide_embedder(shared, strand: str, mean: bool, at: int, kept: list[int], digits: int | None):
    """Function of batches: the columns ``kept`` and a column per dimension of the vector of the read in column ``at``."""

    def run(batches):
        for batch in batches:
            texts = [r or "" for r in batch.column(at).to_pylist()]
            vectors = embed_batch(texts, VectorTable(*shared.value), strand, mean)
            vectors = np.ascontiguousarray((vectors if digits is None else rounded(vectors, digits)).T)
            names = [batch.schema.names[i] for i in kept] + [str(i) for i in range(len(vectors))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *map(pa.array, vectors)], names)

    return run


def embed_words(sentences: pa.Array, words: list[str], matrix: np.ndarray) -> np.ndarray:
    """Per sentence the mean of the vectors of its known words; zeros when there are none."""
    out = np.zeros((len(sentences), matrix.shape[1]))
    lists = pc.split_pattern(sentences.fill_null(""), " ")
    row = pc.index_in(lists.flatten(), pa.array(words, pa.string())).fill_null(-1).to_numpy()
    owner = pc.list_parent_indices(lists).to_numpy()
    known = row >= 0
    n = np.bincount(owner[known], minlength=len(out))
    ids = np.flatnonzero(n)
    if len(ids):
        out[ids] = row_sums(matrix, row[known], (np.cumsum(n) - n)[ids], n[ids]) / n[ids, None]
    return out


def word_embedder(shared):
    """Arrow function sentence -> vector over broadcast (words, matrix)."""

    def run(sentences: pa.Array) -> pa.Array:
        vectors = embed_words(sentences.cast(pa.string()), *shared.value)
        offsets = np.arange(len(sentences) + 1, dtype=np.int32) * vectors.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))

    run.__annotations__ = {"sentences": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.DoubleType()))
