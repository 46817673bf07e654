"""Operator 4: order-preserving packing by dynamic programming."""

from __future__ import annotations

import base64
import zlib
from collections import deque

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SPECIAL, SPECIAL_ID, pieces, texts

LENGTH = 2048
END = 1
VOCABULARY = "byte_bpe_50k.tiktoken"
SENTENCE_COST = 8
WORD_COST = 64
BLOCK = 1 << 21
CACHE = 400_000


class Ids(dict):
    """Ids of a piece as little-endian 32-bit bytes; forgets all when it holds too many pieces."""

    def __init__(self, coder: tiktoken.Encoding):
        super().__init__()
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = [SPECIAL_ID] if piece == SPECIAL else self.coder.encode_ordinary(piece)
        value = self[piece] = np.array(ids, "<u4").tobytes()
        return value


def coder(vocabulary: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer, and by id whether a sentence ends with it."""
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    ends = np.zeros(max(SPECIAL_ID, *ranks.values()) + 1, bool)
    for piece, i in ranks.items():
        ends[i] = piece.rstrip(b"\"')")[-1:] in (b".", b"!", b"?") or piece.endswith(b"\n")
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ends


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, and the cost of ending there.

    Documents' ends are free, sentences' ends cost a little. Where neither comes for long, every
    ``length / 8`` ids is a place at a higher cost.
    """
    sentence = np.flatnonzero(ends[ids]) + 1
    at = np.union1d(np.concatenate(([0], sentence)), doc_ends)
    gaps = np.diff(at)
    step = max(1, length // 8)
    wide = np.flatnonzero(gaps > step)
    more = [np.arange(at[i] + step, at[i + 1], step) for i in wide]
    inside = np.concatenate([np.zeros(0, np.int64), *more])
    cost = np.concatenate((np.full(len(at), SENTENCE_COST), np.full(len(inside), WORD_COST)))
    at = np.concatenate((at, inside))
    order = np.argsort(at, kind="stable")
    at, cost = at[order], cost[order]
    cost[np.isin(at, doc_ends)] = 0
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, length: int) -> np.ndarray:
    """The cuts among ``at`` (first 0, gaps of at most ``length``) with the least padding plus costs.

    best[i] = cost[i] + length - at[i] + min(best[j] + at[j]) over at[j] >= at[i] - length: the
    minimum slides, so a monotone queue gives it in constant time. A window whose length is a
    power of two has no padding; such predecessors are looked up apart.
    """
    exact: dict[int, list[int]] = {}
    size = 1
    while size < length:
        j = np.searchsorted(at, at - size)
        for i in np.flatnonzero((at >= size) & (at[np.minimum(j, len(at) - 1)] == at - size)).tolist():
            exact.setdefault(i, []).append(int(j[i]))
        size *= 2
    place, price = at.tolist(), cost.tolist()
    best, back, key = [0] * len(place), [0] * len(place), [0] * len(place)
    queue: deque[int] = deque()
    for i in range(1, len(place)):
        j = i - 1
        key[j] = k = best[j] + place[j]
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
        here = place[i]
        while place[queue[0]] < here - length:
            queue.popleft()
        least, by = key[queue[0]] + length - here, queue[0]
        for j in exact.get(i, ()):
            if best[j] < least:
                least, by = best[j], j
        best[i], back[i] = least + price[i], by
    cuts, i = [place[-1]], len(place) - 1
    while i:
        i = back[i]
        cuts.append(place[i])
    return np.array(cuts[::-1], np.int64)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``length`` ids, one row per piece.

    Every input partition is packed by itself in the order of its rows, in blocks of about
    ``BLOCK`` ids, so nothing is shuffled and memory is bounded; a lost task is run again with
    the same result. A document's ids are those of its text and ``END``. The ids come from a
    fast coder over the same vocabulary, once per distinct piece of text and task; they equal
    those of the library that the vocabulary's file is for (tested).

    Null or empty text is the single id ``END``; very long texts go on over many sequences;
    repeated rows and null ids are packed like others; an empty table gives no piece.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        encoding, ends = coder(vocabulary)
        cache = Ids(encoding)
        end = np.array([END], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        held: list[bytes] = []
        names_held: list = []
        total = 0

        def packed():
            nonlocal first
            data = b"".join(held)
            ids = np.frombuffer(data, "<u4")
            sizes = np.array([len(x) // 4 for x in held], np.int64)
            doc_ends = np.cumsum(sizes)
            cuts = best_cuts(*boundaries(ids, doc_ends, ends, length), length)
            stops = np.union1d(cuts[1:], doc_ends)
            starts = np.concatenate(([0], stops[:-1]))
            doc, sequence = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(cuts, starts, "right") - 1
            view = memoryview(data)
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), stops.tolist())]
            columns = [
                pa.array([names_held[i] for i in doc.tolist()], pa.int64()),
                *(pa.array(x, pa.int64()) for x in (starts - (doc_ends - sizes)[doc], stops - starts, crc, sizes[doc], first + sequence, starts - cuts[sequence])),
            ]
            first += len(cuts) - 1
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                held.append(b"".join(map(cache.__getitem__, pieces(text))) + end)
                names_held.append(doc_id)
                total += len(held[-1]) // 4
                if total >= BLOCK:
                    yield packed()
                    held, names_held, total = [], [], 0
        if held:
            yield packed()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
