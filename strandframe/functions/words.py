"""Batch kernels of k-mer words: codes of whole batches of reads instead of one expression per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import DIGIT, kmer_codes

# a code has two bits a letter in a signed 64-bit number
MAX_K = 31
# letters that a task codes at once
LETTERS = 1 << 20
# rows of counts that a task holds before it adds them up, and hands on if they stay many
HELD = 1 << 21

_BASES = np.frombuffer(b"ACGT", np.uint8)


def texts(codes: np.ndarray, k: int) -> pa.Array:
    """The k-mers of codes of the form C1."""
    letters = np.empty((len(codes), k), np.uint8)
    for i in range(k):
        letters[:, i] = _BASES[(codes >> (2 * i)) & 3]
    offsets = np.arange(len(codes) + 1, dtype=np.int64) * k
    # 32-bit offsets, as a text in Spark has less than 2 GB too
    return pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(offsets), pa.py_buffer(letters)).cast(pa.string())


def places(owner: np.ndarray) -> np.ndarray:
    """0-based place of each window in its read; windows of a read are in order."""
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else owner
    return np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))


def parts(reads: list[str | None], most: int = LETTERS) -> Iterator[list[str]]:
    """Whole reads, about ``most`` letters at a time; a null read is empty."""
    part, size = [], 0
    for read in reads:
        read = read or ""
        if part and size + len(read) > most:
            yield part
            part, size = [], 0
        part.append(read)
        size += len(read)
    if part:
        yield part


def _lists(owner: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _windows(reads: list[str], k: int, s: int, strand: str | None) -> tuple[np.ndarray, np.ndarray]:
    owner, code = kmer_codes(reads, k, strand, turned=True)
    if s > 1:
        kept = places(owner) % s == 0
        owner, code = owner[kept], code[kept]
    return owner, code


def known_words(reads: list[str], k: int, s: int, strand: str | None) -> pa.Array:
    """Per read the list of its k-mers of A, C, G and T."""
    owner, code = _windows(reads, k, s, strand)
    known = code >= 0
    return _lists(owner[known], texts(code[known], k), len(reads))


def sentences(reads: list[str], k: int, s: int, strand: str | None, unk: str) -> pa.Array:
    """Per read its k-mers joined by blanks, runs of ambiguous ones as one ``unk``."""
    owner, code = _windows(reads, k, s, strand)
    unknown = code < 0
    follows = np.zeros(len(code), bool)
    follows[1:] = unknown[:-1] & (owner[1:] == owner[:-1])
    kept = ~(unknown & follows)
    owner, code, unknown = owner[kept], code[kept], unknown[kept]
    words = texts(np.maximum(code, 0), k)
    if unknown.any():
        words = pc.if_else(pa.array(unknown), pa.scalar(unk, pa.string()), words)
    return pc.binary_join(_lists(owner, words, len(reads)), " ")


def _over_parts(kernel, kind: pa.DataType, spark_type: T.DataType, once: bool = False):
    """Arrow function read -> value of a kernel over lists of reads; ``once``: filters on the value don't compute it again."""

    def run(reads: pa.Array) -> pa.Array:
        found = [kernel(part).cast(kind) for part in parts(reads.to_pylist())]
        return pa.concat_arrays(found) if found else pa.array([], kind)

    run.__annotations__ = {"reads": pa.Array, "return": pa.Array}
    found = F.arrow_udf(run, spark_type)
    return found.asNondeterministic() if once else found


def known_words_column(read: Column, k: int, s: int, strand: str | None) -> Column:
    return _over_parts(lambda reads: known_words(reads, k, s, strand), pa.list_(pa.string()), T.ArrayType(T.StringType()))(read)


def sentence_column(read: Column, k: int, s: int, strand: str | None, unk: str) -> Column:
    return _over_parts(lambda reads: sentences(reads, k, s, strand, unk), pa.string(), T.StringType())(read)


def plain_words(reads: list[str], k: int, s: int) -> pa.Array:
    """Per read the list of its substrings of k letters, as they are."""
    sizes = np.fromiter((max(0, (len(r) - k) // s + 1) for r in reads), np.int64, len(reads))
    text = "".join(reads)
    if text.isascii():
        lengths = np.fromiter(map(len, reads), np.int64, len(reads))
        owner = np.repeat(np.arange(len(reads)), sizes)
        starts = (np.cumsum(lengths) - lengths)[owner] + places(owner) * s
        letters = np.frombuffer(text.encode(), np.uint8)
        data = np.empty((len(starts), k), np.uint8)
        for i in range(k):
            data[:, i] = letters[starts + i]
        offsets = np.arange(len(starts) + 1, dtype=np.int64) * k
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())
    else:
        words = pa.array([r[i : i + k] for r in reads for i in range(0, len(r) - k + 1, s)], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), words)


def plain_words_column(read: Column, k: int, s: int) -> Column:
    return _over_parts(lambda reads: plain_words(reads, k, s), pa.list_(pa.string()), T.ArrayType(T.StringType()))(read)


def canonical_sentences(reads: list[str], k: int, complement: tuple[str, str]) -> pa.Array:
    """Per read its canonical k-mers joined by blanks, ambiguous ones as they are; ``complement``: letters and what they become."""
    text = "".join(reads)
    if not text.isascii():
        flip = str.maketrans(*complement)
        canonical = lambda w: w if w[0] in "AC" else w.translate(flip)[::-1]
        return pa.array([" ".join(canonical(r[i : i + k]) for i in range(len(r) - k + 1)) for r in reads], pa.string())
    lengths = np.fromiter(map(len, reads), np.int64, len(reads))
    sizes = np.maximum(lengths - (k - 1), 0)
    letters = np.frombuffer(text.encode(), np.uint8)
    n = max(0, len(letters) - k + 1)
    other = np.arange(256, dtype=np.uint8)
    other[list(complement[0].encode())] = list(complement[1].encode())
    other = other[letters]
    stays = (letters[:n] == ord("A")) | (letters[:n] == ord("C"))
    data = np.full((n, k + 1), ord(" "), np.uint8)
    for i in range(k):
        data[:, i] = np.where(stays, letters[i : i + n], other[k - 1 - i : k - 1 - i + n])
    # neither windows that go on into the next read nor the blank after a read's last one
    kept = np.ones((n + k, k + 1), bool)
    ends = np.cumsum(lengths)
    for i in range(1, k):
        kept[ends[lengths >= i] - i] = False
    kept[ends[sizes > 0] - k, k] = False
    data = data[kept[:n]]
    offsets = np.concatenate(([0], np.cumsum(np.maximum(sizes * (k + 1) - 1, 0))))
    return pa.LargeStringArray.from_buffers(len(reads), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def canonical_sentence_column(read: Column, k: int, complement: tuple[str, str]) -> Column:
    return _over_parts(lambda reads: canonical_sentences(reads, k, complement), pa.string(), T.StringType())(read)


def codes_of(words: pa.Array) -> pa.Array:
    """C1 of words of up to 31 letters, null for those that are not all of ACGT."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    digit = DIGIT[np.frombuffer(words.buffers()[2] or b"", np.uint8)]
    code = np.zeros(len(words), np.int64)
    sizes = np.where(words.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    known = (sizes > 0) & (sizes <= MAX_K)
    for i in range(int(sizes[known].max(initial=0))):
        at = np.flatnonzero(known & (sizes > i))
        letter = digit[offsets[at] + i]
        known[at[letter > 3]] = False
        code[at] += letter << (2 * i)
    return pa.array(code, mask=~known)


def codes_column(words: Column) -> Column:
    """``codes_of`` the elements of an array."""

    def run(lists: pa.Array) -> pa.Array:
        values = codes_of(lists.flatten())
        offsets = lists.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), values, mask=lists.is_null())

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    # a filter on the codes would otherwise code all words a second time
    return F.arrow_udf(run, T.ArrayType(T.LongType())).asNondeterministic()(words)


def acgt_words(lists: pa.Array) -> pa.Array:
    """Lists of words without those that hold other letters than A, C, G and T, or are null; an empty word stays."""
    words = lists.flatten().cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    bad = np.concatenate(([0], np.cumsum(DIGIT[np.frombuffer(words.buffers()[2] or b"", np.uint8)] > 3)))
    kept = (bad[offsets[1:]] == bad[offsets[:-1]]) & words.is_valid().to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(kept)))
    bounds = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
    return pa.ListArray.from_arrays(pa.array(upto[bounds], pa.int32()), words.filter(pa.array(kept)).cast(pa.string()), mask=lists.is_null())


def acgt_column(words: Column) -> Column:
    """``acgt_words`` of a column; counts and filters on it don't compute it again."""

    def run(lists: pa.Array) -> pa.Array:
        return acgt_words(lists)

    run.__annotations__ = {"lists": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.StringType())).asNondeterministic()(words)


def _found(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Place of each code among the sorted ``codes``, -1 where it is none of them."""
    if not len(codes):
        return np.full(len(code), -1, np.int64)
    at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    return np.where(codes[at] == code, at, -1)


def tokens_column(read: Column, shared, k: int, strand: str | None) -> Column:
    """Ids of the k-mers of a read over broadcast (sorted codes, ids, id of unknown ones); runs of unknown ones are one."""

    def tokens(reads: list[str]) -> pa.Array:
        codes, ids, unk = shared.value
        owner, code = kmer_codes(reads, k, strand, turned=True)
        at = _found(codes, code)
        unknown = at < 0
        follows = np.zeros(len(code), bool)
        follows[1:] = unknown[:-1] & (owner[1:] == owner[:-1])
        kept = ~(unknown & follows)
        values = np.where(unknown, unk, ids[at] if len(ids) else unk)
        return _lists(owner[kept], pa.array(values[kept], pa.int32()), len(reads))

    return _over_parts(tokens, pa.list_(pa.int32()), T.ArrayType(T.IntegerType()))(read)


def chosen_words_column(read: Column, shared, k: int, strand: str | None) -> Column:
    """The k-mers of a read that are among the broadcast sorted codes."""

    def chosen(reads: list[str]) -> pa.Array:
        owner, code = kmer_codes(reads, k, strand, turned=True)
        met = (code >= 0) & (_found(shared.value, code) >= 0)
        return _lists(owner[met], texts(code[met], k), len(reads))

    return _over_parts(chosen, pa.list_(pa.string()), T.ArrayType(T.StringType()))(read)


def code_counts_column(read: Column, k: int, strand: str | None) -> Column:
    """(code, n) of the distinct unambiguous k-mers of a read, by code."""
    item = pa.struct([("code", pa.int64()), ("n", pa.int64())])

    def counts(reads: list[str]) -> pa.Array:
        owner, code = kmer_codes(reads, k, strand, turned=True)
        owner, code = owner[code >= 0], code[code >= 0]
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(code)))
        pairs = pa.StructArray.from_arrays([pa.array(code[first], pa.int64()), pa.array(n, pa.int64())], fields=list(item))
        return _lists(owner[first], pairs, len(reads))

    fields = T.StructType([T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])
    return _over_parts(counts, pa.list_(item), T.ArrayType(fields), once=True)(read)


def tiled(owner: np.ndarray, reads: list[str | None], k: int, s: int, most: int = LETTERS) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(owners, pieces) of about ``most`` letters: a longer read in pieces that together have each of its windows once."""
    step = max(1, most // s) * s
    sizes = np.fromiter((len(r) if r else 0 for r in reads), np.int64, len(reads))
    if sizes.max(initial=0) <= step:
        # no read is cut
        upto, first = np.cumsum(sizes), 0
        while first < len(reads):
            last = max(first + 1, int(np.searchsorted(upto, upto[first] - sizes[first] + most, "right")))
            yield owner[first:last], [r or "" for r in reads[first:last]]
            first = last
        return
    rows, pieces, size = [], [], 0
    for row, read in zip(owner.tolist(), reads):
        for at in range(0, max(1, len(read or "") - k + 1), step):
            piece = (read or "")[at : at + step + k - 1]
            if pieces and size + len(piece) > most:
                yield np.array(rows), pieces
                rows, pieces, size = [], [], 0
            rows.append(row)
            pieces.append(piece)
            size += len(piece)
    if pieces:
        yield np.array(rows), pieces


def _added(tables: list[pa.Table], by: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"])


def _adding(count, by: list[str]):
    """Function of batches that adds up the tables (by..., n) that ``count`` makes of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for table in count(batch):
                held.append(table)
                rows += len(table)
                if rows > HELD:
                    held = [_added(held, by)]
                    rows = len(held[0])
                    if rows > HELD // 2:
                        yield from held[0].to_batches(max_chunksize=1 << 16)
                        held, rows = [], 0
        if rows:
            yield from _added(held, by).to_batches(max_chunksize=1 << 16)

    return run


def pair_counter(window: int):
    """Function of batches of lists of words -> (a, b, d, n): words d places apart, 1 <= d <= window, counted; a null is a word too."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        lists = batch.column(0)
        flat = lists.flatten().dictionary_encode()
        words = pa.concat_arrays([flat.dictionary, pa.nulls(1, flat.dictionary.type)])
        word = pc.fill_null(flat.indices, len(words) - 1).to_numpy().astype(np.int64)
        owner = pc.list_parent_indices(lists).to_numpy()
        for lo in range(0, len(word), LETTERS):
            for d in range(1, window + 1):
                left = slice(lo, max(lo, min(lo + LETTERS, len(word) - d)))
                right = slice(left.start + d, left.stop + d)
                a, b = word[left], word[right]
                near = owner[left] == owner[right]
                pair, n = np.unique(a[near] * len(words) + b[near], return_counts=True)
                a, b = (words.take(pa.array(x)) for x in np.divmod(pair, len(words)))
                yield pa.table({"a": a, "b": b, "d": pa.array(np.full(len(pair), d, np.int32)), "n": pa.array(n, pa.int64())})

    return _adding(count, ["a", "b", "d"])


def counter(k: int, s: int, strand: str | None, by: list[str]):
    """Function of batches (by..., read) -> (by..., code, n): the unambiguous k-mers of a task's reads, counted."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        groups = pa.table(batch.select(by)).append_column("__row", pa.array(np.arange(len(batch))))
        if by:
            groups = groups.group_by(by, use_threads=False).aggregate([("__row", "list")])
            members = groups.column("__row_list").combine_chunks()
            own = np.empty(len(batch), np.int64)
            own[members.flatten().to_numpy()] = np.repeat(np.arange(len(groups)), np.diff(members.offsets.to_numpy()))
            groups = groups.select(by)
        else:
            groups, own = groups.slice(0, 1), np.zeros(len(batch), np.int64)
        for rows, pieces in tiled(own, batch.column("read").to_pylist(), k, s):
            owner, code = kmer_codes(pieces, k, strand)
            if s > 1:
                kept = places(owner) % s == 0
                owner, code = owner[kept], code[kept]
            owner, code = rows[owner[code >= 0]], code[code >= 0]
            if len(groups) << (2 * k) <= HELD:
                n = np.bincount((owner << (2 * k)) + code, minlength=0)
                at = np.flatnonzero(n)
                owner, code, n = at >> (2 * k), at & ((1 << (2 * k)) - 1), n[at]
            else:
                order = np.lexsort((code, owner))
                owner, code = owner[order], code[order]
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(code)))
                owner, code = owner[first], code[first]
            own_columns = {c: groups.column(c).take(pa.array(owner)) for c in by}
            yield pa.table({**own_columns, "code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    return _adding(count, [*by, "code"])
