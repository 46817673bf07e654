"""Operator 11: alignment of two tokenizers over a corpus, each distinct text once."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Units a task remembers, and the longest of them.
CACHE = 300_000
LONGEST = 64
#: Texts that make up more than one in so many rows are joined by broadcast: there are fewer of them than this.
SHARE = 4096

# Both tokenizers start anew at a blank that follows something other than white space.
_UNIT = re.compile(r"(?<=\S)(?= )")
_SPACE_BLANK = re.compile(r"\s ")


def units(text: str) -> list[str]:
    """``text`` with a blank before it, in units that neither tokenizer's tokens cross; each begins with a blank."""
    whole = " " + text
    if "\0" in whole or _SPACE_BLANK.search(whole):
        return _UNIT.split(whole)
    return whole.replace(" ", "\0 ").split("\0")[1:]


def byte_alphabet() -> dict[str, int]:
    """The byte of every letter of byte-level pieces: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Ids and links of units under both tokenizers; remembers short units."""

    def __init__(self, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(public_tokenizers.path(byte_level))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces))
        letters = byte_alphabet()
        # the special token is never found, so its letters need not be in the alphabet
        self.bytes_a = {i: bytes(letters[c] for c in piece if c in letters) for piece, i in self.a.get_vocab().items()}
        self.bytes_b = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.names_a, self.names_b = ([str(i) for i in range(size)] for size in (1 + max(self.bytes_a), len(self.bytes_b)))
        # a token that held a blank after something else would cross units
        if any(b" " in x.lstrip(b" ") for x in self.bytes_b):
            raise ValueError(f"{pieces} has pieces that go across blanks")
        # a blank at a text's end is a unit that the tokenizer would see as an empty text
        self.blank = self.b.encode("a ")[len(self.b.encode("a")) :]
        # when half of the cache is full, units not met since then are forgotten
        self.half, self.known, self.older = cache // 2, {}, {}

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def look_up(self, wanted: list[list[str]]) -> list[list[tuple | None]]:
        """The ``fragment`` of every unit of every text."""
        if len(self.known) > self.half:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, {}
        for text in wanted:
            for unit in text:
                if unit not in known:
                    if unit in older:
                        known[unit] = older[unit]
                    else:
                        new[unit] = None
        if new:
            a = self.a.encode_batch_fast(list(new), add_special_tokens=False)
            b = self.b.encode([u[1:] for u in new], num_threads=1)
            for unit, x, y in zip(new, a, b):
                new[unit] = self.fragment(unit, x.ids, y if unit != " " else self.blank)
            known.update(new)
        out = [list(map(known.__getitem__, text)) for text in wanted]
        for unit in new:
            if len(unit) > LONGEST:
                del known[unit]
        return out

    def fragment(self, unit: str, a: list[int], b: list[int]) -> tuple | None:
        """(n_a, n_b, n_groups, groups, links) of a unit; None where tokens do not spell it.

        A link is the pair of the tokens that end together, a * 2^16 + b as four bytes.
        """
        y = [self.bytes_b[i] for i in b]
        x = [self.bytes_a[i] for i in a]
        if b"".join(y) != unit.encode() or b"".join(x) != b"".join(y):
            return None
        names_a, names_b = self.names_a, self.names_b
        if len(a) == 1 or len(b) == 1:
            groups = ",".join([names_a[i] for i in a]) + "|" + ",".join([names_b[i] for i in b])
            return len(a), len(b), 1, groups, (a[-1] << 16 | b[-1]).to_bytes(4, "little")
        parts, links = [], []
        i = j = to = at = 0
        n, m = len(a), len(b)
        while i < n:
            left, right = names_a[a[i]], names_b[b[j]]
            to += len(x[i])
            at += len(y[j])
            i += 1
            j += 1
            while to != at:
                if to < at:
                    left += "," + names_a[a[i]]
                    to += len(x[i])
                    i += 1
                else:
                    right += "," + names_b[b[j]]
                    at += len(y[j])
                    j += 1
            parts.append(left + "|" + right)
            links.append((a[i - 1] << 16 | b[j - 1]).to_bytes(4, "little"))
        return n, m, len(parts), ";".join(parts), b"".join(links)


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


MEASURES = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def aligned_texts(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, groups: bool = False) -> DataFrame:
    """(key, n, n_a, n_b, n_groups, n_links, groups_sha256, links) per distinct text with letters; with ``groups`` also (text, groups).

    Texts are shuffled whole, after each task has counted its own, so a text is tokenized once
    however many rows have it. ``links`` holds the pairs in order, four bytes each.
    """
    texts = docs.where(F.octet_length("text") > 0).groupBy("text").agg(F.count("*").alias("n"))
    schema = f"key binary, n long, {MEASURES}" + (", text string, groups string" if groups else "")

    def run(batches):
        aligner = Aligner(byte_level, pieces)
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                texts = batch.column(1).to_pylist()
                rows, spelled = [], []
                for found in aligner.look_up([units(x) for x in texts]):
                    if None in found:
                        rows.append((0, 0, 0, 0, "", b""))
                        spelled.append("")
                        continue
                    n_a, n_b, n_groups, strings, links = zip(*found)
                    line, data = ";".join(strings), b"".join(links)
                    spelled.append(line)
                    rows.append((sum(n_a), sum(n_b), sum(n_groups), len(data) // 4, hashlib.sha256(line.encode()).hexdigest(), data))
                columns = [pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string(), pa.binary()])]
                extra = [batch.column(1), pa.array(spelled, pa.string())] if groups else []
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, *extra], schema=_arrow(schema))

    return texts.select(text_key(F.col("text")).alias("key"), "text", "n").mapInArrow(run, schema)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in schema.split(", ")])


def flat_links(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All links of a batch in a row, and their number per text."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<u4"), np.array([len(x) // 4 for x in data], np.int64)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``codes`` in order with the sums of their ``counts``."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(counts, first)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, count): how many links of the corpus hold a pair, each text as often as rows have it.

    One of two tokens that end together is the end of the other, so there are at most as many
    pairs as all tokens of both vocabularies have bytes; tasks sum up before the shuffle.
    """

    def run(batches):
        codes, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            links, sizes = flat_links(batch.column(1))
            if len(links):
                more = summed(links, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), sizes))
                codes, counts = summed(np.concatenate((codes, more[0])), np.concatenate((counts, more[1])))
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], ["pair", "count"])

    return texts.select("n", "links").mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``.

    Each distinct text is tokenized and aligned once; pair counts weigh it by the number of its
    rows; measures are joined to the rows by the text's SHA-256. Texts with more than one row in
    ``SHARE`` are fewer than ``SHARE``: those are joined by broadcast, the others by a shuffle in
    which no key has more than that share.

    Null and empty texts, and texts that one of the tokenizers does not spell (letters it
    rewrites), have zeros and no hash. Repeated rows and null ids each give a row, an empty table
    none; very long texts are one row as in the input; other columns of ``docs`` are not looked at.
    """
    texts = materialize(aligned_texts(docs, byte_level, pieces))
    # bounded by the bytes of both vocabularies
    pairs = pair_counts(texts).toArrow()
    codes, counts = (pairs.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(codes)
    codes, counts = codes[order].astype(np.uint32), counts[order]
    highest = np.zeros(1 << 16, np.int64)
    np.maximum.at(highest, codes & 0xFFFF, counts)
    table = docs.sparkSession.sparkContext.broadcast((codes, counts, counts == highest[codes & 0xFFFF]))

    schema = "key binary, n long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def measure(batches):
        codes, counts, best = table.value
        for batch in batches:
            links, sizes = flat_links(batch.column(7))
            at = np.searchsorted(codes, links)
            ends = np.cumsum(sizes)
            sums = []
            for values in (best, counts):
                running = np.concatenate(([0], np.cumsum(values[at], dtype=np.int64)))
                sums.append(pa.array(running[ends] - running[ends - sizes]))
            columns = batch.columns
            yield pa.RecordBatch.from_arrays([*columns[:6], *sums, columns[6]], schema=_arrow(schema))

    measured = materialize(texts.mapInArrow(measure, schema))
    rows = materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.when(F.octet_length("text") > 0, text_key(F.col("text"))).alias("key")))
    total = measured.agg(F.sum("n")).scalar()
    often = F.col("n") * SHARE > total
    hot, rest = measured.where(often).drop("n"), measured.where(~often).drop("n")
    common = rows.join(F.broadcast(hot), "key", "left")
    found = common.where(F.col("n_a").isNotNull() | F.col("key").isNull()).drop("key")
    names = found.columns[1:]
    other = common.where(F.col("n_a").isNull() & F.col("key").isNotNull()).select("doc_id", "key").join(rest, "key").select("doc_id", *names)
    out = found.unionByName(other)
    return out.select("doc_id", *[F.coalesce(c, F.lit("") if c == "groups_sha256" else F.lit(0)).alias(c) for c in names])
