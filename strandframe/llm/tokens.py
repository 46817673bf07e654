"""Operator 9: token counts from distinct pre-tokens."""

from __future__ import annotations

import os
from collections import Counter

import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import materialize
from .chunks import pieces, texts

TOKENIZER = "byte_bpe_50k.json"
HEAVY = 300_000
#: Bytes of a pre-token that may be among them.
LONGEST = 64
FLUSH = 400_000
LIMIT = 1024


def vocabulary(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(piece, n, tokens): every distinct pre-token of all texts, its occurrences, and its number of tokens."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"piece": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(pieces(text))
                if len(seen) > FLUSH:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    def encode(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        coder = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        for batch in batches:
            found = coder.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in found], pa.int64())], ["piece", "n", "tokens"])

    counts = docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return counts.mapInArrow(encode, "piece string, n long, tokens long")


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``; no ids are made of whole texts.

    Pre-tokens are counted over all texts (map-side first), and the tokenizer sees each distinct
    one once. Documents' pre-token frequencies meet these counts in two ways with one result: the
    ``heavy`` most frequent pre-tokens of at most ``LONGEST`` bytes, a table of bounded size, go to the tasks, where their
    tokens are summed; the other pre-tokens, most of them rare, are joined by a shuffle. So no hot
    pre-token is shuffled, and the vocabulary may be of any size.

    Null and empty text give 0 tokens. Rows are told apart by their place in the input, so rows
    with one doc_id each give a row, as do null ids. Special strings in a text count as the library has them.
    """
    known = materialize(vocabulary(docs, tokenizer))
    common = known.where(F.octet_length("piece") <= LONGEST).orderBy(F.desc("n"), "piece").limit(heavy)
    table = common.select("piece", "tokens").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast(dict(zip(table.column(0).to_pylist(), table.column(1).to_pylist())))

    def look_up(batches):
        tokens, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            size, total, rare = [], [], []
            for text in texts(batch.column(1)):
                size.append(len(text.encode()))
                missing: list[str] = []
                done = 0
                for piece in pieces(text):
                    n = tokens.get(piece)
                    if n is None:
                        missing.append(piece)
                    else:
                        done += n
                total.append(done)
                rare.append(list(Counter(missing).items()))
            offsets = [0]
            for x in rare:
                offsets.append(offsets[-1] + len(x))
            flat = pa.StructArray.from_arrays(
                [pa.array([p for x in rare for p, _ in x], pa.string()), pa.array([n for x in rare for _, n in x], pa.int64())], ["piece", "n"]
            )
            ids = pa.array(range(row, row + len(size)), pa.int64())
            row += len(size)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)],
                ["row", "doc_id", "n_bytes", "done", "rare"],
            )

    schema = "row long, doc_id long, n_bytes long, done long, rare array<struct<piece string, n long>>"
    rows = materialize(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(look_up, schema))
    rest = rows.select("row", F.explode("rare").alias("r")).select("row", "r.piece", "r.n")
    rest = rest.join(known.select("piece", "tokens"), "piece").groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("more"))
    out = rows.select("row", "doc_id", "n_bytes", "done").join(rest, "row", "left")
    total = F.col("done") + F.coalesce("more", F.lit(0))
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
