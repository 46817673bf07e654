"""Skip-gram vectors trained block by block (E1): no task and no driver holds the vocabulary."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .context import near_counts
from .ranking import number_rows

SEED = 42
# a task holds at most about this many numbers of vectors, and as many pairs on average
BLOCK_CELLS = 1 << 24
BLOCK_PAIRS = 1 << 20
# pairs of one gradient step
STEP_PAIRS = 1 << 10
# noise draws follow counts to this power
NOISE_POWER = 0.75

WORD, CONTEXT, PAIR = 0, 1, 2
ROW = "kind byte, task int, id long, other long, weight double, scale double, vector array<float>"


def context_weights(sentences: DataFrame, window: int = 5, words: str = "words") -> DataFrame:
    """(word, context, weight): pairs at most ``window`` places apart in a sentence, in both directions.

    A pair d places apart counts ``window + 1 - d``, which is ``window`` times its chance under the
    usual random window size. Null words take a place and are in no pair.
    """
    near = near_counts(sentences, words, window).where("a IS NOT NULL AND b IS NOT NULL")
    near = near.groupBy(F.col("a").alias("word"), F.col("b").alias("context")).agg(F.sum((F.lit(window + 1) - F.col("d")) * F.col("n")).alias("weight"))
    back = near.select(F.col("context").alias("word"), F.col("word").alias("context"), "weight")
    return near.unionByName(back).groupBy("word", "context").agg(F.sum("weight").alias("weight"))


def numbered_words(sentences: DataFrame, min_count: int, words: str = "words") -> DataFrame:
    """(kmer, id, count): words that occur ``min_count`` times or more, numbered from 0 in the order of letters."""
    counts = sentences.select(F.explode(words).alias("kmer")).where("kmer IS NOT NULL").groupBy("kmer").agg(F.count("*").alias("count"))
    numbered = number_rows(counts.where(F.col("count") >= min_count), [], [F.col("kmer")], "__n")
    return numbered.select("kmer", (F.col("__n") - 1).alias("id"), "count")


def seeded_vector(id_: str, dim: int, seed: int = SEED) -> Column:
    """Start of a word's vector: even in (-0.5, 0.5) / dim, from its id."""
    place = F.sequence(F.lit(1), F.lit(dim))
    even = lambda i: F.pmod(F.xxhash64(F.col(id_), i, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5
    return F.transform(place, lambda i: (even(i) / dim).cast("float"))


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``rows`` and the sum of ``values`` of each."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(rows)) + 1))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def _train_block(words, contexts, pairs, noise_total, negatives, step_size, least_steps, rng):
    """Gradient steps over a block's pairs; ``words`` and ``contexts`` are (weight, scale, vectors), changed in place.

    Noise stands for all of the word's pairs and this block's share of the contexts, so that the
    blocks of a round together have the expectation of undivided training.
    """
    (total, u_scale, u), (noise, v_scale, v) = words, contexts
    a, b, n = pairs
    upto = np.cumsum(noise)
    per_pass = math.ceil((len(a) * (1 + negatives) + negatives * len(total)) / STEP_PAIRS)
    for _ in range(math.ceil(least_steps / per_pass)):
        draws = negatives * (1 + np.bincount(a, minlength=len(total)))
        draws[total <= 0] = 0
        w = np.repeat(np.arange(len(total)), draws)
        # a word's draws are evenly spaced from a random start: unbiased, with little variance
        nth = np.arange(len(w)) - np.repeat(np.cumsum(draws) - draws, draws)
        spaced = (nth + rng.random(len(total))[w]) / draws[w]
        c = np.minimum(np.searchsorted(upto, spaced * upto[-1], side="right"), len(noise) - 1)
        weight = (negatives * total * upto[-1] / noise_total)[w] / draws[w]
        left, right = np.concatenate((a, w)), np.concatenate((b, c))
        weight = np.concatenate((n, weight))
        hit = np.concatenate((np.ones(len(a)), np.zeros(len(w))))
        order = rng.permutation(len(left))
        for i in range(0, len(order), STEP_PAIRS):
            at = order[i : i + STEP_PAIRS]
            x, y = left[at], right[at]
            slope = weight[at] * (hit[at] - 1 / (1 + np.exp(-np.clip((u[x] * v[y]).sum(1), -30, 30))))
            ux, du = _sums(x, slope[:, None] * v[y])
            vy, dv = _sums(y, slope[:, None] * u[x])
            for rows, grad, scale, table in ((ux, du, u_scale, u), (vy, dv, v_scale, v)):
                scale[rows] += (grad**2).mean(1)
                table[rows] += step_size * grad / np.sqrt(scale[rows] + 1e-12)[:, None]


def _columns(table: pa.Table, kind: int, dim: int):
    """Ids in order, weights, scales and vectors of one kind of rows."""
    rows = table.filter(pa.compute.equal(table["kind"], kind)).sort_by("id").combine_chunks()
    if not rows.num_rows:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((0, dim))
    flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = flat.reshape(-1, dim).astype(np.float64)
    return rows["id"].to_numpy(), rows["weight"].to_numpy(), rows["scale"].to_numpy().copy(), vectors


def train_pairs(
    pairs: DataFrame,
    vector_size: int = 100,
    iterations: int = 5,
    step_size: float = 0.1,
    negatives: int = 5,
    blocks: int = 1,
    least_steps: int = 32,
    noise_power: float = NOISE_POWER,
    seed: int = SEED,
) -> DataFrame:
    """(id, vector, out_vector) of the words of ``pairs`` (w, c, weight): skip-gram with noise draws.

    Words and contexts are dealt to blocks by id. In a round every task takes one block of words, one
    of contexts and the pairs between them; blocks of contexts then move on by one, so tasks never
    share a row and no update is lost or depends on which task was first. An iteration is one
    round per block. There are at least ``blocks`` blocks, and more as vectors and pairs grow, so
    that a task's memory stays bounded; a hot word has at most one row per context, spread over all
    blocks. Every round is written to the shared folder. A task goes over its pairs at least once, and
    again until it made ``least_steps`` steps: equal pairs are one row with a weight, so a small
    vocabulary has few rows however long the text. Steps are scaled per row by the gradients seen so
    far. Results do not depend on the order of rows. No pairs give no rows.

    The expected optimum of u(w).v(c) with enough columns is ln(weight(w, c) / (weight(w) *
    noise(c) * ``negatives``)), where noise(c) is the contexts' share of weight to ``noise_power``.
    """
    pairs = materialize(pairs.select(F.col("w").cast("long"), F.col("c").cast("long"), F.col("weight").cast("double")))
    sides = [pairs.groupBy(F.col(x).alias("id")).agg(F.sum("weight").alias("weight")) for x in ("w", "c")]
    sides = [sides[0], sides[1].withColumn("weight", F.pow("weight", F.lit(noise_power)))]
    size = pairs.agg(F.count("*"), F.max("w"), F.max("c")).first()
    noise_total = sides[1].agg(F.sum("weight")).first()[0] or 1.0
    cells = (max(size[1] or 0, size[2] or 0) + 1) * (vector_size + 4)
    p = max(blocks, math.ceil(cells / BLOCK_CELLS), math.ceil(math.sqrt(size[0] / BLOCK_PAIRS)))

    block = lambda x: F.pmod(F.col(x), F.lit(p)).cast("int")
    start = [seeded_vector("id", vector_size, seed), F.array_repeat(F.lit(0.0).cast("float"), vector_size)]
    state = None
    for kind, side in enumerate(sides):
        rows = side.select(
            F.lit(kind).cast("byte").alias("kind"), block("id").alias("task"), "id", F.lit(0).cast("long").alias("other"),
            "weight", F.lit(0.0).alias("scale"), start[kind].alias("vector"),
        )
        state = rows if state is None else state.unionByName(rows)
    state = materialize(state)
    # a pair's turn is the round in which its two blocks meet
    turns = pairs.select(
        F.lit(PAIR).cast("byte").alias("kind"), block("w").alias("task"), F.col("w").alias("id"), F.col("c").alias("other"),
        "weight", F.lit(0.0).alias("scale"), F.array().cast("array<float>").alias("vector"),
        F.pmod(block("c") - block("w"), F.lit(p)).alias("turn"),
    )
    turns = materialize(turns, "turn")
    schema = pa.schema([
        ("kind", pa.int8()), ("task", pa.int32()), ("id", pa.int64()), ("other", pa.int64()),
        ("weight", pa.float64()), ("scale", pa.float64()), ("vector", pa.list_(pa.float32())),
    ])

    def round_of(number: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            task = key[0].as_py()
            w, c = _columns(table, WORD, vector_size), _columns(table, CONTEXT, vector_size)
            rows = table.filter(pa.compute.equal(table["kind"], PAIR)).sort_by([("id", "ascending"), ("other", "ascending")])
            if len(w[0]) and len(c[0]):
                own = (np.searchsorted(w[0], rows["id"].to_numpy()), np.searchsorted(c[0], rows["other"].to_numpy()), rows["weight"].to_numpy())
                rng = np.random.default_rng([seed, number, task])
                _train_block(w[1:], c[1:], own, noise_total, negatives, step_size, least_steps, rng)
            out = []
            for kind, (ids, weight, scale, vectors) in ((WORD, w), (CONTEXT, c)):
                ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * vector_size)
                lists = pa.ListArray.from_arrays(ends, pa.array(vectors.astype(np.float32).ravel()))
                arrays = [np.full(len(ids), kind, np.int8), (ids % p).astype(np.int32), ids, np.zeros(len(ids), np.int64), weight, scale]
                out.append(pa.table([*map(pa.array, arrays), lists], schema=schema))
            return pa.concat_tables(out)

        return run

    for number in range(iterations * p):
        turn = number % p
        # block b of contexts is with words of block b - turn
        meet = state.withColumn("task", F.when(F.col("kind") == CONTEXT, F.pmod(F.col("task") - turn, F.lit(p))).otherwise(F.col("task")).cast("int"))
        rows = meet.unionByName(turns.where(F.col("turn") == turn).drop("turn"))
        state = materialize(rows.groupBy("task").applyInArrow(round_of(number), ROW))
    u = state.where(F.col("kind") == WORD).select("id", "vector")
    v = state.where(F.col("kind") == CONTEXT).select("id", F.col("vector").alias("out_vector"))
    return u.join(v, "id", "left")
