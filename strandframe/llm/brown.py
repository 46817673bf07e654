"""Operator 2: language-model scores by Brown class-based n-grams."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_bytes

#: Words that exchange clustering moves: so many at least, and as many as make up this share of the tokens.
HEAD = 20_000
COVER = 0.8
#: The classes it moves them between.
CLASSES = 48
#: Classes of all other words, known or not, by their endings.
ENDINGS = 48
ROUNDS = 5
#: Words whose counts go to the tasks; the others' counts are joined.
HEAVY = 300_000
#: Bytes of a word that may be among them.
LONGEST = 64
#: Smoothing: count added to a word in its class, and weight of the class frequencies behind a transition.
ADD = 0.5
BEHIND = 50.0
FLUSH = 400_000
# bytes of texts that a task scores at once
PART = 1 << 20
BLOCK = 1 << 22
# units are dealt to so many folds, and a row of a fold holds at most so many neighbours
FOLDS = 256
STRIP = 1 << 13
END_WORD = ""


@dataclass
class Setting:
    head: int = HEAD
    classes: int = CLASSES
    endings: int = ENDINGS
    rounds: int = ROUNDS
    heavy: int = HEAVY

    @property
    def kinds(self) -> int:
        """All classes: the movable ones, the endings', and the class of the end alone."""
        return self.classes + self.endings + 1

    @property
    def units(self) -> int:
        """What transitions are counted between: head words, endings, the end."""
        return self.head + self.endings + 1


def ending(word: str, n: int) -> int:
    return zlib.crc32(word[-2:].encode()) % n


def is_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7, F.lit(0)) != 2


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c) of all training tokens; the end is the empty word."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                seen.update(text.lower().split())
                seen[b""] += 1
                if len(seen) > FLUSH:
                    yield out()
                    seen = Counter()
        if seen:
            yield out()

    return train.select("text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_size(counts: DataFrame, setting: Setting) -> int:
    """Number of most frequent words to cluster: ``head``, or more if they don't make up ``COVER`` of the tokens.

    Counts are summed by value first; there are at most about sqrt(2 * tokens) different ones.
    """
    kept = counts.where((F.col("word") != "") & (F.octet_length("word") <= LONGEST))
    found = kept.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toArrow()
    c, n = found.column(0).to_numpy(), found.column(1).to_numpy()
    if not len(c):
        return setting.head
    inside = np.cumsum(c * n)
    want = COVER * inside[-1]
    at = int(np.searchsorted(inside, want))
    short = want - (inside[at] - c[at] * n[at])
    return max(setting.head, int(n[:at].sum()) + math.ceil(short / c[at]))


class Units(dict):
    """Unit of a word given as bytes: its place in the head, or its ending's."""

    def __init__(self, head: list[str], setting: Setting):
        super().__init__((w.encode(), i) for i, w in enumerate(head))
        self[b""] = setting.units - 1
        self.setting, self.size = setting, len(self) + FLUSH

    def __missing__(self, word: bytes) -> int:
        unit = self.setting.head + ending(word.decode(), self.setting.endings)
        if len(self) < self.size:
            self[word] = unit
        return unit


def transitions(train: DataFrame, head, setting: Setting) -> DataFrame:
    """(code, n): counts of neighbouring units over all training texts, code = first * units + second."""

    def run(batches):
        units, end = Units(head.value, setting), setting.units - 1
        held, size = [], 0

        def out():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n, pa.int64())], ["code", "n"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                ids = np.array([end, *map(units.__getitem__, text.lower().split()), end], np.int64)
                held.append(ids[:-1] * setting.units + ids[1:])
                size += len(held[-1])
                if size > BLOCK:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return train.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def neighbours(pairs: DataFrame, setting: Setting) -> DataFrame:
    """(fold, key, other, n): every count of ``pairs`` at both its units, in strips of numbers as bytes.

    ``key`` is 2 * unit, plus 1 where ``other`` stands before the unit. A fold holds every ``FOLDS``-th unit
    and is shuffled to one place here, so that a round adds up a unit's counts where they are.
    """
    folds, strip = FOLDS, STRIP

    def run(batches):
        held, size = [], 0

        def out():
            code, n = (np.concatenate(x) for x in zip(*held))
            a, b = np.divmod(code, setting.units)
            key, other, n = np.concatenate((2 * a, 2 * b + 1)), np.concatenate((b, a)), np.concatenate((n, n))
            fold = key // 2 % folds
            order = np.argsort(fold * (2 * setting.units) + key)
            ends = np.searchsorted(fold[order], np.arange(folds + 1))
            rows = []
            for f in np.flatnonzero(np.diff(ends)):
                for at in range(ends[f], ends[f + 1], strip):
                    some = order[at : min(at + strip, ends[f + 1])]
                    rows.append((int(f), key[some].astype(np.int32).tobytes(), other[some].astype(np.int32).tobytes(), n[some].tobytes()))
            types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["fold", "key", "other", "n"])

        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size > FLUSH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    strips = pairs.select("code", "n").mapInArrow(run, "fold int, key binary, other binary, n binary")
    return strips.repartition("fold").sortWithinPartitions("fold")


def profiles(strips: DataFrame, kinds, setting: Setting) -> DataFrame:
    """(unit, cells, n): how often a unit stands before a class (cell = class) or after one (cell = classes + class);
    cell 2 * classes counts the unit before itself. A unit may have several rows, which add up.
    """
    folds = FOLDS

    def run(batches):
        kind, k = kinds.value, setting.kinds
        width, members = 2 * k + 1, setting.units // folds + 1
        now, total = -1, np.zeros(members * width)

        def out():
            at = np.flatnonzero(total)
            member, cell = np.divmod(at, width)
            starts = np.flatnonzero(np.diff(member, prepend=-1))
            offsets = pa.array(np.append(starts, len(at)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(cell, pa.int32()), pa.array(total[at].astype(np.int64)))]
            return pa.RecordBatch.from_arrays([pa.array(member[starts] * folds + now), *lists], ["unit", "cells", "n"])

        for batch in batches:
            for fold, key, other, n in zip(*(c.to_pylist() for c in batch.columns)):
                if fold != now:
                    if now >= 0:
                        yield out()
                    now = fold
                    total[:] = 0
                key, other, n = np.frombuffer(key, np.int32), np.frombuffer(other, np.int32), np.frombuffer(n, np.int64)
                unit, before = key >> 1, key & 1
                first = unit // folds * width
                same = (unit == other) & (before == 0)
                total += np.bincount(first + before * k + kind[other], n, len(total))
                total += np.bincount(first[same] + 2 * k, n[same], len(total))
        if now >= 0:
            yield out()

    return strips.select("fold", "key", "other", "n").mapInArrow(run, "unit long, cells array<int>, n array<long>")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(own: int, after: np.ndarray, before: np.ndarray, self_count: float, matrix: np.ndarray, classes: int) -> int:
    """The class among the first ``classes`` where the word adds most to the classes' mutual information.

    ``after`` and ``before`` count the word's neighbours by class, ``matrix`` the transitions
    between classes with the word in class ``own``. The word is taken out, then tried in each class.
    """
    r, l = after.copy(), before.copy()
    r[own] -= self_count
    l[own] -= self_count
    m = matrix.copy()
    m[own] -= r
    m[:, own] -= l
    m[own, own] -= self_count
    c = np.arange(classes)
    rows, cols, corner = m[:classes], m[:, :classes].T, m[c, c]
    gain = (xlogx(rows + r) - xlogx(rows)).sum(1) + (xlogx(cols + l) - xlogx(cols)).sum(1)
    gain += xlogx(corner + r[c] + l[c] + self_count) - xlogx(corner + r[c]) - xlogx(corner + l[c]) + xlogx(corner)
    out, into = m.sum(1)[:classes], m.sum(0)[:classes]
    gain -= xlogx(out + r.sum() + self_count) - xlogx(out) + xlogx(into + l.sum() + self_count) - xlogx(into)
    best = int(gain.argmax())
    return best if gain[best] > (gain[own] if own < classes else -math.inf) + 1e-9 else own


def exchange(pairs: DataFrame, head: list[str], setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, transitions between classes) after the rounds of exchange.

    Counts are brought to their units once (``neighbours``). A round profiles all units against the
    present classes (one pass over the counts, which stay where they are) and moves
    every word of one half of the head to its best class; halves take turns by a hash, so that
    words that would swap do not move at once. The class vector and the class matrix, of sizes set
    by ``setting``, are all that the driver sees.
    """
    sc = pairs.sparkSession.sparkContext
    first, k = setting.classes, setting.kinds
    kind = np.zeros(setting.units, np.int64)
    kind[: len(head)] = [ending(w, first) for w in head]
    kind[setting.head :] = np.arange(first, k)
    strips = materialize(neighbours(pairs, setting))
    for turn in range(setting.rounds + 1):
        shared = sc.broadcast(kind)
        found = materialize(profiles(strips, shared, setting))

        def sums(batches, names=shared, k=k):
            total = np.zeros(k * k, np.int64)
            for batch in batches:
                unit = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
                cell, n = (batch.column(i).flatten().to_numpy() for i in (1, 2))
                after = cell < k
                total += np.bincount(names.value[unit[after]] * k + cell[after], n[after], k * k).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

        cells = found.mapInArrow(sums, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        matrix = np.zeros(k * k)
        matrix[cells.column(0).to_numpy()] = cells.column(1).to_numpy()
        matrix = matrix.reshape(k, k)
        if turn == setting.rounds:
            break
        table = sc.broadcast(matrix)

        def move(batches, names=shared, table=table, k=k, first=first):
            for batch in batches:
                unit, new = [], []
                cell, n = (batch.column(i).flatten().to_numpy() for i in (1, 2))
                ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
                for u, lo, hi in zip(batch.column(0).to_pylist(), [0, *ends], ends):
                    sides = np.bincount(cell[lo:hi], n[lo:hi], 2 * k + 1)
                    unit.append(u)
                    new.append(best_class(int(names.value[u]), sides[:k], sides[k : 2 * k], sides[2 * k], table.value, first))
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(new, pa.int64())], ["unit", "new"])

        turns = found.where((F.col("unit") < len(head)) & (F.pmod(F.xxhash64(F.lit(turn // 2), "unit"), F.lit(2)) == turn % 2))
        turns = turns.groupBy("unit").agg(F.collect_list(F.struct("cells", "n")).alias("rows"))
        turns = turns.select("unit", F.flatten("rows.cells").alias("cells"), F.flatten("rows.n").alias("n"))
        moved = turns.mapInArrow(move, "unit long, new long").toArrow()
        kind = kind.copy()
        kind[moved.column(0).to_numpy()] = moved.column(1).to_numpy()
    return kind, matrix


@dataclass(frozen=True)
class Model:
    """What scores a text: class of every unit, log10 of class after class, log10 of the sum of a class, and the counts of frequent words.

    A word's probability after a class is 10^(log_next[class, own] - log_class[own]) * (count + ADD).
    """

    setting: Setting
    words: list
    freq: list
    kind: np.ndarray
    log_next: np.ndarray
    log_class: np.ndarray
    ends: int
    total: int
    types: int


def probabilities(matrix: np.ndarray, n_types: np.ndarray, setting: Setting) -> tuple[np.ndarray, np.ndarray]:
    """(log_next, log_class) from the counts of class after class and the numbers of words in the classes.

    Every ending has a share for one unknown word; classes without any word get no probability. So
    after each class the probabilities of all words, one unknown word per ending and the end sum to one.
    """
    unknown = np.zeros(setting.kinds)
    unknown[setting.classes : setting.kinds - 1] = 1
    members = n_types + unknown
    in_class = matrix.sum(0)
    behind = np.where(members > 0, in_class + 1, 0.0)
    behind /= behind.sum()
    shares = (matrix + BEHIND * behind) / (matrix.sum(1, keepdims=True) + BEHIND)
    empty = members == 0
    log_next = np.log10(np.where(empty, 1.0, shares))
    return np.where(empty, -np.inf, log_next), np.log10(np.where(empty, 1.0, in_class + ADD * members))


def fit(docs: DataFrame, setting: Setting | None = None) -> tuple[Model, DataFrame]:
    """The model of the training rows of ``docs`` (doc_id, text), and the counts (word, c) of all their words."""
    setting = setting or Setting()
    sc = docs.sparkSession.sparkContext
    train = docs.where(is_training(F.col("doc_id")))
    counts = materialize(word_counts(train))
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    setting = replace(setting, head=head_size(counts, setting))
    frequent = counts.where((F.col("word") != "") & (F.octet_length("word") <= LONGEST)).orderBy(F.desc("c"), "word").limit(max(setting.heavy, setting.head)).toArrow()
    words, freq = frequent.column(0).to_pylist(), frequent.column(1).to_pylist()
    head = words[: setting.head]
    kind, matrix = exchange(materialize(transitions(train, sc.broadcast(head), setting)), head, setting)
    n_types = np.bincount(kind[: len(head)], minlength=setting.kinds)
    inside = sc.broadcast(head)

    def other_types(batches):
        known, n = set(inside.value), setting.endings
        found = np.zeros(n, np.int64)
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if word and word not in known:
                    found[ending(word, n)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(found)], ["ending", "n"])

    rest = counts.select("word").mapInArrow(other_types, "ending long, n long").groupBy("ending").agg(F.sum("n").alias("n")).toArrow()
    n_types[setting.classes + rest.column(0).to_numpy()] += rest.column(1).to_numpy()
    n_types[setting.kinds - 1] = 1
    log_next, log_class = probabilities(matrix, n_types, setting)
    ends = int(counts.where("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    return Model(setting, words, freq, kind, log_next, log_class, ends, int(total), int(types)), counts


def _parts(texts: list[bytes]):
    """(number of the first, texts): neighbouring texts of about ``PART`` bytes."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > PART:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if texts:
        yield first, texts[first:]


def score(docs: DataFrame, setting: Setting | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row of ``docs``.

    Words of all training texts are counted; the ``head`` most frequent ones, or more up to ``COVER``
    of the tokens, get classes by exchange clustering over all their neighbours. The tail is not
    clustered: its words get a class by their ending. A word's
    probability is that of its class after the class before it (smoothed by class frequencies)
    times that of the word in its class (add-``ADD``, with a share for unknown words). Texts begin
    after an end and end with one.

    Counts of the ``heavy`` most frequent words (of at most ``LONGEST`` bytes) go to the tasks, a
    table of bounded size; the other words of a text are joined to their counts by a shuffle, with
    the same result.

    Null and empty text is the end alone. A null doc_id is in training. Rows are told apart by
    their place, so repeated rows give a row each. Without training text every probability is that
    of an unknown word. Very long texts are scored whole, in one task.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    fitted, counts = fit(docs, setting)
    setting, total = fitted.setting, fitted.total
    model = docs.sparkSession.sparkContext.broadcast((fitted.words, fitted.freq, fitted.kind, fitted.log_next, fitted.log_class, fitted.ends))
    base_norm = math.log10(fitted.total + fitted.types + 1)

    schema = "row long, doc_id long, n_tokens long, known long, base double, score double, rare array<struct<word: string, n: long>>"

    def run(batches):
        words, freq, kind, log_next, log_class, ends = model.value
        units = Units(words[: setting.head], setting)
        count = dict(zip((w.encode() for w in words), freq))
        row, end = TaskContext.get().partitionId() << 40, setting.units - 1
        end_kind = int(kind[end])
        for batch in batches:
            for at, texts in _parts(text_bytes(batch.column(1))):
                found = [text.lower().split() for text in texts]
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                owner = np.repeat(np.arange(len(found)), sizes)
                # every distinct word of the texts is looked up once
                coded = pa.array(chain.from_iterable(found), pa.large_binary()).dictionary_encode()
                place, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                kinds = kind[np.fromiter(map(units.__getitem__, distinct), np.int64, len(distinct))]
                c = np.fromiter((count.get(w, -1) for w in distinct), np.int64, len(distinct))
                ends_at = np.cumsum(sizes + 1)
                here = np.full(ends_at[-1], end_kind, np.int64)
                inside = np.ones(len(here), bool)
                inside[ends_at - 1] = False
                here[inside] = kinds[place]
                # a text begins after an end, as which the one before it closes
                before = np.concatenate(([end_kind], here[:-1]))
                value = np.add.reduceat(log_next[before, here] - log_class[here], ends_at - sizes - 1)
                summed = lambda x: np.bincount(owner, x[place], len(found))
                met = c >= 0
                known = summed(met).astype(np.int64) + int(ends > 0)
                base = math.log10(ends + 1) - (sizes + 1) * base_norm + summed(np.log10(np.where(met, c + 1, 1)))
                value += math.log10(ends + ADD) + summed(np.log10(np.where(met, c + ADD, 1.0)))
                rare = ~met[place]
                key, n = np.unique(owner[rare] * max(1, len(distinct)) + place[rare], return_counts=True)
                whose, which = np.divmod(key, max(1, len(distinct)))
                offsets = np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(found)))))
                pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(which)).cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())], ["word", "n"])
                columns = [pa.array(row + np.arange(len(found))), batch.column(0).slice(at, len(found)), *map(pa.array, (sizes + 1, known, base, value))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], ["row", "doc_id", "n_tokens", "known", "base", "score", "rare"]
                )
                row += len(found)

    rows = materialize(docs.mapInArrow(run, schema))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    more = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(F.col("n") * F.log10(c + 1)).alias("b"), F.sum(F.col("n") * F.log10(c + ADD)).alias("s")
    )
    out = rows.drop("rare").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select(
        "doc_id",
        (~is_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        plus("known", "k").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        plus("base", "b").alias("base_score"),
        plus("score", "s").alias("score"),
    )
