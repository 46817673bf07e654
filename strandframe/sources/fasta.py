"""FASTA as a Spark data source (inventory A2)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..session import broadcast_if_small, materialize
from .files import BLOCK_BYTES, SPLIT_BYTES, Range, line_blocks, ranges

PATTERNS = "*.fna,*.fasta"


class FastaSource(DataSource):
    """Sequence lines with the header they follow, one task per gzip file or byte range.

    Rows are (path, start, record_id, line_no, sequence), with the start of the range that the line
    lies in. Before the first header of a range ``record_id`` is null and ``line_no`` counts from the
    range's start; else it counts the sequence lines of a record from 0. With the option ``index`` a
    range gives one row (path, start, head_lines, last_record, tail_lines): its lines before the
    first header, its last header and the lines after it.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        if self.options.get("index", "false") == "true":
            return "path string, start bigint, head_lines bigint, last_record string, tail_lines bigint"
        return "path string, start bigint, record_id string, line_no bigint, sequence string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(dict(self.options))


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.patterns = options.get("glob", PATTERNS).split(",")
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.index = options.get("index", "false") == "true"

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.patterns, self.split_bytes)

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        state = State()
        for batch in sequence_lines(part, state):
            if not self.index and len(batch[0]):
                own = [pa.repeat(part.path, len(batch[0])), pa.repeat(pa.scalar(part.start, pa.int64()), len(batch[0]))]
                yield pa.RecordBatch.from_arrays([*own, *batch], ["path", "start", "record_id", "line_no", "sequence"])
        if self.index:
            counts = {"head_lines": [state.before], "last_record": pa.array([state.record], pa.string()), "tail_lines": [state.number]}
            yield pa.RecordBatch.from_pydict({"path": [part.path], "start": [part.start], **counts})


@dataclass
class State:
    """Where a range stands: lines before its first header, its last header, and lines after that."""

    before: int = 0
    record: str | None = None
    number: int = 0


def sequence_lines(part: Range, state: State, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
    """(record, number, sequence) of the lines that start inside the range, block by block; blank lines left out."""
    for lines, _, _ in line_blocks(part, size):
        n = len(lines) if part.end is None else int(np.searchsorted(lines.offsets, part.end))
        heads = np.flatnonzero(lines.first[:n] == ord(">"))
        at = np.flatnonzero(lines.first[:n] != ord(">"))
        text = lines.text(at)
        filled = pc.greater(pc.binary_length(text), 0)
        at, text = at[filled.to_numpy(zero_copy_only=False)], text.filter(filled)
        # 0: the record that goes on from before this block
        group = np.searchsorted(heads, at)
        number = np.arange(len(at)) - np.searchsorted(group, group)
        goes_on = int((group == 0).sum())
        carried = state.number if state.record is not None else state.before
        number[:goes_on] += carried
        names = pc.replace_substring_regex(lines.text(heads), "^>([^ ]*)(?s:.*)$", "\\1")
        records = pa.concat_arrays([pa.array([state.record], pa.string()), names]).take(pa.array(group))
        if state.record is None:
            state.before += goes_on
        elif not len(heads):
            state.number += goes_on
        if len(heads):
            state.record, state.number = names[-1].as_py(), int((group == len(heads)).sum())
        yield records, pa.array(number, pa.int64()), text
        if n < len(lines):
            return


def read_fasta(spark: SparkSession, path: str, glob: str = PATTERNS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A2. (fasta, record_id, line_no, sequence) of a FASTA file or folder; ``fasta`` is the file name.

    A record may go over any number of ranges, each read by its own task. Where a file has several
    ranges, a first pass gives one row per range; running over a file's ranges, they tell which record a
    range begins in and how many of its lines came before.
    """
    spark.dataSource.register(FastaSource)
    reader = spark.read.format("fasta").options(glob=glob, splitBytes=split_bytes)
    raw = reader.load(path)
    if any(part.start for part in ranges(path, glob.split(","), split_bytes)):
        index = reader.option("index", "true").load(path)
        w = Window.partitionBy("path").orderBy("start")
        has = F.col("last_record").isNotNull()
        index = index.withColumns({"part": F.count("last_record").over(w), "lines": F.when(has, F.col("tail_lines")).otherwise(F.col("head_lines"))})
        # lines of the record that is open at the end of a range
        index = index.withColumns({"open": F.last("last_record", ignorenulls=True).over(w), "upto": F.sum("lines").over(Window.partitionBy("path", "part").orderBy("start"))})
        index = index.select("path", "start", F.lag("open").over(w).alias("open"), F.coalesce(F.lag("upto").over(w), F.lit(0)).alias("upto"))
        number = F.col("line_no") + F.when(F.col("record_id").isNull(), F.col("upto")).otherwise(0)
        raw = raw.join(broadcast_if_small(materialize(index)), ["path", "start"])
        raw = raw.withColumns({"line_no": number, "record_id": F.coalesce("record_id", "open")})
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("fasta"), "record_id", "line_no", "sequence")


def sequence_text(spark: SparkSession, path: str, glob: str = "*.{fna,fasta}") -> DataFrame:
    """A2 without record ids: the text source with header and blank lines filtered out."""
    lines = spark.read.option("pathGlobFilter", glob).text(path).withColumnRenamed("value", "sequence")
    return lines.filter(~F.col("sequence").startswith(">") & (F.trim("sequence") != ""))
