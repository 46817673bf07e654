"""FASTQ as a Spark data source (inventory A1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions.seq import pair_suffix
from .files import BLOCK_BYTES, SPLIT_BYTES, Lines, Range, Ranges, line_blocks, ranges, tasks

PATTERNS = "*.fq,*.fastq,*.fq.gz,*.fastq.gz"


class FastqSource(DataSource):
    """Four-line records of a file or folder by gzip files or byte ranges; a task reads several where they are short and many.

    Options: ``glob`` (comma-separated name patterns), ``splitBytes``,
    ``quality`` (false leaves the quality line out).
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        qual = "" if self.options.get("quality", "true") == "false" else "qual string, "
        return f"read_id string, read string, {qual}path string"

    def reader(self, schema) -> FastqReader:
        return FastqReader(dict(self.options), "qual" in schema.fieldNames())


class FastqReader(DataSourceReader):
    def __init__(self, options: dict, quality: bool):
        self.path = options["path"]
        self.patterns = options.get("glob", PATTERNS).split(",")
        self.split_bytes = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.quality = quality

    def partitions(self) -> list[Ranges]:
        return tasks(ranges(self.path, self.patterns, self.split_bytes))

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        for part in task.parts:
            yield from self.batches(part)

    def batches(self, part: Range) -> Iterator[pa.RecordBatch]:
        for lines, first, number, whole in records(part):
            at = first + 4 * np.arange(number)
            cols = {"read_id": lines.text(at), "read": lines.text(at + 1)}
            if self.quality:
                # a cut last record has no quality
                qual = lines.text(at[: number - (not whole)] + 3)
                cols["qual"] = qual if whole else pa.concat_arrays([qual, pa.nulls(1, pa.string())])
            cols["path"] = pa.repeat(part.path, number)
            yield pa.RecordBatch.from_pydict(cols)


def records(part: Range, size: int = BLOCK_BYTES) -> Iterator[tuple[Lines, int, int, bool]]:
    """(lines, first, number, whole): runs of records of four lines that start inside the range.

    In a later range the first record is the first line with ``@`` whose second
    next line starts with ``+``: a quality line may start with ``@``, but two
    lines further lies a sequence then, which never starts with ``+``. A last record of two or
    three lines counts, as it has its id and sequence; ``whole`` is false for a run that ends with it.
    """
    synced = part.start == 0
    for lines, keep, last in line_blocks(part, size):
        first = 0
        if not synced:
            heads = np.flatnonzero((lines.first[:-2] == ord("@")) & (lines.first[2:] == ord("+")))
            if not len(heads):
                # a head may stand in the last two lines
                keep(min(2, len(lines)))
                continue
            first, synced = int(heads[0]), True
        rest = (len(lines) - first) % 4
        number, whole = (len(lines) - first) // 4, True
        if last and rest >= 2:
            number, whole = number + 1, False
        starts = lines.offsets[first : first + 4 * number : 4]
        inside = number if part.end is None else int(np.searchsorted(starts, part.end))
        if inside:
            yield lines, first, inside, whole or inside < number
        if inside < number:
            return
        keep(rest)


def read_fastq(
    spark: SparkSession,
    path: str,
    sample_id: str | None = None,
    limit: int = -1,
    num_partitions: int | None = None,
    glob: str = PATTERNS,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """A1. (sample_id, read_id, read, pair) of a FASTQ file or folder.

    The sample is the given name, else the folder the file lies in. ``pair`` is
    the part of the id after its last ``/``.
    """
    spark.dataSource.register(FastqSource)
    raw = spark.read.format("fastq").options(glob=glob, splitBytes=split_bytes, quality="false").load(path)
    folder = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "^[^=]*=", "")
    df = raw.filter(F.col("read_id") != "+").select(
        (F.lit(sample_id) if sample_id is not None else folder).alias("sample_id"),
        "read_id",
        "read",
        pair_suffix("read_id").alias("pair"),
    )
    if limit > 0:
        df = df.limit(limit)
    return df.repartition(num_partitions) if num_partitions else df
