"""File listing and byte ranges for the sequence sources."""

from __future__ import annotations

import fnmatch
import gzip
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import InputPartition

SPLIT_BYTES = 128 * 1024 * 1024
# tasks of short ranges; longer ranges have a task each
MOST_TASKS = 1024


@dataclass
class Range(InputPartition):
    """Bytes [start, end) of a file; ``end`` is None for a compressed file read as a whole."""

    path: str
    start: int
    end: int | None


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads one after the other."""

    parts: list[Range]


def tasks(parts: list[Range], most: int = MOST_TASKS) -> list[Ranges]:
    """Ranges dealt to ``most`` tasks, or to more that read no more than ``SPLIT_BYTES`` each; neighbours stay together."""
    whole = sum(SPLIT_BYTES if p.end is None else p.end - p.start for p in parts)
    each = max(1, len(parts) // max(1, most, -(-whole // SPLIT_BYTES)))
    return [Ranges(parts[i : i + each]) for i in range(0, len(parts), each)]


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def readable(path: str) -> bool:
    """Whether Python finds the folder that Spark has written."""
    try:
        system, root = resolve(path)
        return system.get_file_info(root).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def read_folder(path: str, columns: list[str], types: list[pa.DataType]) -> pa.Table:
    """Columns of the Parquet files of a folder, none if it isn't there."""
    system, root = resolve(path)
    files = [f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".parquet")]
    schema = pa.schema(list(zip(columns, types)))
    return pa.concat_tables([schema.empty_table(), *[pq.ParquetFile(system.open_input_file(f)).read(columns).select(columns).cast(schema) for f in sorted(files)]])


def ranges(path: str, patterns: list[str], split_bytes: int) -> list[Range]:
    """Compressed files whole, plain files in ranges."""
    system, root = resolve(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        files = [info]
    else:
        listed = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [f for f in listed if f.is_file and any(fnmatch.fnmatch(f.base_name, p) for p in patterns)]
    prefix = path[: path.index("://") + 3] if "://" in path else ""
    out = []
    for f in sorted(files, key=lambda f: f.path):
        # from_uri keeps authority or bucket in the path for object stores, not for hdfs:// or file://
        name = _uri(path, root, f.path) if prefix else f.path
        if f.base_name.endswith(".gz"):
            out.append(Range(name, 0, None))
        else:
            out += [Range(name, i, min(i + split_bytes, f.size)) for i in range(0, f.size, split_bytes)]
    return out


def _uri(given: str, root: str, found: str) -> str:
    return given.rstrip("/") + found[len(root.rstrip("/")) :]


BLOCK_BYTES = 4 << 20
BEYOND = 1 << 12


def blocks(part: Range, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """Raw bytes from the range's start on, or the text of a compressed file; they don't stop at the range's end.

    The first block of a short range ends a little after it, for the record that the end cuts.
    """
    system, name = resolve(part.path)
    if part.end is None:
        with system.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            while block := stream.read(size):
                yield block
        return
    with system.open_input_file(name) as raw:
        # one byte earlier: a line that starts right at the range belongs to it
        raw.seek(max(part.start - 1, 0))
        size = min(size, part.end - part.start + BEYOND)
        while block := raw.read(size):
            yield block


class Lines:
    """Whole lines of a block: places of their starts, and their text as an Arrow array without line ends."""

    def __init__(self, data: bytes, offset: int):
        buffer = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(buffer == 10) + 1
        self.bounds = np.concatenate(([0], ends))
        self.offsets = offset + self.bounds[:-1]
        self.first = buffer[self.bounds[:-1]]
        self.data = data

    def __len__(self) -> int:
        return len(self.first)

    def text(self, at: np.ndarray) -> pa.Array:
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.bounds.astype(np.int64)), pa.py_buffer(self.data)])
        return pc.ascii_rtrim(whole.take(pa.array(at)).cast(pa.string()), "\r\n")


def line_blocks(part: Range, size: int = BLOCK_BYTES) -> Iterator[tuple[Lines, Callable[[int], None], bool]]:
    """Lines from the first one that starts at or after the range's start on, block by block.

    Yields (lines, keep, last). ``keep(n)`` hands the last ``n`` lines to the next block; ``last`` is
    true once, at the end of the file, for what was kept and a line without an end.
    """
    position = max(part.start - 1, 0)
    held, cut = b"", part.start > 0
    kept = [0]

    def keep(n: int) -> None:
        kept[0] = n

    for block in blocks(part, size):
        data = held + block
        if cut:
            at = data.find(b"\n") + 1
            if not at:
                # still inside the line before the range
                position += len(data)
                held = b""
                continue
            position, data, cut = position + at, data[at:], False
        stop = data.rfind(b"\n") + 1
        if stop:
            lines = Lines(data[:stop], position)
            kept[0] = 0
            yield lines, keep, False
            start = int(lines.bounds[len(lines) - kept[0]])
            position, held = position + start, data[start:]
        else:
            held = data
    if not cut:
        if held and not held.endswith(b"\n"):
            held += b"\n"
        yield Lines(held, position), keep, True
