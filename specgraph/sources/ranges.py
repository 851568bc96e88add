"""Byte ranges of files, read inside tasks: ranges that are near each other come with one read.

Files are opened by Arrow's file systems, so this serves mounted folders and the stores that Arrow reaches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.storage import arrow_rows

#: Ranges no further apart are read together, up to so many bytes.
GAP, MOST = 64 << 10, 8 << 20


def place_of(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, name in it) of a path or URI as Spark writes it."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return pafs.LocalFileSystem(), path


class RangeFile:
    """A file read by ranges; ``reads`` and ``bytes_read`` count what was asked of the store."""

    def __init__(self, path: str):
        fs, name = place_of(path)
        self.path, self.file = path, fs.open_input_file(name)
        self.length, self.reads, self.bytes_read = self.file.size(), 0, 0

    def read(self, start: int, end: int) -> bytes:
        self.reads += 1
        out = self.file.read_at(max(0, end - start), start)
        self.bytes_read += len(out)
        return out

    def close(self) -> None:
        self.file.close()


def merged(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, numbers of ranges) of the reads that serve ranges in order of their starts; a range longer than ``most`` is a read by itself."""
    first, last, own = 0, -1, []
    for i, (a, b) in enumerate(ranges):
        if own and (a > last + gap or max(b, last) - first > most):
            yield first, last, own
            own = []
        if not own:
            first, last = a, b
        last = max(last, b)
        own.append(i)
    if own:
        yield first, last, own


def raw_blocks(blocks: DataFrame, gap: int = GAP, most: int = MOST) -> DataFrame:
    """Rows of (file_path, start, end, ...) with ``raw``, the text of their bytes, and ``read_start``, where the read began that it came with.

    Rows are range-partitioned by file and start, so a file with very many rows is many tasks' and a task reads in one direction.
    Bytes that aren't UTF-8 become replacement characters; a null in path, start or end gives a null text.  A range beyond
    the file's end gives what there is.
    """
    spark = blocks.sparkSession
    at = [blocks.columns.index(c) for c in ("file_path", "start", "end")]
    out = blocks.withColumns({"raw": F.lit(None).cast("string"), "read_start": F.lit(None).cast("long")})
    width, names = len(blocks.columns), out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        try:
            for batch in batches:
                paths, starts, ends = (batch.column(i).to_pylist() for i in at)
                raw: list = [None] * batch.num_rows
                from_: list = [None] * batch.num_rows
                known = [i for i in range(batch.num_rows) if None not in (paths[i], starts[i], ends[i])]
                cuts = [k for k in range(len(known)) if k == 0 or paths[known[k]] != paths[known[k - 1]]] + [len(known)]
                for first, last in zip(cuts[:-1], cuts[1:]):
                    own = known[first:last]
                    if paths[own[0]] != path:
                        if file:
                            file.close()
                        path, file = paths[own[0]], RangeFile(paths[own[0]])
                    for a, b, which in merged([(starts[i], ends[i]) for i in own], gap, most):
                        data = file.read(a, b)
                        for i in (own[k] for k in which):
                            raw[i], from_[i] = data[starts[i] - a : max(ends[i] - a, 0)].decode("utf-8", "replace"), a
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(raw, pa.string()), pa.array(from_, pa.int64())], names)
        finally:
            if file:
                file.close()

    with arrow_rows(spark, 500):
        return blocks.repartitionByRange("file_path", "start").sortWithinPartitions("file_path", "start").mapInArrow(run, out.schema)
