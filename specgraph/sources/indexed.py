"""Scan files read by their own index: a data source whose tasks fetch only the scans that are asked for.

A file is cut into parts of about ``part_bytes``; a part owns the scans that start in it.  Its
task reads the end of the file, from there the index, and then the byte ranges of its own scans, near ones
together.  Scan numbers that are asked for are chosen from the index before anything else is
read; for one level the head of each scan is read first where scans are large.
What is asked for is part of the read, not of a filter: in Spark 4.1 a Python source that takes filters keeps
those of one scan for the next scan of the same table in a query (a table joined to itself gives wrong rows).
Where the index is missing, torn or points elsewhere, the part finds its scans by their tags.

``read`` gives the same rows as the readers in ``mzxml`` and ``mzml``, which also serve stores that Arrow doesn't reach.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from specgraph.sources import mzml, mzxml, xmlscan
from specgraph.sources.ranges import RangeFile, merged

FORMAT = "scan_files"
#: Bytes of a part; of a file's end that holds the place of the index; of a scan's head; of a step when tags are sought.
PART, TAIL, HEAD, STEP = 64 << 20, 1024, 2048, 4 << 20
#: Bytes of a file's beginning that are searched for the number of its scans.
COUNT = 16 << 10
#: Scans larger than this on average are looked at by their heads before a whole scan of another level is read.
LARGE = 16 << 10


@dataclass(frozen=True)
class Kind:
    """What differs between the two formats."""

    at: re.Pattern  #: the place of the index, in the file's end
    entry: re.Pattern  #: (scan number, offset) in the index
    start: re.Pattern  #: a scan's start tag
    close: bytes
    level: re.Pattern
    count: re.Pattern  #: the number of scans, in the file's beginning
    module: object


KINDS = {
    "mzxml": Kind(re.compile(rb"<indexOffset>\s*(\d+)\s*</indexOffset>"), re.compile(rb'<offset\s[^>]*\bid="(\d+)"[^>]*>\s*(\d+)\s*</offset>'), re.compile(rb"<scan[\s>]"), b"</peaks>", re.compile(rb'\bmsLevel="(\d+)"'), re.compile(rb'<msRun\s[^>]*\bscanCount="(\d+)"'), mzxml),
    "mzml": Kind(re.compile(rb"<indexListOffset>\s*(\d+)\s*</indexListOffset>"), re.compile(rb'<offset\s[^>]*\bidRef="[^"]*\bscan=(\d+)[^"]*"[^>]*>\s*(\d+)\s*</offset>'), re.compile(rb"<spectrum\s"), b"</spectrum>", re.compile(rb'<cvParam\s(?=[^>]*name="ms level")[^>]*value="(\d+)"'), re.compile(rb'<spectrumList\s[^>]*\bcount="(\d+)"'), mzml),
}


class BrokenIndex(Exception):
    """The index doesn't lead to the scans."""


def index_of(file: RangeFile, kind: Kind) -> tuple[list[tuple[int, int]], int]:
    """([(start, scan number)] in order, where the index begins); every other fault than a missing one shows when scans are read."""
    tail = file.read(max(0, file.length - TAIL), file.length)
    found = kind.at.search(tail)
    if found is None or int(found[1]) >= file.length:
        raise BrokenIndex("no place of the index")
    begin = int(found[1])
    entries = sorted((int(m[2]), int(m[1])) for m in kind.entry.finditer(file.read(begin, file.length)))
    if any(a >= begin for a, _ in entries[-1:]) or any(a[0] == b[0] for a, b in zip(entries, entries[1:])):
        raise BrokenIndex("offsets beyond the index, or the same one twice")
    count = kind.count.search(file.read(0, min(file.length, COUNT)))
    if count is not None and int(count[1]) != len(entries):
        raise BrokenIndex("not all scans are listed")
    return entries, begin


@dataclass
class Part(InputPartition):
    path: str
    length: int
    start: int
    end: int


def _by_index(file: RangeFile, kind: Kind, part: Part, ids: set[int] | None, level: int | None) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the part's scans; bytes reach to the next scan."""
    entries, begin = index_of(file, kind)
    own = [(a, n, b) for (a, n), (b, _) in zip(entries, [*entries[1:], (begin, 0)]) if part.start <= a < part.end and (ids is None or n in ids)]
    if level is not None and own and sum(b - a for a, _, b in own) > LARGE * len(own):
        heads = [(a, min(b, a + HEAD)) for a, _, b in own]
        kept = []
        for first, last, which in merged(heads, gap=HEAD):
            data = file.read(first, last)
            for i in which:
                found = kind.level.search(data, heads[i][0] - first, heads[i][1] - first)
                if found is None or int(found[1]) == level:  # a head that doesn't tell is read whole
                    kept.append(own[i])
        own = kept
    for first, last, which in merged([(a, b) for a, _, b in own]):
        data = file.read(first, last)
        for a, n, b in (own[i] for i in which):
            content = data[a - first : b - first]
            head = kind.start.match(content)
            if head is None or not re.search(rb'(?:\bnum="|\bscan=)%d\b' % n, content[: content.find(b">") + 1]):
                raise BrokenIndex(f"no scan {n} at {a}")
            yield a, content


def _by_tags(file: RangeFile, kind: Kind, part: Part) -> Iterator[tuple[int, bytes]]:
    """The same by start tags: a part's last scan ends beyond it, where the next one starts or the file ends."""
    at, held, base = part.start, b"", part.start
    while True:
        starts = [m.start() for m in kind.start.finditer(held)]
        ended = at >= file.length
        # All scans but the last seen are whole; the last is when its end tag is there or nothing follows.
        whole = len(starts) if ended or (starts and held.find(kind.close, starts[-1]) >= 0) else len(starts) - 1
        for i in range(max(whole, 0)):
            if base + starts[i] >= part.end:
                return
            yield base + starts[i], held[starts[i] : starts[i + 1] if i + 1 < len(starts) else len(held)]
        if ended:
            return
        keep = starts[whole] if 0 <= whole < len(starts) else max(0, len(held) - 16)  # a tag may be cut
        if not starts and base + keep >= part.end or 0 <= whole < len(starts) and base + keep >= part.end:
            return
        step = file.read(at, min(file.length, at + STEP))
        held, base, at = held[keep:] + step, base + keep, at + len(step)


class ScanFilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema=None):
        self.schema = to_arrow_schema(schema or _parse_datatype_string(xmlscan.SCANS))
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.kind_name = options.get("kind") or xmlscan.kind_of(self.paths[0]) or ""
        if self.paths and self.kind_name not in KINDS:
            raise ValueError(f"unknown kind {self.kind_name!r}")
        self.mode, self.min_peaks, self.part = options.get("mode", "FAILFAST"), int(options.get("minpeaks", options.get("minPeaks", 0))), int(options.get("partbytes", options.get("partBytes", PART)))
        if self.mode not in ("FAILFAST", "DROPMALFORMED"):
            raise ValueError(f"unknown mode {self.mode!r}")
        self.ids: set[int] | None = set(json.loads(options["nativeids"])) if "nativeids" in options else None
        self.level: int | None = int(options["mslevel"]) if "mslevel" in options else None
        #: Counts of the last read, for whoever calls ``read`` by hand.
        self.last: RangeFile | None = None

    def partitions(self) -> list[Part]:
        """Parts by bytes; a few scans by number need no more than one task for each file."""
        out = []
        for path in self.paths:
            file = RangeFile(path)
            n = 1 if self.ids is not None else max(1, -(-file.length // self.part))
            cuts = [file.length * k // n for k in range(n + 1)]
            out += [Part(path, file.length, a, b) for a, b in zip(cuts[:-1], cuts[1:])]
            file.close()
        return out or [Part("", 0, 0, 0)]

    def _rows(self, path: str, scans: Iterator[tuple[int, bytes]]) -> Iterator[dict]:
        kind = KINDS[self.kind_name]
        for offset, content in scans:
            start, end = next(iter(kind.module.blocks(content)), (None, None))
            if start is None:
                continue
            row = xmlscan.scan_row(path, kind.module.parse, content[start:end], self.mode, self.min_peaks)
            if row is not None and (self.ids is None or row.get("native_id") is None or row["native_id"] in self.ids) and (self.level is None or row.get("ms_level") in (None, self.level)):
                yield {"file_path": path, "file_stem": xmlscan.stem_of(path), "start": offset + start, "end": offset + end} | row

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        file = self.last = RangeFile(partition.path)
        kind = KINDS[self.kind_name]
        try:
            try:
                # Held until all of the part's scans have proved the index right; a part is bounded.
                batches = list(_batched(self._rows(partition.path, _by_index(file, kind, partition, self.ids, self.level)), self.schema))
            except BrokenIndex:
                batches = _batched(self._rows(partition.path, _by_tags(file, kind, partition)), self.schema)
            yield from batches
        finally:
            file.close()


def _batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= 200:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


class ScanFiles(DataSource):
    """Options: path, or paths (JSON list); kind (mzxml, mzml; by the file's name if left out), mode, minPeaks, partBytes, nativeIds (JSON list), msLevel."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return xmlscan.SCANS

    def reader(self, schema):
        return ScanFilesReader({k.lower(): v for k, v in dict(self.options).items()}, schema)


def read(spark: SparkSession, paths: list[str], kind: str, mode: str = "FAILFAST", min_peaks: int = 0, part_bytes: int = PART, native_ids: list[int] | None = None, ms_level: int | None = None) -> DataFrame:
    """Scans of all files (columns ``xmlscan.SCANS``, files named as in ``paths``): all, or those of some numbers or one level.

    Scans that aren't asked for aren't checked either; rows of bad scans that are met (DROPMALFORMED) have no number and stay.
    """
    spark.dataSource.register(ScanFiles)
    options = {"paths": json.dumps([str(p) for p in paths]), "kind": kind, "mode": mode, "minPeaks": str(min_peaks), "partBytes": str(part_bytes)}
    options |= {"nativeIds": json.dumps(sorted(native_ids))} if native_ids is not None else {}
    options |= {"msLevel": str(ms_level)} if ms_level is not None else {}
    return spark.read.format(FORMAT).options(**options).load()
