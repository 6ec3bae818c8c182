"""A data source of lines: transcripts with one record a line, cut by byte ranges, in batch and as a stream.

Each row has the path of its file, the byte at which its line begins, and the line. A range reads
the lines that begin in it, so that a file of any size is many tasks and the order within a file is
that of ``offset``, however it was cut. As a stream it gives the lines that were added since the last
batch, each once its end is written.

Edge cases: empty lines are left out; the last line counts without its end in batch, and waits for it in
a stream; bytes that are not UTF-8 are replaced; a file that shrinks is an error of the stream; a file that is gone
gives nothing more.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of a range, of one read, and lines of a batch.
RANGE, READ, BATCH = 64 << 20, 1 << 20, 1024
NAME = "codeloom_lines"
SCHEMA = "path string, offset long, value string"


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, whole: bool):
        self.path, self.start, self.end, self.whole = path, start, end, whole


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + posixpath.abspath(uri))


def sizes(uri: str, ending: str) -> dict[str, int]:
    """Sizes of a file, or of all files below a folder, by path."""
    from pyarrow import fs

    files, path = _opened(uri)
    info = files.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else []
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(ending)}


def lines(f, start: int, end: int, whole: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end); ``whole`` asks for their end, too."""
    at, buffer = max(start - 1, 0), b""
    f.seek(at)
    skipping = start > 0
    while at < end or buffer:
        more = f.read(READ)
        buffer += more
        cut = buffer.split(b"\n")
        buffer = cut.pop()
        for line in cut:
            if not skipping and at < end:
                yield at, line
            skipping = False
            at += len(line) + 1
        if at >= end and not skipping:
            return
        if not more:
            if buffer and not skipping and at < end and not whole:
                yield at, buffer
            return


def batches(uri: str, part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, str]] = []

    def batch():
        return pa.RecordBatch.from_pydict({"path": pa.array([part.path] * len(rows), pa.string()), "offset": pa.array([o for o, _ in rows], pa.int64()), "value": pa.array([v for _, v in rows], pa.string())})

    with _opened(uri)[0].open_input_file(part.path) as f:
        for offset, line in lines(f, part.start, part.end, part.whole):
            if line := line.removesuffix(b"\r"):
                rows.append((offset, line.decode("utf-8", "replace")))
            if len(rows) >= BATCH:
                yield batch()
                rows.clear()
    if rows:
        yield batch()


class _Options:
    def __init__(self, options: dict):
        self.uri, self.ending = options["path"], options.get("ending", "")
        self.range = int(options.get("bytes", RANGE))

    def cut(self, path: str, start: int, end: int, whole: bool) -> list[Range]:
        return [Range(path, i, min(i + self.range, end), whole) for i in range(start, end, self.range)]


class LineReader(_Options, DataSourceReader):
    def partitions(self) -> list[Range]:
        return [r for path, n in sorted(sizes(self.uri, self.ending).items()) for r in self.cut(path, 0, n, False)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(self.uri, partition) if partition is not None else iter(())


class LineStream(_Options, DataSourceStreamReader):
    """Offsets are the bytes of each file up to the end of its last whole line."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        files, _ = _opened(self.uri)
        out = {}
        for path, n in sizes(self.uri, self.ending).items():
            with files.open_input_file(path) as f:
                end = n
                while end > 0:
                    first = max(0, end - READ)
                    f.seek(first)
                    at = f.read(end - first).rfind(b"\n")
                    if at >= 0:
                        out[path] = first + at + 1
                        break
                    end = first
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        for path, n in start.items():
            if end.get(path, n) < n:
                raise ValueError(f"{path} is shorter than what was read of it")
        return [r for path, n in sorted(end.items()) for r in self.cut(path, start.get(path, 0), n, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(self.uri, partition)


class Lines(DataSource):
    """Options: ``path`` (a file or folder), ``ending`` (of file names), ``bytes`` (of a range)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(self.options)

    def streamReader(self, schema) -> LineStream:
        return LineStream(self.options)


def register(spark: SparkSession) -> str:
    """The name of the format, after it is known to the session."""
    spark.dataSource.register(Lines)
    return NAME
