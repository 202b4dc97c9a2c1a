"""Lines of ZIP archives as a Spark data source.

``spark.read.format("archive_lines")`` has one partition per archive (an
archive's central directory is at its end, so it cannot be split) and reads
the archive's first member with the wanted suffix. Neither archive nor member
is ever held: the member is inflated and decoded block by block, first only to
find the encoding, then to give lines in Arrow batches of bounded size.
Archives are opened by path on a folder that the executors share, or by any
URI that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import codecs
import io
import json
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import package_on_workers

SCHEMA = "path string, member string, line_no bigint, line string"
#: Bytes that are decoded, and characters of lines that are handed on, at a time.
BLOCK = 1 << 20


def opened(uri: str):
    """A seekable binary stream."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return open(uri, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def member_of(archive: zipfile.ZipFile, suffix: str) -> str | None:
    return min((n for n in archive.namelist() if n.lower().endswith(suffix)), default=None)


def encoding_of(archive: zipfile.ZipFile, member: str, encodings: list[str], path: str) -> str:
    """The first encoding that decodes the whole member, read block by block."""
    for name in encodings:
        decoder = codecs.getincrementaldecoder(name)()
        try:
            with archive.open(member) as f:
                while block := f.read(BLOCK):
                    decoder.decode(block)
            decoder.decode(b"", True)
            return name
        except UnicodeDecodeError:
            continue
    raise ValueError(f"{path}: not in any of the encodings {tuple(encodings)}")


def archive_lines(path: str, suffix: str, encodings: list[str]):
    """(member, first line number, lines) in runs of about BLOCK characters."""
    with opened(path) as raw, zipfile.ZipFile(raw) as archive:
        member = member_of(archive, suffix)
        if member is None:
            return
        name = encoding_of(archive, member, encodings, path)
        with io.TextIOWrapper(archive.open(member), encoding=name) as text:
            at, lines, size = 0, [], 0
            for line in text:
                lines.append(line.removesuffix("\n"))
                size += len(line)
                if size >= BLOCK:
                    yield member, at, lines
                    at, lines, size = at + len(lines), [], 0
            if lines:
                yield member, at, lines


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.suffix = options.get("suffix", ".csv").lower()
        self.encodings = json.loads(options.get("encodings", '["utf-8", "iso-8859-1"]'))

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        import pyarrow as pa

        path = partition.value
        for member, at, lines in archive_lines(path, self.suffix, self.encodings):
            n = len(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array([member] * n), pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.string())],
                names=["path", "member", "line_no", "line"])


class ArchiveLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, paths: list[str], suffix: str = ".csv", encodings: tuple = ("utf-8", "iso-8859-1")) -> DataFrame:
    """(path, member, line_no, line) of the archives."""
    package_on_workers(spark)
    spark.dataSource.register(ArchiveLines)
    reader = spark.read.format("archive_lines").option("paths", json.dumps(list(paths)))
    return reader.option("suffix", suffix).option("encodings", json.dumps(list(encodings))).load()
