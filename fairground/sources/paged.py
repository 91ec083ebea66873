"""A folder of Parquet landings as a source that can be read in steps of a bounded number of rows.

Spark's own file stream is bounded by files or bytes, never by rows; this one hands out at most ``rowsPerTrigger`` rows
a trigger, so an update job keeps its rate whatever the size of a landing. Meant for page archives
(``PAGE``: page_id, url, html) and for any other landed table.

Layout: each landing is a folder (complete once it holds ``_SUCCESS``) or a file directly below ``path``, and is never
changed. Landings are read in the natural order of their names (``batch=9`` before ``batch=10``), so a new one must
have a name behind all earlier ones; one that turns up further ahead, or a landing that was read and is gone, stops the
stream with an error instead of being passed over.

An offset is the landing, the file in it and the row in that. Planning reads the names of the landings and the footers
of just the files a trigger takes. Tasks are row groups, cut at a trigger's ends: a trigger far smaller than a row group
decodes the group's first rows again each time, which ``land`` avoids by row groups of a trigger's size. Paths are those that Arrow's file systems open (local, file:, hdfs:,
s3:, gs:).

Nulls, empty texts and repeated rows come out as they are; a column that a file doesn't have is null, further columns
are not read; an empty folder gives an empty table (its schema must be stated). Where the schema is taken from the first
file, timestamps that Spark stored in its old 96-bit form have no zone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

PAGE = "page_id long, url string, html string"
ROWS_PER_TRIGGER = 1_000_000
START = {"landing": "", "number": 0, "file": "", "row": 0}


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``last`` (exclusive; None: all) of a file."""

    path: str
    first: int = 0
    last: int | None = None


def _natural(name: str) -> list:
    return [(0, int(part), "") if part.isdigit() else (1, 0, part) for part in re.split(r"(\d+)", name)]


class _Folder:
    """Landings, files and row groups below a path."""

    def __init__(self, path: str):
        self.fs, self.path = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)

    def _below(self, path: str) -> list[fs.FileInfo]:
        found = self.fs.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted((f for f in found if f.base_name[0] not in "._"), key=lambda f: _natural(f.base_name))

    def landings(self, known: int = 0) -> list[fs.FileInfo]:
        """All landings in order up to the first incomplete one; the first ``known`` need no second look."""
        out = []
        for i, one in enumerate(self._below(self.path)):
            if i >= known and one.type == fs.FileType.Directory:
                if self.fs.get_file_info(f"{one.path}/_SUCCESS").type == fs.FileType.NotFound:
                    break
            out.append(one)
        return out

    def files(self, landing: fs.FileInfo) -> list[fs.FileInfo]:
        return [landing] if landing.type == fs.FileType.File else self._below(landing.path)

    def open(self, path: str) -> pq.ParquetFile:
        return pq.ParquetFile(self.fs.open_input_file(path), coerce_int96_timestamp_unit="us")

    def groups(self, path: str) -> list[int]:
        with self.open(path) as file:
            return [file.metadata.row_group(i).num_rows for i in range(file.num_row_groups)]

    def after(self, offset: dict) -> Iterator[tuple[int, str, fs.FileInfo, int]]:
        """(landing's number, its name, file, first row) from an offset on."""
        known = offset["number"]
        landings = self.landings(known)
        if known and (len(landings) < known or landings[known - 1].base_name != offset["landing"]):
            raise ValueError(f"{self.path}: landings before {offset['landing']} have changed since they were read")
        for number, landing in enumerate(landings[max(known - 1, 0) :], max(known, 1)):
            for file in self.files(landing):
                if number > known or _natural(file.base_name) > _natural(offset["file"]):
                    yield number, landing.base_name, file, 0
                elif file.base_name == offset["file"]:
                    yield number, landing.base_name, file, offset["row"]


class PagedTable(DataSource):
    """Format ``paged_table``; options ``path`` and ``rowsPerTrigger``."""

    @classmethod
    def name(cls) -> str:
        return "paged_table"

    def schema(self) -> StructType:
        folder = _Folder(self.options["path"])
        for _, _, file, _ in folder.after(START):
            with folder.open(file.path) as opened:
                return from_arrow_schema(opened.schema_arrow)
        raise ValueError(f"{self.options['path']} is empty: state a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], schema, int(self.options.get("rowsPerTrigger", ROWS_PER_TRIGGER)))


class _Reader:
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        wanted = to_arrow_schema(self.columns)
        with _Folder(self.path).open(partition.path) as file:
            named = [c for c in wanted.names if c in file.schema_arrow.names]
            at, last = 0, file.metadata.num_rows if partition.last is None else partition.last
            for group in range(file.num_row_groups):
                size = file.metadata.row_group(group).num_rows
                if at + size <= partition.first or at >= last:
                    at += size
                    continue
                for batch in file.iter_batches(1_000, row_groups=[group], columns=named):
                    low, high = max(partition.first - at, 0), min(last - at, batch.num_rows)
                    at += batch.num_rows
                    if low < high:
                        yield _fitted(batch.slice(low, high - low), wanted)


def _fitted(batch: pa.RecordBatch, wanted: pa.Schema) -> pa.RecordBatch:
    have = set(batch.schema.names)
    arrays = [batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in wanted]
    return pa.RecordBatch.from_arrays(arrays, schema=wanted)


class _BatchReader(_Reader, DataSourceReader):
    """All complete landings, one task a file."""

    def partitions(self) -> list[Rows]:
        files = [Rows(file.path) for _, _, file, _ in _Folder(self.path).after(START)]
        return files or [Rows("")]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class _StreamReader(_Reader, DataSourceStreamReader):
    """A trigger takes the rows after the last planned offset; a restarted query plans its last offset first."""

    def __init__(self, path: str, schema: StructType, limit: int):
        super().__init__(path, schema)
        if limit < 1:
            raise ValueError("rowsPerTrigger must be at least 1")
        self.limit, self.planned = limit, START

    def initialOffset(self) -> dict:
        return START

    def latestOffset(self) -> dict:
        left, offset, folder = self.limit, self.planned, _Folder(self.path)
        for number, landing, file, first in folder.after(self.planned):
            taken = min(sum(folder.groups(file.path)) - first, left)
            offset, left = {"landing": landing, "number": number, "file": file.base_name, "row": first + taken}, left - taken
            if not left:
                break
        return offset

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        self.planned = end
        out, folder = [], _Folder(self.path)
        for number, _, file, first in folder.after(start) if start != end else ():
            final = (number, file.base_name) == (end["number"], end["file"])
            at = 0
            for size in folder.groups(file.path):
                low, high = max(first, at), min(at + size, end["row"]) if final else at + size
                if low < high:
                    out.append(Rows(file.path, low, high))
                at += size
            if final:
                break
        return out


def land(df: DataFrame, path: str, rows: int) -> None:
    """Write a landing to be read ``rows`` rows a trigger: row groups hold no more, so a trigger decodes no row that isn't
    its own but for the groups at its two ends."""
    df.write.option("parquet.block.row.count.limit", str(rows)).option("compression", "zstd").parquet(path)


def read_paged(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """The landings below a folder as a table. Plain ``spark.read.parquet`` prunes columns by itself; this reader reads
    what ``schema`` names."""
    spark.dataSource.register(PagedTable)
    reader = spark.read.format(PagedTable.name()).option("path", path)
    return (reader.schema(schema) if schema else reader).load()


def stream_paged(spark: SparkSession, path: str, rows: int, schema: str | StructType | None = None) -> DataFrame:
    """The same as a stream of at most ``rows`` rows a trigger. Run it with a processing-time trigger (its interval and
    ``rows`` make the rate): ``availableNow`` takes one step only, as the source can't tell its end beforehand."""
    spark.dataSource.register(PagedTable)
    reader = spark.readStream.format(PagedTable.name()).option("path", path).option("rowsPerTrigger", rows)
    return (reader.schema(schema) if schema else reader).load()
