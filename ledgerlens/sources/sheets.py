"""S2 as a Python data source: delimited files with banner rows before their header.

``spark.read.format("sheet").option("header_row", 1).option("data_start", 2).load(path)``: one partition per file, read
as a stream, so that a file may be of any size. Each file has its own header; the table has the columns of all headers
together, in order of first appearance, unless a schema is given. Headers are collected by a job of their own
(``option("rows", "headers")``), one task per file, of which only the distinct names reach the driver.
"""

from __future__ import annotations

import csv
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package

HEADERS = T.StructType().add("source_file", "string").add("position", "integer").add("name", "string")
#: Rows of an Arrow batch.
BATCH_ROWS = 8192


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI as Spark writes it (``file:/tmp/x``) or of a plain path."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """Files under a folder (or the file itself), without those that Spark hides (``_x`` but for ``_x=1``, and ``.x``)."""
    fs, at = located(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    below = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    base = path.rstrip("/")
    names = [i.path[len(at.rstrip("/")):] for i in below if i.type == pafs.FileType.File]
    hidden = lambda p: p[:1] == "." or p[:1] == "_" and "=" not in p
    return sorted(base + n for n in names if not any(map(hidden, n.split("/"))))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SheetReader(DataSourceReader):
    """Reads the files of one folder; a file is one partition."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.header_row, self.data_start = int(options.get("header_row", 1)), int(options.get("data_start", 2))
        self.headers_only = options.get("rows") == "headers"

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)]

    def read(self, partition: _File | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        fs, at = located(partition.path)
        with fs.open_input_stream(at) as raw, io.TextIOWrapper(raw, "utf-8-sig", newline="") as text:
            # a cell without quotes that is empty is NULL, a quoted empty one is an empty text
            records = csv.reader(text, quoting=csv.QUOTE_NOTNULL)
            if self.headers_only:
                header = next(itertools.islice(records, self.header_row, None), [])
                names = [n for n in dict.fromkeys(header) if n is not None]
                yield pa.RecordBatch.from_pylist(
                    [{"source_file": partition.path, "position": i, "name": n} for i, n in enumerate(names)],
                    pa.schema([("source_file", pa.string()), ("position", pa.int32()), ("name", pa.string())]))
                return
            yield from self._batches(records, partition.path)

    def _batches(self, records: Iterator[list], path: str) -> Iterator[pa.RecordBatch]:
        head = list(itertools.islice(records, self.data_start))
        header = head[self.header_row] if len(head) > self.header_row else []
        place = {n: i for i, n in reversed(list(enumerate(header)))}
        kinds = pa.schema([(f.name, pa.int64() if f.name == "ordinal" else pa.string()) for f in self.schema])
        for first in itertools.count(0, BATCH_ROWS):
            rows = list(itertools.islice(records, BATCH_ROWS))
            if not rows:
                return
            kept = [i for i, r in enumerate(rows) if r]  # an empty line is no row, but counts
            cells = list(itertools.zip_longest(*(rows[i] for i in kept)))
            none = [None] * len(kept)
            own = {"source_file": [path] * len(kept), "ordinal": [first + i for i in kept]}
            columns = [own.get(f.name) if f.name in own else
                       cells[place[f.name]] if place.get(f.name, len(cells)) < len(cells) else none for f in self.schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.types)], schema=kinds)


class SheetSource(DataSource):
    """The ``sheet`` format. Without a schema: (source_file, ordinal) or, for ``rows=headers``, the header names."""

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> T.StructType:
        if self.options.get("rows") == "headers":
            return HEADERS
        return T.StructType().add("source_file", "string").add("ordinal", "long")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SheetReader(schema, dict(self.options))


def read_sheets(spark: SparkSession, path: str, header_row: int = 1, data_start: int = 2,
                columns: list[str] | None = None) -> DataFrame:
    """(source_file, ordinal, ...) of all files under ``path``.

    The columns are strings: ``columns``, or those of all headers in order of first appearance (file, then place). A
    column that a file lacks is NULL, as is an empty cell without quotes; of a name that a header repeats, the first
    column counts. Records may span lines and are numbered per file from ``data_start`` on; short records are filled
    with NULL. Nothing is shuffled but the header names.
    """
    ship_package(spark)
    spark.dataSource.register(SheetSource)
    source = lambda: (spark.read.format("sheet").option("header_row", header_row)
                      .option("data_start", data_start))
    if columns is None:
        names = (source().option("rows", "headers").load(path).groupBy("name")
                 .agg(F.min(F.struct("source_file", "position")).alias("at")).orderBy("at"))
        columns = [r["name"] for r in names.collect()]
    schema = T.StructType().add("source_file", "string").add("ordinal", "long")
    for name in columns:
        schema = schema.add(name, "string")
    return source().schema(schema).load(path)
