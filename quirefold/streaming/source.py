"""A streaming source over a log of numbered events: a Python data source with offsets, for replay from any event."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "event_log"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    """Events of one row group numbered from `first` and below `end`."""

    path: str
    group: int
    first: int
    end: int


class EventLogReader(DataSourceStreamReader):
    """An offset is the number that the next event to be read may have at least.

    The log is a Parquet file, or a folder of such files, with a column of rising event numbers; files come, and are
    never changed. Numbers of a file that comes later are above all earlier ones. Only footers are read to plan a
    batch, so the driver holds two numbers for each row group. Events without a number are never read.
    """

    def __init__(self, schema: StructType, options: dict):
        self.columns = schema.fieldNames()
        self.path, self.number, self.first = options["path"], options.get("number", "id"), int(options.get("from", 0))

    def groups(self) -> Iterator[tuple[str, int, int, int]]:
        """(path, row group, least number, greatest number) of the log's files."""
        system, root = _opened(self.path)
        info = system.get_file_info(root)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        hidden = lambda f: any(part[0] in "._" for part in f.path[len(info.path) :].split("/") if part)  # noqa: E731  being written
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".parquet") and not hidden(f)), key=lambda f: f.path):
            meta = pq.read_metadata(f.path, filesystem=system)
            at = meta.schema.names.index(self.number)
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(at).statistics
                if stats is None or not (stats.has_min_max or stats.null_count == meta.row_group(g).num_rows):
                    raise ValueError(f"{f.path}: row group {g} has no least and greatest {self.number}")
                if stats.has_min_max:
                    yield f.path, g, stats.min, stats.max

    def initialOffset(self) -> dict:
        return {"number": self.first}

    def latestOffset(self) -> dict:
        return {"number": max([self.first, *(high + 1 for *_, high in self.groups())])}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        first, last = start["number"], end["number"]
        return [Stretch(path, g, first, last) for path, g, low, high in self.groups() if low < last and high >= first]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        with pq.ParquetFile(partition.path, filesystem=system) as file:
            for batch in file.iter_batches(row_groups=[partition.group], columns=list({*self.columns, self.number})):
                n = batch.column(self.number)
                yield batch.filter(pc.and_(pc.greater_equal(n, partition.first), pc.less(n, partition.end))).select(self.columns)


class EventLog(DataSource):
    """`spark.readStream.format("event_log")` with a schema and the options path, number (the column, else id) and from."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamReader(self, schema: StructType) -> EventLogReader:
        return EventLogReader(schema, self.options)


def event_log(spark: SparkSession, path: str, number: str, first: int = 0) -> DataFrame:
    """A stream of the log's events numbered `first` and above."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format(FORMAT).schema(spark.read.parquet(path).schema).option("path", path).option("number", number).option("from", str(first)).load()
