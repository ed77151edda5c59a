"""Sources that plan their own partitions: lines of files by byte ranges, and tables of SQLite files by row ids.

Both are Python data sources (``register`` makes them known to a session). A file is cut into ranges, each range is a
task, and a line belongs to the range that its first byte is in, so every line is read once, with its offset. Offsets
give an index for point reads, and the order of all lines of a folder: files by name, lines by offset.

Paths are read through ``pyarrow.fs``; workers must be able to reach them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, bytes read at once, and rows of a batch.
SPLIT, CHUNK, ROWS = 32 << 20, 1 << 20, 8192


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all data files of a folder by name; names that start with _ or . are left out."""
    system, inside = _opened(path)
    info = system.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(inside, recursive=True)) if f.is_file]
    return sorted((f.path, f.size) for f in found if info.is_file or not f.base_name.startswith(("_", ".")))


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int

    def __hash__(self) -> int:
        return hash((self.path, self.low))


def lines_of(path: str, low: int, high: int, uri: str, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of the lines that start in ``low`` to ``high`` - 1."""
    system = _opened(uri)[0]
    with system.open_input_file(path) as f:
        at = max(0, low - 1)
        f.seek(at)
        rest, start = b"", at
        skip = low > 0  # what comes before the first line end from low - 1 on is another range's
        while start < high or skip:
            data = f.read(chunk)
            if not data:
                if rest and not skip:
                    yield start, rest
                return
            parts = (rest + data).split(b"\n")
            rest = parts.pop()
            for part in parts:
                if not skip and start < high:
                    yield start, part
                skip = False
                start += len(part) + 1
                if start >= high:
                    return


class LinesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.split, self.key = options["path"], int(options.get("split_bytes", SPLIT)), options.get("key")
        self.with_value = str(options.get("with_value", "true")).lower() == "true"

    def partitions(self) -> list[Range]:
        return [Range(path, a, min(a + self.split, size)) for path, size in files_under(self.uri) for a in range(0, size, self.split)]

    def _batch(self, part: Range, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        keys = [None if self.key is None or not line.strip() else json.loads(line).get(self.key) for _, line in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part.path] * len(rows), pa.string()), pa.array([part.low] * len(rows), pa.int64()), pa.array([a for a, _ in rows], pa.int64()), pa.array([len(line) for _, line in rows], pa.int64()),
                pa.array([None if k is None else str(k) for k in keys], pa.string()), pa.array([line.decode("utf-8", "replace") if self.with_value else None for _, line in rows], pa.string()),
            ],
            names=["path", "split", "start", "length", "key", "value"],
        )

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []
        held = 0
        for row in lines_of(partition.path, partition.low, partition.high, self.uri):
            rows.append(row)
            held += len(row[1])
            if len(rows) >= ROWS or held > 4 * CHUNK:
                yield self._batch(partition, rows)
                rows, held = [], 0
        if rows:
            yield self._batch(partition, rows)


class RangedLines(DataSource):
    """Options: ``path``, ``split_bytes``, ``key`` (a field of JSON lines), ``with_value`` (false leaves the text out)."""

    @classmethod
    def name(cls) -> str:
        return "ranged_lines"

    def schema(self) -> str:
        return "path string, split long, start long, length long, key string, value string"

    def reader(self, schema) -> LinesReader:
        return LinesReader(dict(self.options))


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.table, self.columns = options["path"], options["table"], columns
        self.parts = int(options.get("partitions", 8))

    def _connected(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def _quoted(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self) -> list[Range]:
        with self._connected() as con:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self._quoted(self.table)}").fetchone()
        if low is None:
            return [Range(self.path, 0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(self.path, a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = ", ".join(map(self._quoted, self.columns))
        with self._connected() as con:
            yield from con.execute(f"SELECT {names} FROM {self._quoted(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class SqliteTable(DataSource):
    """Options: ``path``, ``table``, ``partitions``. The schema that the user gives names the columns that are read."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        raise ValueError("give a schema: only its columns are read")

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(dict(self.options), schema.fieldNames())


def register(spark: SparkSession) -> SparkSession:
    for source in (RangedLines, SqliteTable):
        spark.dataSource.register(source)
    return spark


def sqlite_rows(spark: SparkSession, path: str, table: str, schema: str, partitions: int = 8, key: str | None = None) -> DataFrame:
    """A table by ranges of row ids; missing numbers are 0, and ``key`` is text."""
    rows = register(spark).read.format("sqlite_table").schema(schema).options(path=path, table=table, partitions=partitions).load()
    numbers = [c for c, k in rows.dtypes if k in ("int", "bigint", "double", "float", "smallint", "tinyint")]
    rows = rows.fillna(0, numbers)
    return rows if key is None else rows.withColumn(key, F.col(key).cast("string"))


def lines(spark: SparkSession, path: str, split_bytes: int = SPLIT, key: str | None = None, with_value: bool = True) -> DataFrame:
    """(path, split, start, length, key, value) of all lines of a file or folder."""
    options = {"path": path, "split_bytes": split_bytes, "with_value": str(with_value).lower()} | ({"key": key} if key else {})
    return register(spark).read.format("ranged_lines").options(**options).load()


def offset_index(spark: SparkSession, path: str, key: str, split_bytes: int = SPLIT) -> DataFrame:
    """(key, path, start, length): where the JSON line of each key is; lines without the key are left out."""
    return lines(spark, path, split_bytes, key, False).where("key is not null").select("key", "path", "start", "length")


def lookup(keys: DataFrame, index: DataFrame, uri: str = "", key: str = "key", counter=None) -> DataFrame:
    """(key, value): the lines of ``keys`` by one ranged read each; keys that the index lacks give no row.

    Reads are dealt out by path and done in the order of their offsets. ``counter`` is an accumulator of reads.
    """
    wanted = keys.select(F.col(key).cast("string").alias("key")).distinct().join(index, "key")
    placed = wanted.repartition("path", F.floor(F.col("start") / SPLIT)).sortWithinPartitions("path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            found = []
            for name, start, length in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length")), strict=True):
                if name != path:
                    path, file = name, _opened(uri)[0].open_input_file(name)
                file.seek(start)
                found.append(file.read(length).decode("utf-8", "replace"))
                if counter is not None:
                    counter.add(1)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.string())], names=["key", "value"])

    return placed.select("key", "path", "start", "length").mapInArrow(read, "key string, value string")


def numbered_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """(ordinal from 0, path, start, value): all lines in the order of a plain read of the files by name.

    Lines are counted by split first; the driver adds up one number for each split, and within a split the lines are
    numbered by their offsets.
    """
    counts = lines(spark, path, split_bytes, with_value=False).groupBy("path", "split").count().orderBy("path", "split").collect()
    before, rows = 0, []
    for r in counts:
        rows.append((r["path"], r["split"], before))
        before += r["count"]
    offsets = spark.createDataFrame(rows, "path string, split long, before long")
    own = F.row_number().over(Window.partitionBy("path", "split").orderBy("start")) - 1
    return lines(spark, path, split_bytes).join(F.broadcast(offsets), ["path", "split"]).select((F.col("before") + own).alias("ordinal"), "path", "start", "value")


def first_seen(numbered: DataFrame, key) -> DataFrame:
    """(key, first): keys with the ordinal of their first line; the rank of ``first`` is the order of appearance."""
    return numbered.groupBy(key.alias("key")).agg(F.min("ordinal").alias("first"))
