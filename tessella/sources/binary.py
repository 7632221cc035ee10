"""The data source series_bin: headerless row-major files of 32-bit little-endian floats (or 64-bit whole numbers).

    spark.dataSource.register(SeriesBinary)
    spark.read.format("series_bin").option("path", p).option("length", 256).load()      -> series_id, values
    df.write.format("series_bin").option("path", p).option("length", 256).save()        <- series_id, values

path is a file, or a folder of files in name order, in any file system that pyarrow opens. Partitions are runs of
records, so no task reads more than rows_per_partition of them. Options: first, rows (a chunk of the collection),
strict (fail if fewer than rows are there). A file whose size isn't a multiple of a record is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import kernels


def _opened(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


def _files(path: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = system.get_file_info(fs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


class Run(InputPartition):
    def __init__(self, path: str, file: str, first: int, rows: int, number: int):
        self.path, self.file, self.first, self.rows, self.number = path, file, first, rows, number


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.length = options["path"], int(options.get("length", 256))
        self.per = int(options.get("rows_per_partition", 1 << 17))
        self.skip, self.limit = int(options.get("first", 0)), int(options["rows"]) if "rows" in options else None
        self.strict = options.get("strict", "false").lower() == "true"

    def partitions(self) -> list[Run]:
        record, number, out = 4 * self.length, 0, []
        end = self.skip + self.limit if self.limit is not None else None
        for file, size in _files(self.path):
            if size % record:
                raise ValueError(f"{file} doesn't hold whole records of {self.length} values")
            n = size // record
            low, high = max(self.skip, number), number + n if end is None else min(end, number + n)
            for at in range(low, high, self.per):
                out.append(Run(self.path, file, at - number, min(self.per, high - at), at))
            number += n
        if self.strict and self.limit is not None and sum(r.rows for r in out) < self.limit:
            raise ValueError(f"{self.path} holds fewer than {self.skip + self.limit} records")
        return out or [Run(self.path, "", 0, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if not run.rows:
            return
        system, _ = _opened(run.path)
        with system.open_input_file(run.file) as f:
            f.seek(run.first * 4 * self.length)
            for at in range(0, run.rows, 4096):
                rows = min(4096, run.rows - at)
                values = np.frombuffer(f.read(rows * 4 * self.length), "<f4").reshape(rows, self.length)
                ids = np.arange(run.number + at, run.number + at + rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), kernels.lists(values)], ["series_id", "values"])


class Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class Writer(DataSourceArrowWriter):
    """One file a task, named by its smallest id, so that a folder written in ranges reads back in order."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.length, self.overwrite = options["path"], int(options.get("length", 256)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, at = _opened(self.path)
        system.create_dir(at, recursive=True)
        file, out = None, None
        for batch in iterator:
            if not batch.num_rows:
                continue
            ids, values = batch.column(0).to_numpy(), kernels.matrix(batch.column(1), self.length, np.float32)
            if values.shape[1] != self.length:
                raise ValueError(f"series must have {self.length} values")
            if out is None:
                task = TaskContext.get()
                file = f"{at}/.part-{int(ids[0]):020d}-{task.taskAttemptId() if task else 0}"
                out = system.open_output_stream(file)
            out.write(values.astype("<f4").tobytes())
        if out is not None:
            out.close()
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _opened(self.path)
        new = [m.file for m in messages if m and m.file]
        if self.overwrite:
            for file, _ in _files(self.path):
                system.delete_file(file)
        for file in new:
            folder, _, name = file.rpartition("/")
            system.move(file, f"{folder}/{name[1:].rpartition('-')[0]}.bin")

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _opened(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(m.file)


class SeriesBinary(DataSource):
    @classmethod
    def name(cls) -> str:
        return "series_bin"

    def schema(self) -> str:
        return "series_id long, values array<float>"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def qualified(spark, path: str) -> str:
    """The path in the file system where Spark itself would look for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and not found.startswith("file://") else found


def register(spark) -> None:
    spark.dataSource.register(SeriesBinary)


def read_series(spark, path: str, length: int, **options):
    register(spark)
    reader = spark.read.format("series_bin").option("path", qualified(spark, path)).option("length", length)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def write_series(series, path: str, length: int, parts: int | None = None) -> None:
    """Files in id order: ids are dealt by ranges and sorted within."""
    register(series.sparkSession)
    rows = series.select("series_id", series["values"].cast("array<float>").alias("values"))
    rows = (rows.repartitionByRange(parts, "series_id") if parts else rows.repartitionByRange("series_id")).sortWithinPartitions("series_id")
    rows.write.format("series_bin").mode("append").option("path", qualified(series.sparkSession, path)).option("length", length).save()
