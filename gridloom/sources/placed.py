"""One file written by many tasks: every row says where in the file its bytes go.

Tasks write into a file beside the target, which takes the target's name when all of them are done (and all bytes are
there) and is deleted if one fails, so that a target is never half written. A task that runs again writes the same bytes
to the same places. File systems that only append get one part a task instead, which are joined in order at the end: by
the name node where the file system can do that, else by a copy in the driver's JVM.
"""

from __future__ import annotations

import contextlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Neighbouring rows are written together up to so many bytes.
CHUNK = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    bytes: int


def runs(batches: Iterator[pa.RecordBatch], chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) with rows that follow one another put together."""
    start, held, size = 0, [], 0
    for batch in batches:
        for place, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_buffer()
            if held and (place != start + size or size >= chunk):
                yield start, b"".join(held)
                held, size = [], 0
            if not held:
                start = place
            held.append(data)
            size += len(data)
    if held:
        yield start, b"".join(held)


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.target, self.staging, self.size = options["path"], options["staging"], int(options["size"])
        self.appends = options.get("appends") == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return Written(self._parts(iterator) if self.appends else self._places(iterator))

    def _places(self, batches: Iterator[pa.RecordBatch]) -> int:
        total, out = 0, os.open(self.staging, os.O_WRONLY | os.O_CREAT, 0o666)
        try:
            for place, data in runs(batches):
                view, at = memoryview(data), place
                while view:
                    n = os.pwrite(out, view, at)
                    view, at = view[n:], at + n
                total += len(data)
        finally:
            os.close(out)
        return total

    def _parts(self, batches: Iterator[pa.RecordBatch]) -> int:
        from pyarrow.fs import FileSystem

        files, folder = FileSystem.from_uri(self.staging)
        files.create_dir(folder, recursive=True)
        total, end, out = 0, -1, None
        try:
            for place, data in runs(batches):
                if place != end or out is None:
                    if out:
                        out.close()
                    out = files.open_output_stream(f"{folder}/part-{place:020d}")
                out.write(data)
                total, end = total + len(data), place + len(data)
        finally:
            if out:
                out.close()
        return total

    def commit(self, messages: list[Written | None]) -> None:
        total = sum(m.bytes for m in messages if m)
        if total != self.size:
            self.abort(messages)
            raise OSError(f"{self.target}: {total} bytes written, {self.size} expected")
        if not self.appends:
            if not self.size:
                open(self.staging, "wb").close()
            os.replace(self.staging, self.target)

    def abort(self, messages: list[Written | None]) -> None:
        if not self.appends:
            with contextlib.suppress(FileNotFoundError):
                os.remove(self.staging)


class PlacedFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "placedfile"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PlacedWriter(self.options)


def write_placed(rows: DataFrame, path: str, size: int, appends: bool | None = None) -> None:
    """rows: place (long), data (binary), which fill the bytes 0 to size of the file at path without gaps.

    appends: the file system cannot be written at places; None: that is so for all but local (and mounted) paths.
    """
    spark = rows.sparkSession
    spark.dataSource.register(PlacedFile)
    if appends is None:
        appends = "://" in path and not path.startswith("file:")
    target = path if appends or not path.startswith("file:") else "/" + path.removeprefix("file:").lstrip("/")
    staging = f"{target}.parts-{uuid.uuid4().hex}"
    options = {"path": target, "staging": staging, "size": str(size), "appends": str(appends).lower()}
    writer = rows.select("place", "data").write.format("placedfile").mode("append").options(**options)
    if not appends:
        writer.save()
        return
    try:
        writer.save()
        _join(spark, staging, target)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(staging)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _join(spark: SparkSession, staging: str, target: str) -> None:
    """Parts in order of their places become the target."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    to, folder = hadoop.fs.Path(target), hadoop.fs.Path(staging)
    files = to.getFileSystem(conf)
    names = sorted(f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    parts = [hadoop.fs.Path(folder, n) for n in names]
    joined = hadoop.fs.Path(folder, "joined")
    files.create(joined, True).close()
    rest = spark.sparkContext._gateway.new_array(hadoop.fs.Path, len(parts))
    for k, part in enumerate(parts):
        rest[k] = part
    try:
        if parts:
            files.concat(joined, rest)
    except (CapturedException, Py4JJavaError):  # it has no such operation
        out = files.create(joined, True)
        try:
            for part in parts:
                source = files.open(part)
                hadoop.io.IOUtils.copyBytes(source, out, CHUNK, False)
                source.close()
        finally:
            out.close()
    if files.exists(to):
        files.delete(to, True)
    if not files.rename(joined, to):
        raise OSError(f"{target} could not take the place of its parts")
