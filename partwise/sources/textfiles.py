"""Spark data sources for LIBSVM text and for run logs.

``spark.read.format("partwise_libsvm").load(path)`` reads files in parallel byte ranges and numbers the lines in
file order; ``df.write.format("partwise_libsvm").mode("append").save(path)`` writes one file per task. The same for
``partwise_logs``, where a row (file, text) is one log. Paths may be local or any that Arrow's file systems open;
on a cluster they must lie where all executors see them. Written files appear when the whole job has succeeded.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
BATCH_LINES = 8192


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), posixpath.abspath(path))


def files_under(path: str, accepts) -> list:
    """Files in ascending order of their names; the path may be one file."""
    from pyarrow.fs import FileSelector, FileType

    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == FileType.File:
        return [info]
    if info.type == FileType.NotFound:
        raise FileNotFoundError(f"{path} does not exist")
    found = system.get_file_info(FileSelector(inner, recursive=True))
    return sorted((f for f in found if f.type == FileType.File and accepts(f.base_name)), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    number: int
    path: str
    start: int
    stop: int

    def __init__(self, number, path, start, stop):
        super().__init__((number, path, start, stop))
        self.number, self.path, self.start, self.stop = number, path, start, stop


class RangeReader(DataSourceReader):
    """Reads lines of files; a line belongs to the range that its first byte lies in."""

    def __init__(self, options, accepts, whole: bool):
        self.path = options["path"]
        self.accepts, self.whole = accepts, whole
        self.size = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        out = []
        for number, f in enumerate(files_under(self.path, self.accepts)):
            step = max(f.size, 1) if self.whole else self.size
            out += [Range(number, f.path, at, min(at + step, f.size)) for at in range(0, max(f.size, 1), step)]
        return out or [Range(0, "", 0, 0)]

    def lines(self, part: Range):
        """(place of the line in the file, its bytes without the line end)."""
        if not part.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(part.path) as raw:
            at = part.start
            if at:
                raw.seek(at - 1)
                if raw.read(1) != b"\n":
                    at += len(_until_line_end(raw))
            rest = b""
            while at < part.stop or rest:
                raw.seek(at + len(rest))
                more = raw.read(1 << 20)
                rest += more
                cut = rest.rfind(b"\n") + 1
                if not more and not cut:
                    if rest and at < part.stop:
                        yield at, rest
                    return
                for line in rest[:cut].split(b"\n")[:-1]:
                    if at >= part.stop:
                        return
                    yield at, line.removesuffix(b"\r")
                    at += len(line) + 1
                rest = rest[cut:]


def _until_line_end(raw) -> bytes:
    out = b""
    while True:
        more = raw.read(1 << 16)
        cut = more.find(b"\n")
        if cut >= 0 or not more:
            return out + (more[:cut + 1] if cut >= 0 else more)
        out += more


class FileWriter(DataSourceArrowWriter):
    """One file per task below a staging folder; the commit moves them, an abort removes the folder."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"]
        self.staging = f"_staging-{uuid.uuid4().hex}"
        if overwrite:
            raise ValueError("write with mode('append') into a new folder")

    def commit(self, messages):
        system, inner = opened(self.path)
        system.create_dir(inner, recursive=True)
        for m in messages:
            for name in (m.names if m is not None else ()):
                system.move(posixpath.join(inner, self.staging, name), posixpath.join(inner, name.partition("/")[2]))
        self.abort(messages)

    def abort(self, messages):
        from pyarrow.fs import FileType

        system, inner = opened(self.path)
        folder = posixpath.join(inner, self.staging)
        if system.get_file_info(folder).type != FileType.NotFound:
            system.delete_dir(folder)

    def target(self):
        """(file system, folder, prefix) of one attempt of one task."""
        from pyspark import TaskContext

        system, inner = opened(self.path)
        task = TaskContext.get()
        prefix = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        folder = posixpath.join(inner, self.staging, prefix)
        system.create_dir(folder, recursive=True)
        return system, folder, prefix


@dataclass
class Written(WriterCommitMessage):
    names: tuple


def parse_line(line: str):
    """(label, [(index, value)]) of a LIBSVM line, None for a blank one; comments and qid entries are left out."""
    parts = line.partition("#")[0].split()
    if not parts:
        return None
    pairs = [p.split(":") for p in parts[1:] if not p.startswith("qid:")]
    return float(parts[0]), [(int(i), float(v)) for i, v in pairs]


class LibsvmReader(RangeReader):
    def read(self, partition):
        import pyarrow as pa

        schema = pa.schema([("file", pa.int32()), ("line", pa.int64()), ("label", pa.float64()), ("idx", pa.list_(pa.int32())), ("val", pa.list_(pa.float64()))])
        held = []

        def batch():
            columns = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for at, raw in self.lines(partition):
            row = parse_line(raw.decode())
            if row is not None:
                held.append((partition.number, at, row[0], [i for i, _ in row[1]], [v for _, v in row[1]]))
            if len(held) == BATCH_LINES:
                yield batch()
                held = []
        if held:
            yield batch()


class LibsvmWriter(FileWriter):
    def write(self, iterator):
        system, folder, prefix = self.target()
        name = f"{prefix}/part-{prefix}.txt"
        with system.open_output_stream(posixpath.join(folder, f"part-{prefix}.txt")) as out:
            for batch in iterator:
                for label, idx, val in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("label", "idx", "val")), strict=True):
                    pairs = "".join(f" {i + 1}:{v!r}" for i, v in zip(idx, val, strict=True))
                    out.write(f"{label!r}{pairs}\n".encode())
        return Written((name,))


class LibsvmSource(DataSource):
    """Rows (file, line, label, idx, val): line is the place of the line in its file, so (file, line) gives the order;
    indices are as they stand. Written are label and the 1-based entries of idx and val."""

    @classmethod
    def name(cls):
        return "partwise_libsvm"

    def schema(self):
        return "file int, line bigint, label double, idx array<int>, val array<double>"

    def reader(self, schema):
        return LibsvmReader(self.options, lambda name: not name.startswith(("_", ".")), False)

    def writer(self, schema, overwrite):
        return LibsvmWriter(self.options, overwrite)


class LogReader(RangeReader):
    def read(self, partition):
        import pyarrow as pa

        name, number, held = posixpath.basename(partition.path), 0, []
        for _, raw in self.lines(partition):
            held.append((name, number, raw.decode()))
            number += 1
            if len(held) == BATCH_LINES:
                yield pa.RecordBatch.from_arrays([pa.array(c) if k != 1 else pa.array(c, pa.int32()) for k, c in enumerate(zip(*held, strict=True))], names=["file", "line_no", "text"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) if k != 1 else pa.array(c, pa.int32()) for k, c in enumerate(zip(*held, strict=True))], names=["file", "line_no", "text"])


class LogWriter(FileWriter):
    def write(self, iterator):
        system, folder, prefix = self.target()
        names = []
        for batch in iterator:
            for name, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("file", "text")), strict=True):
                with system.open_output_stream(posixpath.join(folder, posixpath.basename(name))) as out:
                    out.write(text.encode())
                names.append(f"{prefix}/{posixpath.basename(name)}")
        return Written(tuple(names))


class LogSource(DataSource):
    """Read: (file, line_no, text) of the log_*.log files of a folder, a log by one task, line by line. Written: one
    file for each row (file, text)."""

    @classmethod
    def name(cls):
        return "partwise_logs"

    def schema(self):
        return "file string, line_no int, text string"

    def reader(self, schema):
        return LogReader(self.options, lambda name: name.startswith("log_") and name.endswith(".log"), True)

    def writer(self, schema, overwrite):
        return LogWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(LibsvmSource)
    spark.dataSource.register(LogSource)
    return spark
