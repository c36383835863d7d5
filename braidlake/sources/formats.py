"""Spark data sources `gaf` and `gfa`: lines of text files by byte ranges, with filters that are applied as lines are read,
and an ordered writer whose parts are seen only when all of them are there.

    formats.register(spark)
    spark.read.format("gfa").load("/data/graph.gfa.gz").where("kind = 'S'")
    lines.orderBy("line_no").select("value").write.format("gaf").option("compression", "gzip").mode("append").save("/data/reads")
    formats.assemble(spark, "/data/reads", "/data/reads.gaf.gz")

Folders are read and written by tasks themselves, through pyarrow's file systems, so paths are those that all executors see.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from braidlake.sources import members

#: Bytes of a file, as it is stored, for one task; option splitBytes.
SPLIT = 128 << 20
#: Lines of one batch, and the bytes after which a batch ends earlier.
ROWS, BATCH_BYTES = 10_000, 16 << 20
SCHEMA = "file string, split long, at long, kind string, name string, value string"
MANIFEST = "_SUCCESS"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it, for tasks, which have no Java."""
    if "://" not in path:
        path = os.path.abspath(path.removeprefix("file:"))
    if path.startswith("s3a://"):  # Hadoop's name of it
        path = path.replace("s3a://", "s3://", 1)
    return pafs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    """The files of a path with their sizes, in the order of their names; those of _ and . are not part of a folder."""
    fs, inner = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = [x for x in fs.get_file_info(pafs.FileSelector(inner)) if x.type == pafs.FileType.File and not x.base_name.startswith(("_", "."))]
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found)


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int
    gzip: bool


def gfa_parts(line: bytes) -> tuple[bytes, bytes]:
    """The record type of a line and what comes next, mostly its name."""
    kind, _, rest = line.partition(b"\t")
    return kind, rest.partition(b"\t")[0]


def gaf_parts(line: bytes) -> tuple[bytes, bytes]:
    """`@` and the record type for header lines, else `r` and the name of the read."""
    name = line.partition(b"\t")[0]
    return (b"@", name[1:]) if line.startswith(b"@") else (b"r", name)


class Reader(DataSourceReader):
    def __init__(self, options, parts):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.files = [f for p in paths for f in _files(p)]
        self.split = int(options.get("splitbytes", SPLIT))
        self.parts, self.tests = parts, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("kind", "name") and isinstance(f, (EqualTo, In, StringStartsWith)):
                values = tuple(f.value) if isinstance(f, In) else (f.value,)
                exact = not isinstance(f, StringStartsWith)
                self.tests.append((column == "name", exact, frozenset(v.encode() for v in values) if exact else tuple(v.encode() for v in values)))
            elif not isinstance(f, IsNotNull):  # no column is ever null
                yield f

    def partitions(self):
        out = []
        for path, size in self.files:
            fs, inner = file_system(path)
            with fs.open_input_file(inner) as f:
                zipped = f.read(2) == members.GZIP
            out += [Split(path, at, min(at + self.split, size), zipped) for at in range(0, size, self.split)]
        return out or [Split("", 0, 0, False)]

    def _kept(self, kind: bytes, name: bytes) -> bool:
        for of_name, exact, values in self.tests:
            x = name if of_name else kind
            if not (x in values if exact else x.startswith(values)):
                return False
        return True

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, inner = file_system(partition.file)
        with fs.open_input_file(inner) as f:
            blocks = (members.gzip_blocks if partition.gzip else members.plain_blocks)(f, partition.start, partition.end)
            rows, size, at = [], 0, -1
            for some in members.lines(blocks, partition.start == 0):
                for line in some:
                    at += 1
                    line = line.removesuffix(b"\r")
                    kind, name = self.parts(line)
                    if self._kept(kind, name):
                        rows.append((at, kind, name, line))
                        size += len(line)
                    if len(rows) >= ROWS or size >= BATCH_BYTES:
                        yield self._batch(partition, rows)
                        rows, size = [], 0
            if rows:
                yield self._batch(partition, rows)

    @staticmethod
    def _batch(partition: Split, rows: list[tuple]) -> pa.RecordBatch:
        at, *texts = zip(*rows, strict=True)
        n = len(rows)
        columns = [pa.array([partition.file] * n), pa.array([partition.start] * n, pa.int64()), pa.array(at, pa.int64())]
        columns += [pa.array([t.decode("utf-8", "replace") for t in x], pa.string()) for x in texts]
        return pa.RecordBatch.from_arrays(columns, ["file", "split", "at", "kind", "name", "value"])


@dataclass
class Part(WriterCommitMessage):
    number: int
    file: str
    size: int
    lines: int


class Writer(DataSourceArrowWriter):
    """Each attempt of a task writes a file of its own in a hidden folder; the commit moves one a task to its name in order
    and then writes what there is to the manifest, so a lost or repeated task leaves nothing behind that is read."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "none") == "gzip"
        self.hidden = f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, inner = file_system(self.path)
        folder = f"{inner}/{self.hidden}"
        fs.create_dir(folder, recursive=True)
        file = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        size = n = 0
        waiting = bytearray()
        with fs.open_output_stream(file) as out:
            for batch in iterator:
                for value in batch.column(batch.schema.get_field_index("value")):
                    waiting += (value.as_py() or "").encode() + b"\n"
                    n += 1
                    if len(waiting) >= members.BLOCK:
                        size += self._put(out, waiting, members.MEMBER)
            size += self._put(out, waiting, 1)
        return Part(context.partitionId(), file, size, n)

    def _put(self, out, waiting: bytearray, least: int) -> int:
        """Writes what waits, if zipped in members of a fixed size, and leaves less than `least`."""
        size = 0
        while len(waiting) >= least:
            some = bytes(waiting[: members.MEMBER] if self.gzip else waiting)
            del waiting[: len(some)]
            data = members.member(some) if self.gzip else some
            out.write(data)
            size += len(data)
        return size

    def commit(self, messages: list[Part]) -> None:
        fs, inner = file_system(self.path)
        fs.create_dir(inner, recursive=True)
        old = [f for f, _ in _files(self.path)]
        if old and not self.overwrite:
            raise FileExistsError(f"{self.path} has files; a sorted text is not added to")
        fs, _ = file_system(self.path)
        for f in [*old, f"{inner}/{MANIFEST}"]:
            name = file_system(f)[1]
            if fs.get_file_info(name).type != pafs.FileType.NotFound:
                fs.delete_file(name)
        parts = []
        for i, m in enumerate(sorted((m for m in messages if m and m.size), key=lambda m: m.number)):
            name = f"part-{i:09d}" + (".gz" if self.gzip else "")
            fs.move(m.file, f"{inner}/{name}")
            parts.append({"name": name, "size": m.size, "lines": m.lines})
        with fs.open_output_stream(f"{inner}/{MANIFEST}") as out:
            out.write(json.dumps({"gzip": self.gzip, "parts": parts}).encode())
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, inner = file_system(self.path)
        if fs.get_file_info(f"{inner}/{self.hidden}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{inner}/{self.hidden}")


class GfaSource(DataSource):
    PARTS = staticmethod(gfa_parts)

    @classmethod
    def name(cls) -> str:
        return "gfa"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options, self.PARTS)

    def writer(self, schema, overwrite: bool) -> Writer:
        if "value" not in schema.names:
            raise ValueError("lines to write are in a column value")
        return Writer(self.options, overwrite)


class GafSource(GfaSource):
    PARTS = staticmethod(gaf_parts)

    @classmethod
    def name(cls) -> str:
        return "gaf"


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, and lets it push filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GfaSource)
    spark.dataSource.register(GafSource)


def assemble(spark: SparkSession, folder: str, target: str) -> int:
    """One file of the parts of a folder that was written here; returns its bytes. Each part is copied to its place by a task
    of its own, so a repeated task writes the same bytes again. Needs a file system with writes at any place (a local or a
    mounted one); elsewhere the folder is the document."""
    fs, inner = file_system(folder)
    if not isinstance(fs, pafs.LocalFileSystem) or not isinstance(file_system(target)[0], pafs.LocalFileSystem):
        raise ValueError("one file can only be made on a mounted file system; read the folder's parts in the order of their names")
    with fs.open_input_stream(f"{inner}/{MANIFEST}") as f:
        manifest = json.loads(f.read())
    places, at = [], 0
    for p in manifest["parts"]:
        places.append((f"{inner}/{p['name']}", at))
        at += p["size"]
    last = members.member(b"") if manifest["gzip"] else b""  # the empty member that ends such a file
    final = file_system(target)[1]
    made = f"{os.path.dirname(final)}/.{os.path.basename(final)}-{uuid.uuid4().hex}"
    with open(made, "wb") as out:
        out.truncate(at + len(last))
        out.seek(at)
        out.write(last)

    def copy(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with open(row["file"], "rb") as part, open(made, "r+b") as out:
                    out.seek(row["place"])
                    n = 0
                    while data := part.read(members.BLOCK):
                        out.write(data)
                        n += len(data)
                yield pa.RecordBatch.from_pydict({"n": [n]})

    copied = 0
    if places:
        parts = spark.createDataFrame(places, "file string, place long").repartition(len(places), "place")
        copied = parts.mapInArrow(copy, "n long").groupBy().sum("n").first()[0]
    if copied != at:
        raise OSError(f"{copied} of {at} bytes were copied from {folder}")
    os.replace(made, final)
    return at + len(last)
