"""What the operators of this subpackage share: shared work folders, Arrow kernels, cleaning up."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark deletes what a query shuffled when that query ends, instead of whenever the driver next collects garbage.
#: Rows go to Python in small batches, as they may hold whole texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. A local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="braidlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Narrow rows that make a file, where their number is known.
ROWS_A_FILE = 250_000
_left_over: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove_left_over() -> None:
    for spark, path in _left_over:
        with contextlib.suppress(Exception):  # the context may have been stopped already
            remove(spark, path)


class Workspace:
    """Tables in the shared folder. Those not kept go when the block ends, kept ones when the driver's process ends; a
    failed block takes all along."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/braidlake-{name}-{uuid.uuid4().hex[:12]}"
        self.n, self.temporary, self.kept, self.named = 0, [], [], {}

    def path(self, name: str, keep: bool = False) -> str:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        (self.kept if keep else self.temporary).append(path)
        return path

    def write(self, df: DataFrame, name: str, by: str | None = None, keep: bool = False, at_once: int = 1000) -> str:
        """Writes df, in a folder for each value of `by` if given, and returns the path. at_once: rows of a batch for Python."""
        path = self.path(name, keep)
        writer = df.write.partitionBy(by) if by else df.write
        with settings(self.spark, {**WRITING, "spark.sql.maxConcurrentOutputFileWriters": "64", "spark.sql.execution.arrow.maxRecordsPerBatch": str(at_once)}):
            writer.parquet(path)
        return path

    def table(self, df: DataFrame, name: str, keep: bool = False, rows: int | None = None, at_once: int = 1000) -> DataFrame:
        """Writes df and reads it again: its lineage ends in files that outlive any executor.

        rows: about how many it has, if that is known, so that few rows don't make many files.
        """
        if rows is not None:
            df = df.coalesce(max(8, -(-rows // ROWS_A_FILE)))
        return self.spark.read.schema(df.schema).parquet(self.write(df, name, keep=keep, at_once=at_once))

    def bucketed(self, df: DataFrame, name: str, *by: str, dealt: bool = False) -> DataFrame:
        """Writes df dealt out and sorted by columns: joins on them read it as it lies, without a shuffle of this side.

        dealt: df comes out of a grouping by these columns, whose partitions are the buckets already.
        """
        path, table = self.path(name), f"braidlake_{name}_{uuid.uuid4().hex[:12]}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with settings(self.spark, WRITING):
            (df if dealt else df.repartition(n, *by)).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(table)
        self.named[path] = table
        return self.spark.table(table)

    def _forget(self, path: str) -> None:
        if path in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.named.pop(path)}")
        remove(self.spark, path)

    def drop(self, *names: str) -> None:
        for path in [p for p in self.temporary if p.rsplit("-", 1)[1] in names]:
            self._forget(path)
            self.temporary.remove(path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind, value, trace) -> None:
        for path in self.temporary + (self.kept if kind else []):
            self._forget(path)
        self.temporary = []
        if self.kept and not kind:
            _left_over.append((self.spark, self.root))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it that a Hadoop-style URI names, for Python code on executors."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(hadoop):
            uri = arrow + uri[len(hadoop) :]
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(uri)


def write_file(uri: str, blobs) -> None:
    """Writes under another name and then moves: readers and repeated attempts see whole files only."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    other = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(other, compression=None) as out:
        for blob in blobs:
            out.write(blob)
    fs.move(other, path)


def slices(batches, rows: int = 256):
    """Smaller record batches, so that what a kernel builds at once stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def give_back() -> None:
    """Returns memory that a Python worker has freed: it may live on in stages that need it elsewhere on its machine."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def share_of(column, share: float):
    """A repeatable sample: rows whose hash falls under a share of its range."""
    return F.pmod(F.xxhash64(column, F.lit(0x5EED)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
