"""Text sources and sinks: alignment lines with headers, graphs as GFA, and what kind of thing a path is."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlake.functions import gaf
from braidlake.operators._shared import ensure_checkpoint, numbered
from braidlake.schema import Graph, encode, node_of
from braidlake.sources import formats
from braidlake.sources.members import GZIP


def _file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system, so that any store that Spark reads can be asked."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark._jsc.hadoopConfiguration())


def file_head(spark: SparkSession, path: str, n: int = 64) -> bytes:
    hpath, fs = _file_system(spark, path)
    stream = fs.open(hpath)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path, folder or pattern that Spark would read as text."""
    hpath, fs = _file_system(spark, path)
    found, out = fs.globStatus(hpath) or [], []
    for status in found:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [str(x.getPath().toString()) for x in inside if x.isFile() and not x.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def _from_stdin(spark: SparkSession) -> str:
    """Spools standard input to the shared folder."""
    ensure_checkpoint(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stdin-{uuid.uuid4().hex[:12]}"
    hpath, fs = _file_system(spark, path)
    out = fs.create(hpath)
    for block in iter(lambda: sys.stdin.buffer.read(1 << 20), b""):
        out.write(block)
    out.close()
    return path


def _unzipped(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines of gzip files whatever they are called, by ranges: a task reads the members that begin in its range."""
    formats.register(spark)
    return spark.read.format("gaf").load(files).select("value", F.col("file").alias("f"), F.col("split").alias("b"), F.col("at").alias("m"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): lines numbered from 0 in file order, files in the order of their names.

    `-` is standard input. Gzip is known by its first bytes, whatever the file's name, and its members are read by several
    tasks. Lines get their place in their file's split first, then splits are added up, so no sort of all lines is needed.
    """
    path = _from_stdin(spark) if path == "-" else path
    files = _files(spark, path)
    zipped = [f for f in files if file_head(spark, f, 2) == GZIP]
    plain = [f for f in files if f not in zipped] or ([] if zipped else [path])
    raw = None
    if plain:
        raw = spark.read.text(plain).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    if zipped:
        more = _unzipped(spark, zipped)
        raw = raw.unionByName(more) if raw is not None else more
    counts = raw.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("m").alias("m0"))
    before = Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each split
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(counts.select("f", "b", "m0", "base"), ["f", "b"]).select((F.col("base") + F.col("m") - F.col("m0")).alias("line_no"), "value")


def headers(lines: DataFrame) -> DataFrame:
    """The run of lines at the start that begin with @."""
    first = lines.where(~F.col("value").startswith("@")).agg(F.coalesce(F.min("line_no"), F.lit((1 << 62))).alias("first"))
    return lines.where(F.col("value").startswith("@")).join(F.broadcast(first), F.col("line_no") < F.col("first")).select("line_no", "value")


def records(lines: DataFrame) -> DataFrame:
    """Lines that are records, numbered from 0: headers are left out wherever they are."""
    data = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
    return data.select(F.col("line_no").alias("aln_id"), "value")


def read_gaf(spark: SparkSession, path: str, on_error: str = "raise") -> DataFrame:
    """Alignment records of a text file, plain or gzip. on_error: raise, drop, or keep with what is wrong in `error`.

    A line that is wrong raises whatever is read of the records, if only their number.
    """
    parsed = gaf.parse_lines(records(read_lines(spark, path)))
    if on_error == "raise":
        message = F.concat(F.lit("line "), F.col("aln_id").cast("string"), F.lit(": "), F.col("error"))
        good = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
        return gaf.evaluated(parsed, __good=good).where("__good").drop("__good", "error")
    return parsed.where("error is null").drop("error") if on_error == "drop" else parsed


def write_gaf(lines: DataFrame, path: str, header_lines: list[str] = (), single_file: bool = False) -> None:
    """(line_no, line) as text, after the version header and others.

    The part files, in the order of their names, are the sorted text. single_file makes path one file, put together from
    parts that several tasks wrote, and zipped in members if its name ends in .gz.
    """
    spark = lines.sparkSession
    head = spark.createDataFrame([(i - 1_000_000, h) for i, h in enumerate(["@HD\tVN:Z:1.0", *header_lines])], "line_no long, line string")
    ordered = head.unionByName(lines.select(F.col("line_no").cast("long").alias("line_no"), "line")).orderBy("line_no").select(F.col("line").alias("value"))
    write_document(ordered, path) if single_file else ordered.write.text(path)


def write_document(ordered: DataFrame, path: str) -> int:
    """One file of the lines (value) in the order that they are in; returns its bytes. Its parts go to path.parts, which stays."""
    formats.register(ordered.sparkSession)
    ordered.select("value").write.format("gaf").option("compression", "gzip" if path.endswith(".gz") else "none").mode("append").save(f"{path}.parts")
    return formats.assemble(ordered.sparkSession, f"{path}.parts", path)


def read_gfa(spark: SparkSession, path: str) -> Graph:
    """A graph from S, L, W and P lines; node names must be numbers. Paths of P lines are generic."""
    lines = read_lines(spark, path).withColumn("p", F.split("value", "\t", -1))
    get = lambda i: F.get("p", F.lit(i))
    nodes = lines.where(get(0) == "S").select(get(1).try_cast("long").alias("node_id"), get(2).alias("sequence"), F.length(get(2)).cast("long").alias("seq_len"))
    end = lambda i: encode(get(i).try_cast("long"), (get(i + 1) == "-").cast("long"))
    edges = lines.where(get(0) == "L").select(end(1).alias("src"), end(3).alias("dst"))
    edges = edges.unionByName(edges.select(F.col("dst").bitwiseXOR(F.lit(1)).alias("src"), F.col("src").bitwiseXOR(F.lit(1)).alias("dst"))).distinct()
    signs = F.transform(F.split(get(2), ","), lambda s: F.rtrim(F.regexp_replace(s, "[+-]$", "")).try_cast("long") * 2 + F.when(s.endswith("-"), 1).otherwise(0))
    named, zero = get(0) == "W", F.lit(0).cast("long")
    both = lines.where(get(0).isin("W", "P")).select(
        "line_no", F.when(named, get(1)).otherwise("_gbwt_ref").alias("sample"), F.when(named, get(3)).otherwise(get(1)).alias("contig"), F.when(named, get(2).try_cast("long")).otherwise(zero).alias("haplotype"),
        F.when(named, F.coalesce(get(4).try_cast("long"), zero)).otherwise(zero).alias("fragment"), F.when(named, gaf.parse_path(get(6))).otherwise(signs).alias("walk"))
    both = numbered(both.orderBy("line_no"), "path_handle")  # written: what follows does not read the text again
    steps = both.select("path_handle", F.posexplode("walk").alias("step", "handle")).withColumn("step", F.col("step").cast("long"))
    from braidlake.operators.locate import STEPS_AT_ONCE, step_offsets

    longest = both.agg(F.max(F.size("walk")).alias("n")).first().n or 0
    offsets = step_offsets(steps, nodes, short=longest <= STEPS_AT_ONCE)
    lengths = steps.select("path_handle", node_of(F.col("handle")).alias("node_id")).join(nodes, "node_id").groupBy("path_handle").agg(F.sum("seq_len").cast("long").alias("path_len"))
    paths = both.join(lengths, "path_handle").select("path_handle", "sample", "contig", "haplotype", "fragment", (F.col("sample") == "_gbwt_ref").alias("is_indexed"), "path_len")
    empty = spark.createDataFrame([], "handle long, next long")
    tags = spark.createDataFrame([], "key string, value string")
    return Graph(nodes, edges, offsets, paths, empty, tags)


def identify_source(path: str, spark: SparkSession | None = None) -> str:
    """missing, not a file, gfa, gaf, gzip, store:<version> or unknown. With a session, for any path that Spark reads."""
    from braidlake.sources.store import stored_version

    if spark is None:
        local = path.removeprefix("file://")
        exists, folder = os.path.exists(local), os.path.isdir(local)
    else:
        hpath, fs = _file_system(spark, path)
        exists = fs.exists(hpath)
        folder = exists and fs.getFileStatus(hpath).isDirectory()
    if not exists:
        return "missing"
    if folder:
        version = stored_version(path if spark else local, spark)
        return f"store:{version}" if version else "not a file"
    if spark is None:
        with open(local, "rb") as f:
            head = f.read(64)
    else:
        head = file_head(spark, path)
    if head[:2] == GZIP:
        return "gzip"
    if head[:2] in (b"H\t", b"S\t"):
        return "gfa"
    return "gaf" if head[:1] == b"@" or head.count(b"\t") >= 4 else "unknown"
