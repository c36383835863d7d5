"""Graphs and alignments as folders of Parquet tables with a version and counts in their tags."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions import gaf
from braidlake.operators import reads as reads_ops
from braidlake.operators import visits
from braidlake.operators.locate import clusters as block_runs
from braidlake.operators.locate import reference_index
from braidlake.schema import VERSION, Graph, encode, node_of
from braidlake.sources.names import NAME, SUBGRAPHS, GraphName, require_reference

GRAPH_TABLES = ("nodes", "edges", "steps", "paths", "chain_links", "tags")
JUMPS = "handle long, offset long, next_handle long, next_offset long, level int"
GRAPH_VERSION, READS_VERSION = f"graph {VERSION}", f"alignments {VERSION}"


@dataclass(frozen=True)
class AlignmentParams:
    """How alignments are stored."""

    block_size: int = 1000
    reference_free: bool = False
    quality_strings: bool = True
    optional: bool = True
    #: Paths are kept as their first visit, in the order of all reads' visits, with a table of jumps that restores them.
    start_positions: bool = False

    def to_json(self) -> str:
        names = ("reference_free", "quality_strings", "optional", "start_positions")
        return json.dumps({"block_size": self.block_size, "fields": [n for n in names if getattr(self, n)]})

    @classmethod
    def from_json(cls, text: str) -> AlignmentParams:
        data = json.loads(text)
        return cls(data["block_size"], *[n in data["fields"] for n in ("reference_free", "quality_strings", "optional", "start_positions")])


def header_counts(graph: Graph) -> DataFrame:
    """(key, value): nodes, chains, chain_links, paths, samples, haplotypes, contigs."""
    paths = graph.paths.agg(
        F.count("*").alias("paths"), F.countDistinct("sample").alias("samples"), F.countDistinct("sample", "haplotype").alias("haplotypes"), F.countDistinct("contig").alias("contigs"))
    links = graph.chain_links.agg(F.count("*").alias("chain_links"))
    heads = graph.chain_links.select(F.col("next").alias("handle"))
    chains = graph.chain_links.join(heads, "handle", "left_anti").agg(F.floor(F.count("*") / 2).cast("long").alias("chains"))
    row = graph.nodes.agg(F.count("*").alias("nodes")).join(chains, F.lit(True)).join(links, F.lit(True)).join(paths, F.lit(True))
    names = ["nodes", "chains", "chain_links", "paths", "samples", "haplotypes", "contigs"]
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value")) for n in names])
    return row.select(F.explode(pairs).alias("x")).select("x.key", "x.value")


def oriented_nodes(graph: Graph) -> DataFrame:
    """Both orientations of each node: handle, sequence as it reads that way."""
    from braidlake.functions.seq import oriented

    rows = graph.nodes.select("node_id", "sequence", F.explode(F.array(F.lit(0), F.lit(1))).alias("rev"))
    return rows.select(encode(F.col("node_id"), F.col("rev")).alias("handle"), oriented(F.col("sequence"), F.col("rev")).alias("sequence"))


def write_graph(graph: Graph, path: str, interval: int = 1000, name: GraphName | None = None) -> None:
    """Fails if the folder exists. Paths need names; the reference index covers indexed paths. name goes into the tags.

    Tables are sorted by what queries ask for, so that they read few files and row groups; steps twice, by path and by node.
    Steps get the places of their visits, which order the walks of subgraphs.
    """
    bad = graph.paths.where("sample is null or contig is null or sample = '' or contig = ''")
    if not bad.isEmpty():
        raise ValueError("every path needs a sample and a contig")
    spark = graph.spark
    own = [("version", GRAPH_VERSION), *(name or GraphName()).tags().items()]
    tags = graph.tags.unionByName(header_counts(graph)).unionByName(spark.createDataFrame(own, "key string, value string"))
    order = {"nodes": ["node_id"], "edges": ["src", "dst"], "steps": ["path_handle", "step"], "paths": ["path_handle"], "chain_links": ["handle"]}
    for name, by in order.items():
        rows = getattr(graph, name)
        if name == "steps" and "flip_offset" not in rows.columns:
            rows = visits.with_offsets(rows)
        rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("errorifexists").parquet(f"{path}/{name}")
    steps = spark.read.parquet(f"{path}/steps")
    steps.repartitionByRange("handle", "path_handle", "step").sortWithinPartitions("handle", "path_handle", "step").write.parquet(f"{path}/steps_by_node")
    reference_index(steps, graph.paths, interval).write.parquet(f"{path}/reference_index")
    tags.coalesce(1).write.parquet(f"{path}/tags")


def _tags(spark: SparkSession, path: str, version: str) -> dict[str, str]:
    tags = {r.key: r.value for r in spark.read.parquet(f"{path}/tags").collect()}
    if tags.get("version") != version:
        raise ValueError(f"version is {tags.get('version')}, not {version}")
    return tags


def open_graph(spark: SparkSession, path: str) -> Graph:
    tags = _tags(spark, path, GRAPH_VERSION)
    for key in ("nodes", "chains", "chain_links", "paths", "samples", "haplotypes", "contigs"):
        if key not in tags:
            raise KeyError(f"Key not found: {key}")
    return Graph(*[spark.read.parquet(f"{path}/{t}") for t in (*GRAPH_TABLES, "steps_by_node")])


def graph_name(graph: Graph) -> GraphName:
    """The graph's name by its tags, empty if they have none or cannot be read."""
    return GraphName.from_tags({r.key: r.value for r in graph.tags.where(F.col("key").isin(NAME, SUBGRAPHS)).collect()})


def has_chain_links(graph: Graph) -> bool:
    return not graph.chain_links.isEmpty()


def stored_version(path: str, spark: SparkSession | None = None) -> str | None:
    if spark is not None:
        hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tags")
        if not hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
            return None
        return tag(spark.read.parquet(f"{path}/tags"), "version")
    if not os.path.isdir(f"{path}/tags"):
        return None
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{path}/tags").to_pylist()
    return next((r["value"] for r in rows if r["key"] == "version"), None)


def tag(tags: DataFrame, key: str) -> str | None:
    row = tags.where(F.col("key") == key).select("value").first()
    return row[0] if row else None


def tags_with_prefix(tags: DataFrame, prefix: str) -> DataFrame:
    """Tags whose key begins with exactly the prefix, which is taken off once."""
    return tags.where(F.col("key").startswith(prefix)).select(F.substring("key", len(prefix) + 1, 1 << 20).alias("key"), "value")


def write_alignments(
    reads: DataFrame, path: str, params: AlignmentParams | None = None, graph: Graph | None = None, tags: dict | None = None, name: GraphName | None = None
) -> None:
    """Reads in blocks, in their order, with the nodes they visit. name is that of the graph they are aligned to.

    A reference-free store needs a graph, which has to fit that name, and takes the bases of the visited nodes from it;
    otherwise a graph is not used.
    """
    params, name = params or AlignmentParams(), name or GraphName()
    if params.reference_free and graph is None:
        raise ValueError("a reference-free store needs a graph")
    if params.reference_free:
        require_reference(name, graph_name(graph))
    reads = reads_ops.blocks(reads.withColumn("is_unaligned", gaf.is_unaligned()), params.block_size).drop("is_unaligned")
    if not params.quality_strings:
        reads = reads.withColumn("base_quality", F.lit(""))
    if not params.optional:
        reads = reads.withColumn("optional", F.array().cast(gaf.FIELD))
    spark = reads.sparkSession
    levels = 0
    if params.start_positions:
        reads, levels = _as_positions(reads, path)
    reads.repartitionByRange("block_id").sortWithinPartitions("block_id", "aln_id").write.mode("errorifexists").parquet(f"{path}/alignments")
    stored = spark.read.parquet(f"{path}/alignments")
    if params.start_positions:
        stored = _with_paths(stored, spark.read.schema(JUMPS).parquet(f"{path}/jumps"), levels)
    reads_ops.block_summary(stored).write.parquet(f"{path}/blocks")
    steps = stored.select("block_id", F.explode("path").alias("handle")).select("block_id", node_of(F.col("handle")).alias("node_id"))
    bitmaps = reads_ops.node_bitmaps(steps, "block_id").repartitionByRange("bucket", "block_id").sortWithinPartitions("bucket", "block_id")
    bitmaps.write.parquet(f"{path}/block_bitmaps")
    visited = steps.select("node_id").distinct()
    if params.reference_free:
        visited = visited.join(graph.nodes, "node_id", "left")
    visited.write.parquet(f"{path}/nodes")
    counts = {"version": READS_VERSION, "alignments": str(stored.count()), "nodes": str(spark.read.parquet(f"{path}/nodes").count()), "bidirectional_gbwt": "0", "params": params.to_json(), "levels": str(levels), "bitmaps": "1", **name.tags(), **(tags or {})}
    spark.createDataFrame(sorted(counts.items()), "key string, value string").coalesce(1).write.parquet(f"{path}/tags")


def _as_positions(reads: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Reads with the (start_handle, start_offset) of their paths instead of these, and the number of levels of the jumps
    that are written beside them, sorted by what a restored path asks for."""
    found = visits.visit_offsets(reads_ops.path_steps(reads).select(F.col("aln_id").alias("seq"), F.col("pos").alias("idx"), "handle"))
    levels = visits.levels_of(found)
    rows = visits.jumps(found).repartitionByRange("level", "handle", "offset").sortWithinPartitions("level", "handle", "offset")
    rows.write.mode("errorifexists").partitionBy("level").parquet(f"{path}/jumps")
    starts = found.where("idx = 0").select(F.col("seq").alias("aln_id"), F.col("handle").alias("start_handle"), F.col("offset").alias("start_offset"))
    return reads.drop("path").join(starts, "aln_id", "left"), levels


def _with_paths(stored: DataFrame, jumps: DataFrame, levels: int) -> DataFrame:
    """Stored reads with their paths; a filter on blocks reaches the starts that are followed."""
    starts = stored.where("start_handle is not null").select("block_id", "aln_id", F.col("start_handle").alias("handle"), F.col("start_offset").alias("offset"))
    paths = visits.restore(starts, jumps, levels, ["block_id", "aln_id"])
    rows = stored.drop("start_handle", "start_offset").join(paths, ["block_id", "aln_id"], "left")
    return rows.withColumn("path", F.coalesce("path", F.array().cast("array<bigint>")))


@dataclass(frozen=True)
class AlignmentStore:
    alignments: DataFrame
    blocks: DataFrame
    nodes: DataFrame
    tags: dict
    params: AlignmentParams
    path: str = ""

    @property
    def version(self) -> str:
        return self.tags["version"]

    @property
    def n_alignments(self) -> int:
        return int(self.tags["alignments"])

    @property
    def n_nodes(self) -> int:
        return int(self.tags["nodes"])

    @property
    def bidirectional(self) -> bool:
        return self.tags["bidirectional_gbwt"] == "1"

    def n_blocks(self) -> int:
        return self.blocks.count()

    def size(self, table: str | None = None) -> int:
        """Bytes on disk, of one table if named."""
        spark = self.alignments.sparkSession
        hpath = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}" if table else self.path)
        return hpath.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hpath).getLength()

    def graph_name(self) -> GraphName:
        """The name of the graph that the reads are aligned to; tags that cannot be read are an error."""
        return GraphName.from_tags(self.tags, strict=True)

    def meeting(self, clusters: DataFrame, runs: int = 64) -> DataFrame:
        """The reads of the blocks whose handle range meets a cluster of nodes. Blocks that follow each other are runs, and
        up to so many of these prune files and row groups, as reads are stored in the order of blocks."""
        return self._of_blocks(reads_ops.blocks_meeting(self.blocks, clusters).select("block_id"), runs)

    def visiting(self, nodes: DataFrame, runs: int = 64) -> DataFrame:
        """The reads of the blocks that visit some of the nodes, by bitmaps: exact where `meeting` knows ranges only. A store
        without bitmaps goes by ranges."""
        if self.tags.get("bitmaps") != "1":
            return self.meeting(block_runs(nodes), runs)
        return self._of_blocks(self.blocks_visiting(nodes).select("block_id"), runs)

    def blocks_visiting(self, nodes: DataFrame) -> DataFrame:
        """(block_id, shared): how many of the nodes the reads of a block visit."""
        return reads_ops.blocks_with_nodes(self.alignments.sparkSession.read.parquet(f"{self.path}/block_bitmaps"), nodes)

    def _of_blocks(self, blocks: DataFrame, runs: int) -> DataFrame:
        found = block_runs(blocks.withColumnRenamed("block_id", "node_id"), gap=1).limit(runs + 1).collect()
        rows = self.alignments
        if len(found) <= runs:
            near = F.lit(False)
            for r in found:
                near = near | F.col("block_id").between(r.cluster_min, r.cluster_max)
            return rows.where(near)  # all blocks of a run are met
        return rows.join(blocks, "block_id", "left_semi")

    def rows(self, first: int, last: int) -> DataFrame:
        """The reads of blocks first <= block_id < last."""
        return self.alignments.where((F.col("block_id") >= first) & (F.col("block_id") < last))


def open_alignments(spark: SparkSession, path: str) -> AlignmentStore:
    tags = _tags(spark, path, READS_VERSION)
    if tags.get("bidirectional_gbwt") not in ("0", "1"):
        raise ValueError("bidirectional_gbwt must be 0 or 1")
    alignments, blocks, nodes = (spark.read.parquet(f"{path}/{t}") for t in ("alignments", "blocks", "nodes"))
    params = AlignmentParams.from_json(tags["params"])
    if params.start_positions:
        alignments = _with_paths(alignments, spark.read.schema(JUMPS).parquet(f"{path}/jumps"), int(tags["levels"]))
    return AlignmentStore(alignments, blocks, nodes, tags, params, path)
