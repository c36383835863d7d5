"""Contexts of any number of queries at once: distances in the graph, bucket by bucket of node ids.

The adjacency is written once, in a folder for each range of node ids. In a round, what has reached a range meets the
adjacency of that range only: there each query goes on from its nearest node sides, nearest first, until it leaves the range
or its limit. What leaves is the next round's frontier, unless as good is known. So a round reads the ranges that its
frontier is in, and there are as many rounds as ranges that a context crosses, not as many as its steps.
"""

from __future__ import annotations

import heapq
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.operators._shared import ensure_checkpoint
from braidlake.schema import Graph, is_reverse, node_of

#: Node ids of a range; more if there would be over MOST_RANGES. Entries of a range that one task goes on from.
WIDTH, MOST_RANGES, ENTRIES = 4_096, 8_192, 20_000
KEY = ["query_id", "node_id", "side"]


class Adjacency:
    """The nodes in folders by range: node_id, seq_len, and the handles that follow it forwards and in reverse."""

    def __init__(self, graph: Graph):
        spark = graph.spark
        ensure_checkpoint(spark)
        top = graph.nodes.agg(F.max("node_id").alias("top")).first().top or 0
        self.spark, self.width = spark, max(WIDTH, -(-(top + 1) // MOST_RANGES))
        self.path = f"{spark.sparkContext.getCheckpointDir()}/adjacency-{uuid.uuid4().hex[:12]}"
        out = graph.edges.where("dst > 1").groupBy(node_of(F.col("src")).alias("node_id"))
        near = [F.array_sort(F.collect_set(F.when(is_reverse(F.col("src")) == rev, F.col("dst")))).alias(name) for rev, name in ((0, "onward"), (1, "back"))]
        rows = graph.nodes.select("node_id", "seq_len").join(out.agg(*near), "node_id", "left").withColumn("range", self.range_of("node_id"))
        rows.repartition("range").sortWithinPartitions("range", "node_id").write.partitionBy("range").parquet(self.path)

    def range_of(self, node_id: str):
        return F.floor(F.col(node_id) / self.width).cast("long")

    def near(self, ranges: list[int]) -> DataFrame:
        """The nodes of some ranges; other folders are not listed for the scan."""
        schema = "node_id long, seq_len long, onward array<long>, back array<long>, range long"
        return self.spark.read.schema(schema).parquet(self.path).where(F.col("range").isin(ranges))

    def drop(self) -> None:
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hpath.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hpath, True)


REACHED = "query_id long, node_id long, side int, dist long, inside boolean"


def _go_on(limit: int):
    """(entries of a range, its nodes) -> what queries reach in it, and what they reach beyond it."""

    def go_on(entries: pa.Table, nodes: pa.Table) -> pa.Table:
        length = dict(zip(nodes["node_id"].to_pylist(), nodes["seq_len"].to_pylist(), strict=True))
        beside = {}
        for n, onward, back in zip(nodes["node_id"].to_pylist(), nodes["onward"].to_pylist(), nodes["back"].to_pylist(), strict=True):
            beside[n, 1], beside[n, 0] = onward or (), back or ()
        of: dict[int, list] = {}
        for q, n, s, d in zip(*(entries[c].to_pylist() for c in (*KEY, "dist")), strict=True):
            if n in length:
                of.setdefault(q, []).append((d, n, s))
        found, beyond = [], {}
        for q, heap in of.items():
            heapq.heapify(heap)
            done = set()
            while heap:
                d, n, s = heapq.heappop(heap)
                if (n, s) in done:
                    continue
                done.add((n, s))
                found.append((q, n, s, d, True))
                across = d + length[n] - 1
                if across <= limit and (n, 1 - s) not in done:
                    heapq.heappush(heap, (across, n, 1 - s))
                if d < limit:
                    for h in beside[n, s]:
                        m, side = h >> 1, h & 1
                        if m not in length:
                            beyond[q, m, side] = min(d + 1, beyond.get((q, m, side), d + 1))
                        elif (m, side) not in done:
                            heapq.heappush(heap, (d + 1, m, side))
        found += [(*key, d, False) for key, d in beyond.items()]
        columns = list(zip(*found, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*KEY, "dist", "inside"])

    return go_on


def contexts(graph: Graph, seeds: DataFrame, limit: int, adjacency: Adjacency | None = None) -> DataFrame:
    """(query_id, node_id, side, dist) to (query_id, node_id, dist): nodes within the limit of a query's seeds, with their
    least distance. Seeds are always in. Seeds at nodes that the graph doesn't have are left out."""
    own, spark = adjacency is None, graph.spark
    near = adjacency or Adjacency(graph)
    frontier = seeds.groupBy(*[F.col(c).cast(t).alias(c) for c, t in zip(KEY, ("long", "long", "int"), strict=True)]).agg(F.min("dist").cast("long").alias("dist"))
    known = spark.createDataFrame([], "query_id long, node_id long, side int, dist long")
    while True:
        frontier = frontier.withColumn("range", near.range_of("node_id")).checkpoint()
        counts = frontier.groupBy("range").agg(F.ceil(F.count("*") / ENTRIES).alias("parts"))
        ranges = [r.range for r in counts.select("range").collect()]  # at most MOST_RANGES
        if not ranges:
            break
        # a query stays in one part, so its nearest entries come first; a range that many queries are in is several tasks'
        entries = frontier.join(counts, "range").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
        nodes = near.near(ranges).join(counts, "range").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        pairs = entries.select(*KEY, "dist", "range", "part").groupBy("range", "part").cogroup(nodes.select("node_id", "seq_len", "onward", "back", "range", "part").groupBy("range", "part"))
        reached = pairs.applyInArrow(_go_on(limit), REACHED).checkpoint()
        known = known.unionByName(reached.where("inside").drop("inside"))
        beyond = reached.where("not inside").groupBy(*KEY).agg(F.min("dist").alias("dist"))
        best = known.join(beyond.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.min("dist").alias("best"))
        frontier = beyond.join(best, KEY, "left").where("best is null or dist < best").select(*KEY, "dist")
    if own:
        near.drop()
    return known.groupBy("query_id", "node_id").agg(F.min("dist").alias("dist"))
