"""Subgraph queries: a description, and its execution on a graph and on reads."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.operators import cigar, contexts, locate, reads, traverse, walks
from braidlake.schema import Graph, node_of
from braidlake.sources.names import GraphName, require_reference
from braidlake.sources.store import AlignmentStore, graph_name

ALL, DISTINCT, REFERENCE = "all", "distinct", "reference"
GENERIC = "_gbwt_ref"


@dataclass(frozen=True)
class SubgraphQuery:
    """What to extract: around an offset or interval of a path, around nodes, or between two handles."""

    kind: str
    sample: str = GENERIC
    contig: str | None = None
    haplotype: int = 0
    start: int = 0
    end: int = 0
    nodes: tuple[int, ...] = ()
    handles: tuple[int, int] = (0, 0)
    limit: int | None = None
    context: int = 100
    snarls: bool = False
    extend_snarls: bool = False
    output: str = ALL

    @classmethod
    def path_offset(cls, contig: str, offset: int, sample: str = GENERIC, haplotype: int = 0) -> SubgraphQuery:
        return cls("offset", sample, contig, haplotype, offset)

    @classmethod
    def path_interval(cls, contig: str, start: int, end: int, sample: str = GENERIC, haplotype: int = 0) -> SubgraphQuery:
        return cls("interval", sample, contig, haplotype, start, end)

    @classmethod
    def around_nodes(cls, nodes) -> SubgraphQuery:
        return cls("nodes", nodes=tuple(sorted(set(nodes))))

    @classmethod
    def between(cls, start: int, end: int, limit: int | None = None) -> SubgraphQuery:
        return cls("between", handles=(start, end), limit=limit)

    def with_(self, **changes) -> SubgraphQuery:
        q = replace(self, **changes)
        if q.output == REFERENCE and q.kind in ("nodes", "between"):
            raise ValueError("only queries by path have a reference")
        if q.extend_snarls and q.kind == "nodes" and len(q.nodes) > 1:
            raise ValueError("snarls can be extended from one node only")
        return q

    def __str__(self) -> str:
        what = {
            "offset": f"path {self.sample}#{self.haplotype}#{self.contig}, offset {self.start}", "interval": f"path {self.sample}#{self.haplotype}#{self.contig}, interval {self.start}..{self.end}",
            "nodes": f"nodes {list(self.nodes)}", "between": f"between {self.handles[0]} and {self.handles[1]}",
        }[self.kind]
        snarls = " extended to snarls" if self.extend_snarls else " with snarls" if self.snarls else ""
        return f"({what}, context {self.context}{snarls}, {self.output})"


@dataclass(frozen=True)
class Subgraph:
    """The result: small tables, and the reference's name and interval if there is one."""

    nodes: DataFrame
    edges: DataFrame
    walks: DataFrame
    sample: str | None = None
    ref_walk: tuple[int, ...] = ()

    def with_cigars(self) -> Subgraph:
        """Adds alignments to the reference walk."""
        return replace(self, walks=cigar.with_cigars(self.walks, list(self.ref_walk), self.nodes))

    def graph_name(self, parent: GraphName | None = None) -> GraphName:
        """The stable name of the subgraph, as a subgraph of its parent."""
        return GraphName(walks.stable_name(self.nodes, self.edges).first().name).subgraph_of(parent or GraphName())

    def gfa(self, name: GraphName | None = None) -> list[str]:
        """The text of the subgraph, with header lines for its name if given."""
        rows = walks.gfa_lines(self.nodes, self.edges, self.walks, self.sample, name.gfa_headers() if name else ())
        return [r.line for r in rows.orderBy("section", "k1", "k2").collect()]

    def json(self) -> str:
        return walks.json_document(self.nodes, self.edges, self.walks)

    def write_gfa(self, path: str, name: GraphName | None = None) -> None:
        """The text of a subgraph of any size, sorted and written in parts."""
        lines = walks.gfa_lines(self.nodes, self.edges, self.walks, self.sample, name.gfa_headers() if name else ())
        walks.in_order(lines).write.text(path)

    def write_json(self, path: str) -> None:
        """The document of a subgraph of any size, written in parts."""
        walks.in_order(walks.json_lines(self.nodes, self.edges, self.walks)).write.text(path)

    def clipped(self, selected: DataFrame, graph: Graph | None = None) -> DataFrame:
        """The fragments of selected reads inside the subgraph."""
        return reads.clip(selected, (graph.nodes if graph else self.nodes), self.nodes)

    def selected(self, alignments: DataFrame | AlignmentStore, how: str = reads.OVERLAPPING, graph: Graph | None = None) -> DataFrame:
        """Whole reads that overlap the subgraph or are contained in it."""
        if isinstance(alignments, AlignmentStore):
            if graph is not None:
                require_reference(alignments.graph_name(), graph_name(graph))
            alignments = alignments.visiting(self.nodes).drop("block_id")
        return reads.select(alignments, self.nodes, how)

    def reads(self, alignments: DataFrame | AlignmentStore, how: str = reads.OVERLAPPING, graph: Graph | None = None) -> DataFrame:
        """Reads of the subgraph: those that overlap it, their fragments inside, or those wholly contained.

        Of a store only the blocks are read that visit nodes of the subgraph, after its reference has been checked.
        """
        selected = self.selected(alignments, how, graph)
        return self.clipped(selected, graph) if how == reads.CLIPPED else selected


def node_records(store: AlignmentStore, sub: Subgraph | None = None, graph: Graph | None = None) -> DataFrame:
    """(node_id, sequence) of the nodes that a store's reads visit: from its own table, else the subgraph, else the graph."""
    own = store.nodes
    rows = own.select("node_id", F.col("sequence") if "sequence" in own.columns else F.lit(None).cast("string").alias("sequence"))
    for other in (sub, graph):
        if other is not None:
            more = other.nodes.select("node_id", F.col("sequence").alias("more"))
            rows = rows.join(more, "node_id", "left").select("node_id", F.coalesce("sequence", "more").alias("sequence"))
    return rows


def locate_path(graph: Graph, query: SubgraphQuery):
    """The (path_handle, path_offset, fragment) of a query's start. One lookup is a filter; many are `locate.find_paths`."""
    named = (F.col("sample") == query.sample) & (F.col("contig") == query.contig) & (F.col("haplotype") == query.haplotype)
    found = graph.paths.where(named & (F.col("fragment") <= query.start))
    row = found.agg(F.max_by("path_handle", "fragment").alias("path_handle"), F.max("fragment").alias("fragment")).first()
    if row.path_handle is None:
        raise ValueError(f"no path {query.sample}#{query.haplotype}#{query.contig} at {query.start}")
    return row.path_handle, query.start - row.fragment, row.fragment


#: Steps of an interval whose seeds may come to the driver; those of longer ones stay in a DataFrame.
MOST_SEEDS = 100_000


def seeds_of(graph: Graph, query: SubgraphQuery):
    """Seeds (node, side, distance) of a query by path, as a list or, of a long interval, a DataFrame (node_id, side, dist),
    and the query's place: (path_handle, first step, fragment)."""
    path, offset, fragment = locate_path(graph, query)
    end = offset + (query.end - query.start if query.kind == "interval" else 1)
    if end <= offset:
        raise ValueError("empty interval")
    here = (F.col("path_handle") == path) & (F.col("step_start") < end) & (F.col("step_end") > offset)
    rows = graph.steps.where(here)
    ends = rows.agg(F.count("*").alias("n"), F.min("step").alias("first"), F.max("step_end").alias("end")).first()
    if not ends.n or ends.end < end:
        raise ValueError(f"path {query.contig} does not contain offset {end - 1}")
    size, rev = F.col("step_end") - F.col("step_start"), F.col("handle").bitwiseAND(F.lit(1)).cast("int")
    at = F.greatest(offset - F.col("step_start"), F.lit(0))
    left = end - F.greatest(F.lit(offset), F.col("step_start"))  # what is left of the interval here
    beyond = F.when(F.lit(query.kind == "offset"), size - at - 1).when((F.col("step_end") >= end) & (left != size - at), size - at - left - 1).otherwise(0)
    both = F.array(F.struct(rev.alias("side"), at.cast("long").alias("dist")), F.struct((1 - rev).alias("side"), beyond.cast("long").alias("dist")))
    seeds = rows.select(node_of(F.col("handle")).alias("node_id"), F.explode(both).alias("x")).select("node_id", "x.side", "x.dist")
    place = path, ends.first, fragment
    return (seeds if ends.n > MOST_SEEDS else [tuple(r) for r in seeds.collect()]), place


def run(graph: Graph, query: SubgraphQuery) -> Subgraph:
    """Executes a query. The node set is found by a traversal (see traverse), all else by joins with it."""
    spark, place, seeds = graph.spark, None, ()
    if query.kind in ("offset", "interval"):
        seeds, place = seeds_of(graph, query)
    elif query.kind == "nodes":
        known = {r.node_id for r in graph.nodes.where(F.col("node_id").isin(list(query.nodes))).select("node_id").collect()}
        for n in query.nodes:
            if n not in known:
                raise KeyError(f"The graph does not contain handle {2 * n}")
        seeds = [(n, side, 0) for n in query.nodes for side in (0, 1)]

    def on_driver(near: traverse.Adjacency) -> DataFrame:
        if query.kind == "between":
            found = near.between(*query.handles, limit=query.limit)
        else:
            found = set(near.context(seeds, query.context))
            found = near.extended(found) if query.extend_snarls else near.with_snarls(found) if query.snarls else found
        return spark.createDataFrame([(n,) for n in sorted(found)], "node_id long")

    def in_frames() -> DataFrame:
        if query.kind == "between":
            ids = traverse.between_frontier(graph, spark.createDataFrame([(0, *query.handles)], "query_id long, start long, end long"), query.limit)
        else:
            many = seeds if isinstance(seeds, DataFrame) else spark.createDataFrame(list(seeds), "node_id long, side int, dist long")
            ids = contexts.contexts(graph, many.select(F.lit(0).cast("long").alias("query_id"), "node_id", "side", "dist"), query.context)
        ids = ids.select("node_id").distinct()
        if query.kind != "between":
            ids = traverse.extended(graph, ids) if query.extend_snarls else traverse.with_snarls(graph, ids) if query.snarls else ids
        return ids.checkpoint()

    ids = in_frames() if isinstance(seeds, DataFrame) else traverse.tiered(graph, on_driver, in_frames)
    return extract(graph, ids, query, place)


#: Runs of node ids that a subgraph is read by; more are only joined.
RUNS = 64


def in_runs(handle, runs, per_node: int):
    """Whether a handle (two a node) or node id (one a node) is in one of the runs; a filter that files can be pruned by."""
    out = F.lit(False)
    for r in runs:
        out = out | handle.between(per_node * r.cluster_min, per_node * r.cluster_max + per_node - 1)
    return out


def extract(graph: Graph, ids: DataFrame, query: SubgraphQuery, place=None) -> Subgraph:
    runs = locate.clusters(ids).limit(RUNS + 1).collect()
    near = (lambda df, c, k: df.where(in_runs(F.col(c), runs, k))) if len(runs) <= RUNS else (lambda df, c, k: df)
    nodes = near(graph.nodes, "node_id", 1).join(ids, "node_id", "left_semi")
    inside = near(graph.edges, "src", 2).join(ids, node_of(F.col("src")) == F.col("node_id"), "left_semi").join(ids, node_of(F.col("dst")) == F.col("node_id"), "left_semi")
    path, step, fragment = place or (None, None, None)
    islands = walks.islands(near(graph.steps_by_node or graph.steps, "handle", 2), ids, path, step)
    sample = contig = haplotype = start = end = None
    ref: tuple[int, ...] = ()
    if place:
        row = islands.where("is_ref").first()
        if row is None:
            raise ValueError("Could not find the reference path")
        name = graph.paths.where(F.col("path_handle") == path).first()
        sample, contig, haplotype = name.sample, name.contig, name.haplotype
        start, end, ref = row.walk_start + fragment, row.walk_end + fragment, tuple(row.walk)
    rows = walks.walks(islands)
    if query.output == DISTINCT:
        rows = walks.distinct_walks(rows)
    elif query.output == REFERENCE:
        if not place:
            raise ValueError("Reference path is required for reference-only output")
        rows = rows.where("is_ref")
    return Subgraph(nodes, inside, walks.named(rows, sample, contig, haplotype, start, end), sample, ref)


def slide(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inserted, removed) node ids when one context replaces another."""
    return after.join(before, "node_id", "left_anti"), before.join(after, "node_id", "left_anti")


class SlidingContext:
    """The context of a window that moves over a graph: what a move has in common with the last one is not fetched again.

    fetched counts the ranges of node ids that were read; those that the window has left are forgotten. A window that meets
    more than the driver should hold is searched in DataFrames.
    """

    def __init__(self, graph: Graph):
        self.graph, self.near, self.nodes, self.fetched = graph, traverse.Ranged(graph), set(), 0

    def move(self, query: SubgraphQuery) -> tuple[list[int], list[int]]:
        """Moves to a query by path or nodes; (inserted, removed) node ids, ascending."""
        if query.kind not in ("offset", "interval", "nodes"):
            raise ValueError("a window is around an offset, an interval or nodes")
        seeds = [(n, side, 0) for n in query.nodes for side in (0, 1)] if query.kind == "nodes" else seeds_of(self.graph, query)[0]
        before, had = self.nodes, len(self.near.loaded)
        try:
            if isinstance(seeds, DataFrame):
                raise traverse.Spread
            self.nodes = set(self.near.context(seeds, query.context))
            self.fetched += len(self.near.loaded) - had
            self.near.forget(self.nodes)
        except traverse.Spread:
            self.near = traverse.Ranged(self.graph)
            many = seeds if isinstance(seeds, DataFrame) else self.graph.spark.createDataFrame(seeds, "node_id long, side int, dist long")
            found = contexts.contexts(self.graph, many.select(F.lit(0).cast("long").alias("query_id"), "node_id", "side", "dist"), query.context)
            rows = found.select("node_id").limit(traverse.MAX_EDGES + 1).collect()
            if len(rows) > traverse.MAX_EDGES:
                raise ValueError(f"a window of more than {traverse.MAX_EDGES} nodes") from None
            self.nodes = {r.node_id for r in rows}
        return sorted(self.nodes - before), sorted(before - self.nodes)
