"""Commands: build-graph, build-reads, export-reads, query, sort. `python -m braidlake COMMAND --help`."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from braidlake.functions import gaf, seq
from braidlake.operators import chains, traverse, walks
from braidlake.operators import reads as R
from braidlake.operators.reads import path_steps
from braidlake.plans.query import ALL, DISTINCT, GENERIC, REFERENCE, SubgraphQuery, node_records, run
from braidlake.schema import Graph, is_reverse, node_of
from braidlake.sources import store, text
from braidlake.sources.names import GraphName, require_reference


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="braidlake")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("build-graph", help="GFA text to a graph store")
    p.add_argument("gfa")
    p.add_argument("output")
    p.add_argument("--interval", type=seq.parse_size, default=1000)
    p = sub.add_parser("build-reads", help="alignment text to a store")
    p.add_argument("gaf")
    p.add_argument("output")
    p.add_argument("--block-size", type=seq.parse_size, default=1000)
    p.add_argument("--ref-free", metavar="GRAPH")
    p.add_argument("--no-quality", action="store_true")
    p.add_argument("--no-optional", action="store_true")
    p.add_argument("--positions", action="store_true", help="keep paths as start positions with a table of jumps")
    p = sub.add_parser("export-reads", help="a store of alignments to text")
    p.add_argument("reads")
    p.add_argument("graph")
    p.add_argument("output")
    p = sub.add_parser("query", help="a subgraph, its haplotypes and its reads")
    p.add_argument("graph")
    p.add_argument("--sample", default=GENERIC)
    p.add_argument("--haplotype", type=int, default=0)
    p.add_argument("--contig")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--offset", type=int)
    what.add_argument("--interval", type=seq.parse_interval)
    what.add_argument("--node", type=int, action="append")
    what.add_argument("--between", type=seq.parse_between)
    p.add_argument("--limit", type=int)
    p.add_argument("--context", type=int, default=100)
    p.add_argument("--snarls", action="store_true")
    p.add_argument("--extend-snarls", action="store_true")
    p.add_argument("--output", choices=[ALL, DISTINCT, REFERENCE], default=ALL)
    p.add_argument("--cigar", action="store_true")
    p.add_argument("--format", choices=["gfa", "json"], default="gfa")
    p.add_argument("--to", help="a folder for the text, written in parts; without it the text goes to standard output")
    p.add_argument("--reads")
    p.add_argument("--reads-output")
    p.add_argument("--reads-how", choices=[R.OVERLAPPING, R.CLIPPED, R.CONTAINED], default=R.OVERLAPPING)
    p = sub.add_parser("sort", help="alignment text by handles")
    p.add_argument("gaf")
    p.add_argument("output")
    p.add_argument("--hash", action="store_true", help="shuffle by a hash of the line")
    p.add_argument("--partitions", type=int, help="output files, about; Spark's number of shuffle partitions by default")
    return top


def with_targets(reads, nodes):
    """Adds target: the bases of each read's path, which its text needs."""
    rows = path_steps(reads).withColumn("node_id", node_of(F.col("handle"))).join(nodes, "node_id")
    bases = F.struct("pos", seq.oriented(F.col("sequence"), is_reverse(F.col("handle"))).alias("s"))
    whole = rows.groupBy("aln_id").agg(F.array_join(F.sort_array(F.collect_list(bases))["s"], "").alias("target"))
    return reads.join(whole, "aln_id", "left").withColumn("target", F.coalesce("target", F.lit("")))


def _write_reads(reads, nodes, path: str, name: GraphName) -> None:
    lines = with_targets(reads, nodes).select(F.col("aln_id").alias("line_no"), gaf.to_line(F.col("target")).alias("line"))
    text.write_gaf(lines, path, name.gaf_headers())


def _say(**values) -> None:
    print(", ".join(f"{v} {k.replace('_', ' ')}" for k, v in values.items()), file=sys.stderr)


def _peak_memory() -> str:
    """The most memory that this process held; executors have their own."""
    import resource

    return f"{resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024:.0f} MB"


def _query(args) -> SubgraphQuery:
    if args.offset is not None:
        q = SubgraphQuery.path_offset(args.contig, args.offset, args.sample, args.haplotype)
    elif args.interval:
        q = SubgraphQuery.path_interval(args.contig, *args.interval, args.sample, args.haplotype)
    elif args.node:
        q = SubgraphQuery.around_nodes(args.node)
    else:
        q = SubgraphQuery.between(*args.between, limit=args.limit)
    return q.with_(context=args.context, snarls=args.snarls, extend_snarls=args.extend_snarls, output=args.output)


def main(argv: list[str] | None = None) -> None:
    args, began = _parser().parse_args(argv), time.time()
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build-graph":
        g = text.read_gfa(spark, args.gfa)
        near = traverse.adjacency(g)
        links = chains.discover_chains(g) if near is None else spark.createDataFrame(traverse.discover_chains(near), "handle long, next long")
        name = GraphName(walks.stable_name(g.nodes, g.edges).first().name)
        store.write_graph(Graph(g.nodes, g.edges, g.steps, g.paths, links, g.tags), args.output, args.interval, name)
        _say(**{r.key: r.value for r in store.header_counts(store.open_graph(spark, args.output)).collect()})
    elif args.command == "build-reads":
        graph = store.open_graph(spark, args.ref_free) if args.ref_free else None
        params = store.AlignmentParams(args.block_size, graph is not None, not args.no_quality, not args.no_optional, args.positions)
        heads = [r.value for r in text.headers(text.read_lines(spark, args.gaf)).collect()]
        store.write_alignments(text.read_gaf(spark, args.gaf), args.output, params, graph, name=GraphName.from_headers(heads))
        opened = store.open_alignments(spark, args.output)
        _say(alignments=opened.n_alignments, blocks=opened.n_blocks(), nodes=opened.n_nodes, bytes=opened.size(), **R.column_bytes(opened.alignments).first().asDict())
    elif args.command == "export-reads":
        opened, graph = store.open_alignments(spark, args.reads), store.open_graph(spark, args.graph)
        require_reference(opened.graph_name(), store.graph_name(graph))
        _write_reads(opened.alignments, node_records(opened, graph=graph), args.output, opened.graph_name())
    elif args.command == "sort":
        lines = text.read_lines(spark, args.gaf)
        data = lines.where(~F.col("value").startswith("@") & (F.col("value") != ""))
        ordered = R.sort_lines(data, by_hash=args.hash, partitions=args.partitions).select("value")
        heads = [(h.value,) for h in text.headers(lines).orderBy("line_no").collect()]
        if heads:  # a union keeps the order of its parts, so the headers' file is the first
            ordered = spark.createDataFrame(heads, "value string").coalesce(1).unionByName(ordered)
        ordered.write.text(args.output)
        _say(records=spark.read.text(args.output).count() - len(heads))
    else:
        graph = store.open_graph(spark, args.graph)
        sub = run(graph, _query(args))
        sub = sub.with_cigars() if args.cigar else sub
        name = sub.graph_name(store.graph_name(graph))
        if args.to:
            sub.write_gfa(args.to, name) if args.format == "gfa" else sub.write_json(args.to)
        else:
            print("\n".join(sub.gfa(name)) if args.format == "gfa" else sub.json())
        if args.reads:
            opened = store.open_alignments(spark, args.reads)
            picked = sub.selected(opened, args.reads_how, graph).persist()  # what is written and counted, so the store is read once
            found = sub.clipped(picked, graph) if args.reads_how == R.CLIPPED else picked
            _write_reads(found, graph.nodes, args.reads_output, opened.graph_name())
            _say(**R.counters(picked, found, opened.blocks_visiting(sub.nodes)).first().asDict())
    print(f"{args.command}: {time.time() - began:.3f} seconds, peak memory of the driver's Python {_peak_memory()}", file=sys.stderr)


if __name__ == "__main__":
    main()
