"""The 12-node graph: node sets, walks, snarls and text that are known for it.

Its sequences, walks, links and the text and node sets expected of queries on it are fixed values.
"""

import re

import pytest
from pyspark.sql import functions as F

from braidlake.operators import chains, contexts, locate, traverse, walks
from braidlake.plans.query import ALL, DISTINCT, REFERENCE, SubgraphQuery, run, slide
from braidlake.schema import Graph, handle

SEQUENCES = dict(zip([11, 12, 13, 14, 15, 16, 17, 21, 22, 23, 24, 25], "GATTACAGATTA", strict=True))
WALKS = [
    ("_gbwt_ref", 0, "A", [22, 24, 28, 30, 34]), ("_gbwt_ref", 0, "B", [42, 44, 48, 50]), ("sample", 1, "A", [22, 24, 28, 30, 34]),
    ("sample", 2, "A", [22, 26, 28, 32, 34]), ("sample", 1, "B", [42, 44, 48, 47, 43]), ("sample", 2, "B", [42, 44, 48, 50]),
]
LINKS = [(22, 28), (28, 34), (45, 46), (46, 49)]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(n, s, 1) for n, s in SEQUENCES.items()], "node_id long, sequence string, seq_len long")
    pairs = {p for *_, w in WALKS for p in zip(w, w[1:], strict=False)}
    edges = spark.createDataFrame(sorted(pairs | {(b ^ 1, a ^ 1) for a, b in pairs}), "src long, dst long")
    steps = spark.createDataFrame([(i, k, h) for i, (*_, w) in enumerate(WALKS) for k, h in enumerate(w)], "path_handle long, step long, handle long")
    paths = spark.createDataFrame([(i, s, c, h, 0, s == "_gbwt_ref", len(w)) for i, (s, h, c, w) in enumerate(WALKS)], "path_handle long, sample string, contig string, haplotype long, fragment long, is_indexed boolean, path_len long")
    links = spark.createDataFrame(LINKS + [(b ^ 1, a ^ 1) for a, b in LINKS], "handle long, next long")
    tags = spark.createDataFrame([("gbwt_a", "1"), ("gbwtxb", "2"), ("gbz_gbz_c", "3")], "key string, value string")
    return Graph(*[df.cache() for df in (nodes, edges, locate.step_offsets(steps, nodes), paths, links, tags)])


def ids(sub):
    return sorted(r.node_id for r in sub.nodes.select("node_id").collect())


off, between = SubgraphQuery.path_offset, SubgraphQuery.between
QUERIES = [
    (off("A", 2).with_(context=1), [12, 13, 14, 15, 16], 3), (off("A", 2).with_(context=1, output=DISTINCT), [12, 13, 14, 15, 16], 2),
    (SubgraphQuery.around_nodes([14]).with_(context=1, output=DISTINCT), [12, 13, 14, 15, 16], 2), (off("A", 2).with_(context=1, output=REFERENCE), [12, 13, 14, 15, 16], 1),
    (off("B", 2).with_(context=1, output=DISTINCT), [22, 23, 24, 25], 2), (SubgraphQuery.path_interval("A", 2, 5).with_(context=0), [14, 15, 17], 4),
    (SubgraphQuery.path_interval("A", 2, 5).with_(context=0, snarls=True), [14, 15, 16, 17], 3), (between(22, 28), [11, 12, 13, 14], 3), (between(29, 23), [11, 12, 13, 14], 3),
    (off("A", 1).with_(context=0, extend_snarls=True), [11, 12, 13, 14], 3), (off("A", 0).with_(context=0, extend_snarls=True), [11], 3),
    (off("A", 3).with_(context=1, extend_snarls=True), [14, 15, 16, 17], 3), (SubgraphQuery.path_interval("A", 1, 4).with_(context=0, extend_snarls=True), [11, 12, 13, 14, 15, 16, 17], 3),
    (off("B", 0).with_(context=0, extend_snarls=True), [21, 22, 23], 4), (off("B", 2).with_(context=0, extend_snarls=True), [24], 3),
]


@pytest.mark.parametrize(("query", "nodes", "paths"), QUERIES, ids=[str(q) for q, *_ in QUERIES])
def test_queries(graph, query, nodes, paths):
    sub = run(graph, query)
    assert ids(sub) == nodes
    assert sub.walks.count() == paths


HEAD = ["S\t12\tA", "S\t13\tT", "S\t14\tT", "S\t15\tA", "S\t16\tC", "L\t12\t+\t14\t+\t0M", "L\t13\t+\t14\t+\t0M", "L\t14\t+\t15\t+\t0M", "L\t14\t+\t16\t+\t0M"]


def test_gfa_and_json(graph):
    sub = run(graph, QUERIES[0][0]).with_cigars()
    assert sub.gfa() == ["H\tVN:Z:1.1\tRS:Z:_gbwt_ref", *HEAD, "W\t_gbwt_ref\t0\tA\t1\t4\t>12>14>15", "W\tunknown\t1\tA\t0\t3\t>12>14>15\tCG:Z:3M", "W\tunknown\t2\tA\t0\t3\t>13>14>16\tCG:Z:3M"]
    assert sub.json().startswith('{"nodes": [{"id": "12", "sequence": "A"}, ') and '"edges": [{"from": "12", "from_is_reverse": false, "to": "14", "to_is_reverse": false}, ' in sub.json()
    assert run(graph, QUERIES[2][0]).gfa() == ["H\tVN:Z:1.1", *HEAD, "W\tunknown\t1\tunknown\t0\t3\t>12>14>15\tWT:i:2", "W\tunknown\t2\tunknown\t0\t3\t>13>14>16\tWT:i:1"]
    want = ["H\tVN:Z:1.1\tRS:Z:_gbwt_ref", "S\t22\tA", "S\t23\tT", "S\t24\tT", "S\t25\tA", "L\t22\t+\t24\t+\t0M", "L\t23\t+\t24\t-\t0M", "L\t24\t+\t25\t+\t0M", "W\t_gbwt_ref\t0\tB\t1\t4\t>22>24>25\tWT:i:2", "W\tunknown\t1\tB\t0\t3\t>22>24<23\tWT:i:1"]
    assert run(graph, QUERIES[4][0]).gfa() == want


SNARLS = [
    ([], []), ([11, 14], []), ([11, 14, 17], []), ([12, 13, 14], [(22, 28)]), ([11, 14, 16], [(28, 34)]), ([21, 24], []), ([22, 23], []), ([23, 24], [(46, 49)]),
]
PARTIAL = [([], []), ([11], []), ([11, 14], []), ([11, 12, 13], [(22, 28)]), ([12, 13], []), ([22, 23], []), ([23, 24], []), ([11, 14, 16], [])]


def test_snarls_in_both_tiers(spark, graph):
    near = traverse.adjacency(graph)
    for nodes, want in SNARLS:
        assert near.snarls(set(nodes)) == want, nodes
        df = spark.createDataFrame([(n,) for n in nodes], "node_id long")
        assert sorted(map(tuple, traverse.covered_snarls(graph, df).collect())) == want, nodes
    for nodes, want in [*PARTIAL, ([11, 12, 21], [])]:  # the last in two components
        assert near.snarls(set(nodes), partial=True) == want, nodes
        df = spark.createDataFrame([(n,) for n in nodes], "node_id long")
        assert sorted(map(tuple, traverse.covered_snarls(graph, df, partial=True).collect())) == want, nodes


def test_tiers_agree(spark, graph):
    from braidlake.operators._shared import ensure_checkpoint

    ensure_checkpoint(spark)
    near = traverse.adjacency(graph)
    seeds = [(0, 14, 0, 0), (0, 14, 1, 0), (1, 23, 0, 0), (1, 23, 1, 0)]
    got = contexts.contexts(graph, spark.createDataFrame(seeds, "query_id long, node_id long, side int, dist long"), 2).collect()
    for q in (0, 1):
        assert {r.node_id: r.dist for r in got if r.query_id == q} == near.context([s[1:] for s in seeds if s[0] == q], 2)
    ends = spark.createDataFrame([(0, 22, 28), (1, 45, 46)], "query_id long, start long, end long")
    got = traverse.between_frontier(graph, ends).collect()
    assert {r.node_id for r in got if r.query_id == 0} == near.between(22, 28) and {r.node_id for r in got if r.query_id == 1} == near.between(45, 46)
    labels = traverse.components_frontier(graph, graph.nodes.where("node_id <> 14")).collect()
    assert len({r.component for r in labels}) == near.components(set(SEQUENCES) - {14})
    assert traverse.adjacency(graph, 3) is None
    with pytest.raises(traverse.LimitExceeded):
        near.between(22, 28, limit=2)
    with pytest.raises(traverse.LimitExceeded):
        traverse.between_frontier(graph, ends, 2)


def test_ranges_are_fetched_as_they_are_met(graph):
    near = traverse.Ranged(graph, width=2, ranges=20)
    whole = traverse.adjacency(graph)
    assert near.context([(14, 0, 0), (14, 1, 0)], 1) == whole.context([(14, 0, 0), (14, 1, 0)], 1)
    assert near.loaded == {6, 7, 8} and near.extended({12}) == whole.extended({12}) and near.snarls({12, 13, 14}) == [(22, 28)]


def test_chains_are_found(graph):
    near = traverse.adjacency(graph)
    assert [p for p in traverse.discover_chains(near) if p[0] >> 1 < 20] == [(22, 28), (28, 34), (29, 23), (35, 29)]
    assert traverse.dominators(near, 22, 26) == [22, 26] and traverse.dominators(near, 34, 22) == []


def test_snarls_and_chains_beyond_the_first_tier(spark, graph, monkeypatch):
    from braidlake.plans import queries

    rows = lambda df: sorted(map(tuple, df.collect()))
    near = traverse.adjacency(graph)
    for nodes in ({12}, {25}, {12, 16}):
        df = spark.createDataFrame([(n,) for n in nodes], "node_id long")
        assert rows(traverse.enclosing_frontier(graph, df)) == [(n,) for n in sorted(near.enclosing(nodes))], nodes
    want = rows(queries.enclosing_snarl(graph)), rows(chains.discover_chains(graph))
    extended = [(q, n, p) for q, n, p in QUERIES if q.snarls or q.extend_snarls][::2]
    monkeypatch.setattr(traverse, "RANGES", 1)
    monkeypatch.setattr(traverse, "WIDTH", 2)  # so the first tier meets too much at once
    with pytest.raises(traverse.Spread):
        traverse.Ranged(graph).context([(14, 0, 0), (14, 1, 0)], 9)
    for query, nodes, paths in extended:
        sub = run(graph, query)
        assert ids(sub) == nodes and sub.walks.count() == paths
    assert rows(queries.enclosing_snarl(graph)) == want[0] and [p for p in want[1] if p[0] >> 1 < 20] == [(22, 28), (28, 34), (29, 23), (35, 29)]


def test_command_line(spark, tmp_path, capsys):
    from braidlake.__main__ import main

    gfa = "H\tVN:Z:1.1\nS\t1\tAC\nS\t2\tG\nS\t3\tT\nS\t4\tCC\n" + "".join(f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in ((1, 2), (1, 3), (2, 4), (3, 4)))
    (tmp_path / "g.gfa").write_text(gfa + "W\tref\t0\tc\t0\t5\t>1>2>4\nW\ts\t1\tc\t0\t5\t>1>3>4\n")
    (tmp_path / "r.gaf").write_text("@HD\tVN:Z:1.0\n" + "b\t3\t0\t3\t+\t>3>4\t3\t0\t3\t3\t3\t60\tcs:Z::3\n" + "a\t2\t0\t2\t+\t>1\t2\t0\t2\t2\t2\t60\tcs:Z::2\n")
    at = lambda x: f"{tmp_path}/{x}"
    main(["build-graph", at("g.gfa"), at("graph")])
    main(["build-reads", at("r.gaf"), at("reads")])
    main(["query", at("graph"), "--sample", "ref", "--contig", "c", "--offset", "2", "--context", "1", "--snarls", "--cigar", "--reads", at("reads"), "--reads-output", at("out")])
    out = capsys.readouterr().out
    assert "W\tref\t0\tc\t0\t5\t>1>2>4" in out and "W\tunknown\t1\tc\t0\t5\t>1>3>4\tCG:Z:5M" in out
    text = lambda x: "".join(open(f).read() for f in sorted(__import__("glob").glob(at(x) + "/part-*"))).splitlines()
    assert [x.split("\t")[0] for x in text("out")] == ["@HD", "b", "a"]
    main(["export-reads", at("reads"), at("graph"), at("export")])
    assert text("export")[1:] == (tmp_path / "r.gaf").read_text().splitlines()[1:]
    main(["sort", at("r.gaf"), at("sorted")])
    assert [x.split("\t")[0] for x in text("sorted")] == ["@HD", "a", "b"]
    main(["query", at("graph"), "--between", "1+:4+", "--format", "json"])
    assert '"edges": [{"from": "1"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["query", at("graph")])


def test_sets_edges_and_starts(spark, graph):
    one = spark.createDataFrame([(11,)], "node_id long")
    nodes = lambda df: sorted(r.node_id for r in df.collect())
    assert nodes(traverse.add_node(traverse.add_node(one, 12), 12)) == [11, 12] and nodes(traverse.remove_node(one, 11)) == nodes(traverse.remove_node(one.where("false"), 5)) == []
    assert sorted(map(tuple, walks.edges_of_steps(graph.steps).collect())) == sorted(map(tuple, graph.edges.collect()))
    assert walks.path_start(graph, 1) == (42, 0) and walks.path_start(graph, 77) == (0, 0)
    assert [r.path_handle for r in locate.path_named(graph.paths, "sample", "A", 2).collect()] == [3] and locate.indexed_paths(graph.paths).count() == 2


def test_texts_are_written_in_parts(graph, tmp_path):
    """The parts in the order of their names are the collected text."""
    import json
    from pathlib import Path

    sub = run(graph, QUERIES[0][0]).with_cigars()
    read = lambda name: "\n".join(f.read_text().rstrip("\n") for f in sorted(Path(tmp_path, name).glob("part-*")) if f.stat().st_size)
    sub.write_gfa(f"{tmp_path}/gfa")
    sub.write_json(f"{tmp_path}/json")
    assert read("gfa").splitlines() == sub.gfa()
    assert json.loads(read("json")) == json.loads(sub.json())
    none = run(graph, between(22, 28))
    none = type(none)(none.nodes.where("false"), none.edges.where("false"), none.walks.where("false"))
    none.write_json(f"{tmp_path}/none")
    assert json.loads(read("none")) == {"nodes": [], "edges": [], "paths": []}


def test_seeds_of_a_long_interval_stay_in_a_frame(graph, monkeypatch):
    from braidlake.plans import query as q

    wanted = [x for x in QUERIES if x[0].kind == "interval"]
    lists = [sorted(q.seeds_of(graph, x[0])[0]) for x in wanted]
    monkeypatch.setattr(q, "MOST_SEEDS", 0)
    for (one, nodes, paths), seeds in zip(wanted[:2], lists, strict=False):
        assert sorted(map(tuple, q.seeds_of(graph, one)[0].collect())) == seeds
        sub = run(graph, one)
        assert ids(sub) == nodes and sub.walks.count() == paths


def test_errors(graph):
    for bad in (off("A", 5), off("C", 0), SubgraphQuery.path_interval("A", 2, 9), SubgraphQuery.path_interval("A", 2, 2)):
        with pytest.raises(ValueError):
            run(graph, bad)
    with pytest.raises(KeyError):
        run(graph, SubgraphQuery.around_nodes([99]))
    with pytest.raises(ValueError):
        SubgraphQuery.around_nodes([1]).with_(output=REFERENCE)
    with pytest.raises(ValueError):
        SubgraphQuery.around_nodes([1, 2]).with_(extend_snarls=True)


def test_sliding_window(graph):
    a, b = run(graph, off("A", 1).with_(context=1)), run(graph, off("A", 3).with_(context=1))
    inserted, removed = slide(a.nodes, b.nodes)
    assert ids(b) == sorted((set(ids(a)) | {r.node_id for r in inserted.collect()}) - {r.node_id for r in removed.collect()})
    assert slide(a.nodes, a.nodes)[0].count() == 0


def test_a_window_fetches_only_what_is_new(spark, graph, monkeypatch):
    """Moves along both paths, back and away, with what they have in common kept; too large a window goes on in DataFrames."""
    from braidlake.plans.query import SlidingContext

    monkeypatch.setattr(traverse, "WIDTH", 2)
    window, have = SlidingContext(graph), set()
    for at, context in ((0, 1), (1, 1), (2, 1), (2, 1), (4, 0), (0, 2)):
        query = off("A", at).with_(context=context)
        inserted, removed = window.move(query)
        have = (have | set(inserted)) - set(removed)
        assert sorted(have) == ids(run(graph, query)) and not set(inserted) & set(removed)
    fetched = window.fetched
    assert window.move(query) == ([], []) and window.fetched == fetched
    assert window.near.loaded == {n // 2 for n in have}
    monkeypatch.setattr(traverse, "RANGES", 1)
    wide = SlidingContext(graph)
    assert wide.move(SubgraphQuery.around_nodes([14]).with_(context=9)) == (list(range(11, 18)), [])
    assert wide.move(SubgraphQuery.around_nodes([12]).with_(context=0)) == ([], [11, 13, 14, 15, 16, 17])


def test_store_round_trip(spark, graph, tmp_path):
    from braidlake.sources import store
    from braidlake.sources.text import identify_source, read_gfa

    path = f"{tmp_path}/graph"
    store.write_graph(graph, path, interval=3)
    again = store.open_graph(spark, path)
    assert run(again, QUERIES[0][0]).gfa() == run(graph, QUERIES[0][0]).gfa()
    found = run(again, QUERIES[0][0])  # the steps in the order of nodes are read, by a range of handles
    assert any("steps_by_node" in f for f in found.walks.inputFiles()) and not any("/steps/" in f for f in found.walks.inputFiles())
    assert re.search(r"handle#\d+L >= 24\)", found.walks._jdf.queryExecution().executedPlan().toString())
    tags = {r.key: r.value for r in again.tags.collect()}
    assert {k: tags[k] for k in ("nodes", "paths", "samples", "haplotypes", "contigs", "chain_links", "chains")} == {"nodes": "12", "paths": "6", "samples": "2", "haplotypes": "3", "contigs": "2", "chain_links": "8", "chains": "2"}
    assert {r.key for r in store.tags_with_prefix(again.tags, "gbwt_").collect()} == {"a"} and [r.key for r in store.tags_with_prefix(again.tags, "gbz_").collect()] == ["gbz_c"]
    index = [tuple(r) for r in spark.read.parquet(f"{path}/reference_index").where("path_handle = 0").select("path_offset", "node_handle").collect()]
    assert sorted(index) == [(0, 22), (3, 30)]
    assert identify_source(path) == "store:graph 1" and identify_source(path + "x") == "missing"
    with pytest.raises(Exception, match="(?i)exist"):
        store.write_graph(graph, path)
    everything = walks.named(walks.walks(walks.islands(graph.steps, graph.nodes, 0, 0)), "_gbwt_ref", "A", 0, 0, 5)
    lines = walks.gfa_lines(graph.nodes, graph.edges, everything)
    lines.orderBy("section", "k1", "k2").select("line").coalesce(1).write.text(f"{tmp_path}/gfa")
    back = read_gfa(spark, f"{tmp_path}/gfa")
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, graph.edges.collect()))
    assert walks.stable_name(back.nodes, back.edges).first()[0] == walks.stable_name(graph.nodes, graph.edges.orderBy(F.rand(1))).first()[0]
    assert handle(12, 1) == 25 and ALL == "all"


def test_walks_are_numbered_in_bins(spark, monkeypatch):
    """By start handle and place, whatever the bins of places; no task numbers all walks."""
    import random

    from braidlake.operators import walks

    monkeypatch.setattr(walks, "PLACES_AT_ONCE", 3)
    rng = random.Random(1)
    places = {h: rng.sample(range(40), 15) for h in (2, 5, 8)}
    rows = [([h, 2 * k], o == 7, o, 4) for h, some in places.items() for k, o in enumerate(some)] + [([9, 4], True, 30, 4)]
    df = spark.createDataFrame(rows, "walk array<long>, is_ref boolean, offset long, len long")
    got = walks.named(df, "s", "c", 6, 1, 2)
    order = sorted((w[0], o) for w, ref, o, _ in rows if not ref)
    found = got.collect()
    assert len(found) == len(rows) and got.columns[:4] == df.columns and got.columns[4:] == ["sample", "haplotype", "contig", "start", "end"]
    for r in found:
        assert r.haplotype == (6 if r.is_ref else 1 + order.index((r.walk[0], r.offset)))
    assert "__bin" in got._jdf.queryExecution().optimizedPlan().toString()
