"""What large tables are not made to do: rows that lie in order are not moved, and pairs are not remembered."""

import pytest

from braidlake.operators import locate, walks
from braidlake.plans import fixtures

STEPS = "path_handle long, step long, handle long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sorted_steps_are_not_moved(spark, monkeypatch):
    paths = [[2, 4, 7, 2, 9], [4], [6, 7, 6], [2 * (k % 5 + 1) for k in range(23)]]
    rows = [(p, s, h) for p, path in enumerate(paths) for s, h in enumerate(path, 1)] + [(9, 1, 2), (9, 3, 4)]  # a gap is no edge
    lens = {n: n + 1 for n in range(1, 6)}
    nodes = spark.createDataFrame(lens.items(), "node_id long, seq_len long")
    steps = spark.createDataFrame(rows, STEPS).repartition("path_handle").sortWithinPartitions("path_handle", "step").persist()
    steps.count()
    pairs = {(a, b) for path in paths for a, b in zip(path, path[1:], strict=False)}
    edges, starts, at = sorted(pairs | {(b ^ 1, a ^ 1) for a, b in pairs}), {}, {}
    for p, s, h in rows:
        starts[p, s] = at.get(p, 0)
        at[p] = starts[p, s] + lens[h >> 1]
    for most in (1 << 16, 8):  # in a row, and in bins
        monkeypatch.setattr(locate, "STEPS_AT_ONCE", most)
        assert locate.short_paths(steps) == (most > 23)
        assert sorted(map(tuple, walks.edges_of_steps(steps).collect())) == edges
        got = locate.step_offsets(steps, nodes)
        assert {(r.path_handle, r.step): r.step_start for r in got.collect()} == starts
        assert all(r.step_end - r.step_start == lens[r.handle >> 1] for r in got.collect())
    monkeypatch.undo()
    moved = plan(locate.step_offsets(steps, nodes.limit(5).hint("broadcast"))).split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning(path_handle" not in moved and "Sort [path_handle" not in moved
    assert "Join" not in plan(walks.edges_of_steps(steps)).split("InMemoryRelation")[0]
    assert not locate.short_paths(spark.createDataFrame([(1, 1 << 16, 2)], STEPS)) and locate.short_paths(steps.limit(0))


def test_intervals_over_many_bins_meet_each_step_once(spark, monkeypatch):
    monkeypatch.setattr(locate, "BIN", 4)
    spans = [(0, 1), (1, 12), (12, 13), (13, 40), (40, 44), (44, 45)]
    steps = spark.createDataFrame([(p, s, 2, a, b) for p in (1, 2) for s, (a, b) in enumerate(spans)], f"{STEPS}, step_start long, step_end long")
    asked = [(k, 1 + k % 2, a, a + n) for k, (a, n) in enumerate((a, n) for a in range(0, 50, 3) for n in (1, 4, 15, 60))]
    found = locate.interval_to_steps(spark.createDataFrame(asked, "query_id long, path_handle long, start long, end long"), steps)
    want = sorted((q, s) for q, _, a, b in asked for s, (c, d) in enumerate(spans) if c < b and a < d)
    assert sorted((r.query_id, r.step) for r in found.collect()) == want
    assert "Aggregate" not in plan(found)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_lines_are_made_without_taking_reads_apart(spark, sf):
    lines = fixtures.lines(spark, sf)
    assert "collect_list" not in plan(lines).split("InMemoryRelation")[0]
    assert lines.count() == lines.select("aln_id").distinct().count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_text_is_not_read_again_for_the_paths(spark, tmp_path):
    from braidlake.sources.text import read_gfa

    lines = ["S\t1\tAC", "S\t2\tG", "W\ta\t0\tx\t0\t3\t>1<2", "P\ty\t1+, 2-,1+\t*", "W\tb\t1\tx\t7\t9\t>1", "L\t1\t+\t2\t-\t0M"]
    (tmp_path / "g.gfa").write_text("\n".join(lines) + "\n")
    read = read_gfa(spark, f"{tmp_path}/g.gfa")
    got = {r.path_handle: (r.sample, r.contig, r.haplotype, r.fragment, r.is_indexed, r.path_len) for r in read.paths.collect()}
    assert got == {0: ("a", "x", 0, 0, False, 3), 1: ("_gbwt_ref", "y", 0, 0, True, 5), 2: ("b", "x", 1, 7, False, 2)}
    rows = sorted((r.path_handle, r.step, r.handle, r.step_start, r.step_end) for r in read.steps.collect())
    assert rows == [(0, 0, 2, 0, 2), (0, 1, 5, 2, 3), (1, 0, 2, 0, 2), (1, 1, 5, 2, 3), (1, 2, 2, 3, 5), (2, 0, 2, 0, 2)]
    scans = lambda df: plan(df.select("path_handle")).count("FileScan text")
    assert scans(read.paths) <= scans(read.nodes.select(read.nodes.node_id.alias("path_handle"))) >= scans(read.steps)
