"""Ranges that meet, runs of ids, and errors that are raised whatever is read."""

import random

import pytest

from braidlake.operators import locate
from braidlake.operators import reads as R


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "NestedLoop" in plan, "Cartesian" in plan


def test_ranges_of_any_length_meet(spark):
    rng, rows = random.Random(2), []
    for i in range(300):
        a = rng.randrange(1 << rng.choice([4, 10, 40]))
        rows.append((i, a, a + rng.choice([0, 1, 5, 1000, 1 << 30])))
    rows += [(900, 0, 1 << 45), (901, 1 << 20, 1 << 20), (902, (1 << 20) - 1, 1 << 20), (903, None, 7), (904, 9, None)]
    other = [(a, a + rng.choice([0, 3, 100, 1 << 21])) for a in (rng.randrange(1 << rng.choice([5, 12, 41])) for _ in range(60))]
    for probes in (other, [(0, 1 << 50)], [(1 << 20, 1 << 20)], []):
        left = spark.createDataFrame(rows, "block_id long, min_handle long, max_handle long")
        right = spark.createDataFrame(probes, "low long, high long")
        got = locate.overlapping(left, right, ("min_handle", "max_handle"), ("low", "high")).dropDuplicates(["block_id"])
        want = {i for i, a, b in rows if a is not None and b is not None and any(a <= d and b >= c for c, d in probes)}
        assert {r.block_id for r in got.collect()} == want and got.columns == left.columns
        assert joins(got) == (False, False)
    clusters = spark.createDataFrame([(3, 4), (1 << 18, 1 << 19)], "cluster_min long, cluster_max long")
    met = R.blocks_meeting(left, clusters)
    assert {r.block_id for r in met.collect()} == {i for i, a, b in rows if a is not None and b is not None and any(a <= 2 * d + 1 and b >= 2 * c for c, d in ((3, 4), (1 << 18, 1 << 19)))}


@pytest.mark.parametrize("at_once", [1, 8, 1 << 20])
def test_runs_of_ids(spark, monkeypatch, at_once):
    monkeypatch.setattr(locate, "IDS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    ids = sorted({rng.randrange(900) for _ in range(200)})
    for gap in (1, 4, 1000):
        runs = [[ids[0]]]
        for a, b in zip(ids, ids[1:], strict=False):
            runs[-1].append(b) if b - a <= gap else runs.append([b])
        got = locate.clusters(spark.createDataFrame([(i,) for i in ids + ids[:9]], "node_id long"), gap)
        assert sorted(map(tuple, got.collect())) == [(r[0], r[-1], len(r)) for r in runs]
    assert locate.clusters(spark.createDataFrame([], "node_id long")).count() == 0


def test_bad_lines_raise_whatever_is_read(spark, tmp_path):
    from braidlake.sources.text import read_gaf

    good = "a\t2\t0\t2\t+\t>1\t2\t0\t2\t2\t2\t60"
    (tmp_path / "good.gaf").write_text(f"@HD\tVN:Z:1.0\n{good}\n")
    (tmp_path / "bad.gaf").write_text(f"{good}\n{good[:-3]}\n")
    assert read_gaf(spark, f"{tmp_path}/good.gaf").count() == 1 and read_gaf(spark, f"{tmp_path}/good.gaf").columns == read_gaf(spark, f"{tmp_path}/bad.gaf", "drop").columns
    bad = read_gaf(spark, f"{tmp_path}/bad.gaf")
    for read in (lambda: bad.count(), lambda: bad.select("path").collect(), lambda: bad.select("aln_id").where("aln_id > 0").collect(), lambda: bad.groupBy("mapq").count().collect()):
        with pytest.raises(Exception, match="line 1: too few fields"):
            read()
    assert read_gaf(spark, f"{tmp_path}/bad.gaf", "drop").count() == 1
    assert [r.error for r in read_gaf(spark, f"{tmp_path}/bad.gaf", "keep").orderBy("aln_id").collect()] == [None, "too few fields"]


@pytest.fixture(scope="module")
def paths(spark):
    rng, rows = random.Random(7), []
    for i in range(500):
        base = rng.choice([0, 40, 70_000, 1 << 33])
        rows.append((i, [2 * (base + rng.randrange(300)) + rng.randrange(2) for _ in range(rng.randrange(6))]))
    return rows, spark.createDataFrame([(i, p, i % 7) for i, p in rows], "aln_id long, path array<long>, block_id long")


@pytest.mark.parametrize("most", [1 << 17, 3])
def test_reads_of_a_node_set(spark, paths, monkeypatch, most):
    """The same reads whether the node set goes to all tasks as bits or is joined with steps; as bits no read is taken apart."""
    monkeypatch.setattr(R, "MOST_WORDS", most)
    rows, df = paths
    rng = random.Random(1)
    ids = {base + rng.randrange(300) for base in (0, 40, 70_000, 1 << 33) for _ in range(260)}
    for nodes in (ids, {7}, set(), {(1 << 33) + 63, (1 << 33) + 64}):
        frame = spark.createDataFrame([(n,) for n in sorted(nodes)] * 2, "node_id long")
        for how in (R.OVERLAPPING, R.CONTAINED):
            test = all if how == R.CONTAINED else any
            got = R.select(df, frame, how)
            assert got.columns == df.columns
            assert sorted(r.aln_id for r in got.collect()) == [i for i, p in rows if p and test(h >> 1 in nodes for h in p)]
            plan = got._jdf.queryExecution().executedPlan().toString()
            if most > 3:
                assert "Generate" not in plan and "Exchange hashpartitioning" not in plan


def test_blocks_by_bitmaps(spark, paths):
    rows, df = paths
    ids = {3, 41, 70_007, 70_008, (1 << 33) + 299}
    steps = df.selectExpr("block_id", "explode(path) AS h").selectExpr("block_id", "h div 2 AS node_id")
    got = R.blocks_with_nodes(R.node_bitmaps(steps, "block_id"), spark.createDataFrame([(n,) for n in ids], "node_id long"))
    want = {}
    for i, p in rows:
        want.setdefault(i % 7, set()).update({h >> 1 for h in p} & ids)
    assert {r.block_id: r.shared for r in got.collect()} == {b: len(s) for b, s in want.items() if s}


def test_one_position_moves_no_steps(spark, monkeypatch):
    """The query of one offset goes to the steps, which stay where they are."""
    from braidlake.plans import queries

    found, real = [], locate.offset_to_position
    monkeypatch.setattr(locate, "offset_to_position", lambda q, steps: found.append(real(q, steps)) or found[-1])
    queries.queries()["context_position"](spark, "/root/testdata/sf0.001")
    plan = found[0]._jdf.queryExecution().executedPlan().toString().split("InMemory")[0]  # what is above the kept steps
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_positions_where_steps_lie(spark):
    """Short paths: queries go to the steps, which are not moved, and find what they find through bins."""
    rng, rows = random.Random(8), []
    for p in range(60):
        at = 0
        for k in range(1, 2 + rng.randrange(70)):
            size = rng.choice([1, 3, 40, 700])
            rows.append((p, k, 2 * rng.randint(1, 9), at, at + size, k % 5))
            at += size
    steps = spark.createDataFrame(rows, "path_handle long, step long, handle long, step_start long, step_end long, offset long")
    steps = steps.repartition(4, "path_handle").persist()
    q = spark.createDataFrame([(i, rng.randrange(70), rng.randrange(9000)) for i in range(900)], "query_id long, path_handle long, path_offset long")
    want = {(i, p, o, k, h, s, e, o - s, v) for i, p, o in map(tuple, q.collect()) for pp, k, h, s, e, v in rows if pp == p and s <= o < e}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = []
        for in_place in (False, True):
            found = locate.offset_to_position(q, steps, in_place)
            got = found.collect()
            assert len(got) == len(want) > 300 and {tuple(r) for r in got} == want
            plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            moved.append(plan.count("Exchange hashpartitioning"))
        assert moved[1] < moved[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        steps.unpersist()
    assert locate.short_paths(steps, 71) and not locate.short_paths(steps, 20)
