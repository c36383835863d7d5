"""Visits in order and paths as positions, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from braidlake.operators import visits


def plain_offsets(sequences):
    """{(seq, k): (handle, offset)} of {seq: [handle]} by comparing whole reversed contexts."""
    at = {}
    for seq, path in sequences.items():
        for k, h in enumerate(path):
            at.setdefault(h, []).append(([*((x, 0) for x in path[:k][::-1]), (-1, seq)], seq, k))
    return {(seq, k): (h, i) for h, rows in at.items() for i, (_, seq, k) in enumerate(sorted(rows))}


def made(kind):
    rng = random.Random(kind)
    if kind == "equal":
        return {s: [2, 4, 6, 4, 6, 8] * 3 for s in range(6)}
    if kind == "nested":
        whole = [rng.choice([2, 4, 5]) for _ in range(40)]
        return {s: whole[s % 7 : 40 - s % 5] for s in range(15)}
    if kind == "one":
        return {3: [2] * 37, 5: [2] * 12, 9: [2], 10: [3]}
    return {s: [rng.randrange(2, 9) for _ in range(rng.randrange(1, 30))] for s in range(25)}


@pytest.mark.parametrize("kind", ["equal", "nested", "one", "random"])
def test_offsets_jumps_and_restored_paths(spark, kind):
    sequences = made(kind)
    df = spark.createDataFrame([(s, k, h) for s, path in sequences.items() for k, h in enumerate(path)], "seq long, idx long, handle long")
    found = visits.visit_offsets(df).checkpoint()
    want = plain_offsets(sequences)
    assert {(r.seq, r.idx): (r.handle, r.offset) for r in found.collect()} == want
    following = {(want[s, k], want[s, k + 1]) for s, k in want if (s, k + 1) in want}
    assert {((r.handle, r.offset), (r.next_handle, r.next_offset)) for r in visits.successors(found).collect()} == following
    levels, rows = visits.levels_of(found), visits.jumps(found).cache()
    per_level = {r.level: r["count"] for r in rows.groupBy("level").count().collect()}
    assert 2 ** (levels - 1) < max(map(len, sequences.values())) <= 2**levels if levels else not per_level
    assert all(n <= sum(1 for s, k in want if k % (2 << level) == 0) for level, n in per_level.items())
    assert sum(per_level.values()) <= len(want)
    starts = found.where("idx = 0").select(F.col("seq").alias("aln_id"), "handle", "offset")
    assert {r.aln_id: r.path for r in visits.restore(starts, rows, levels, ["aln_id"]).collect()} == sequences
    some = visits.restore(starts.where("aln_id % 2 = 1"), rows, levels, ["aln_id"], explode=True).collect()
    assert sorted((r.aln_id, r.pos, r.handle) for r in some) == sorted((s, k, h) for s, path in sequences.items() if s % 2 for k, h in enumerate(path))
    rows.unpersist()


def test_no_join_meets_all_visits(spark):
    """Each level is at most half of the visits, and paths that aren't wanted are met by no known visit."""
    sequences = {s: [2 * (1 + (s * 7 + k * 3) % 50) for k in range(64)] for s in range(40)}
    df = spark.createDataFrame([(s, k, h) for s, path in sequences.items() for k, h in enumerate(path)], "seq long, idx long, handle long")
    found = visits.visit_offsets(df).checkpoint()
    sizes = {r.level: r["count"] for r in visits.jumps(found).groupBy("level").count().collect()}
    assert sizes == {level: 40 * (64 >> (level + 1)) for level in range(6)}


def test_both_directions(spark):
    steps = spark.createDataFrame([(1, k, h) for k, h in enumerate([2, 5, 2], 1)] + [(0, k, h) for k, h in enumerate([3, 4, 3], 1)], "path_handle long, step long, handle long")
    sequences = {2: [2, 5, 2], 3: [3, 4, 3], 0: [3, 4, 3], 1: [2, 5, 2]}
    want = plain_offsets(sequences)
    got = {(r.path_handle, r.step): (r.offset, r.flip_offset) for r in visits.with_offsets(steps).collect()}
    assert got == {(p, k): (want[2 * p, k - 1][1], want[2 * p + 1, 3 - k][1]) for p in (0, 1) for k in (1, 2, 3)}
    assert visits.with_offsets(steps.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["nested", "one", "random"])
def test_sequences_longer_than_a_bin(spark, kind, monkeypatch):
    """Prefixes that are named in several bins, and classes that are ranked in several bins of sequences."""
    monkeypatch.setattr(visits, "STEPS_AT_ONCE", 5)
    monkeypatch.setattr(visits, "SEQUENCES_AT_ONCE", 4)
    sequences = made(kind)
    df = spark.createDataFrame([(s, k - 3, h) for s, path in sequences.items() for k, h in enumerate(path)], "seq long, idx long, handle long")
    assert {(r.seq, r.idx + 3): (r.handle, r.offset) for r in visits.visit_offsets(df).collect()} == plain_offsets(sequences)


def test_rounds_write_classes_and_not_visits(spark, monkeypatch):
    """Copies of a path add visits to its classes, but no rows to the rounds."""
    seen, places = [], visits._places
    monkeypatch.setattr(visits, "_places", lambda classes: seen.append(classes.count()) or places(classes))
    for copies in (2, 30):
        rows = [(s, k, 2 * h) for s in range(copies) for k, h in enumerate([1, 2, 3, 1, 2, 3, 4])]
        assert visits.visit_offsets(spark.createDataFrame(rows, "seq long, idx long, handle long")).count() == 7 * copies
    assert seen == [7, 7]


@pytest.fixture(scope="module")
def reads(spark):
    """Reads over few nodes, many of one path, some without a path."""
    from braidlake.functions import gaf

    rng = random.Random(9)
    common = [rng.randrange(1, 40) for _ in range(60)]
    lines = []
    for i in range(400):
        a = rng.randrange(50)
        path = common[a : a + 1 + rng.randrange(10)] if i % 3 else [rng.randrange(1, 40) for _ in range(rng.randrange(1, 70))]
        text = "".join(rng.choice("><") + str(x) for x in path) if i % 5 == 1 else "".join(f">{x}" for x in path)
        n = len(path)
        lines.append((i, "\t".join(map(str, [f"r{i}", n, 0, n, "+", "*" if i % 29 == 0 else text, n, 0, n, n, n, 60, f"cs:Z::{n}"]))))
    return gaf.parse_lines(spark.createDataFrame(lines, "aln_id long, value string")).drop("error").cache()


def test_store_of_start_positions(spark, reads, tmp_path):
    """The same reads, blocks, ranges and nodes as a store of whole paths; a range of blocks follows its own reads only."""
    from braidlake.sources import store

    stores = {}
    for positions in (False, True):
        path = f"{tmp_path}/{positions}"
        store.write_alignments(reads, path, store.AlignmentParams(block_size=30, start_positions=positions))
        stores[positions] = store.open_alignments(spark, path)
    plain, kept = stores[False], stores[True]
    assert kept.params.start_positions and not plain.params.start_positions and sorted(kept.alignments.columns) == sorted(plain.alignments.columns)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for table in ("alignments", "blocks", "nodes"):
        assert rows(getattr(kept, table)) == rows(getattr(plain, table))
    assert rows(kept.rows(2, 5)) == rows(plain.rows(2, 5))
    clusters = spark.createDataFrame([(3, 4)], "cluster_min long, cluster_max long")
    assert rows(kept.meeting(clusters)) == rows(plain.meeting(clusters))
    assert "path" not in spark.read.parquet(f"{tmp_path}/True/alignments").columns
    sizes = {p: {t: s.size(t) for t in ("alignments", *(["jumps"] if p else []))} for p, s in stores.items()}
    assert all(n > 0 for of in sizes.values() for n in of.values())
    plan = kept.rows(2, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("block_id") > 4 and all("block_id#" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Filter") and "start_handle" in line)


def test_graph_store_orders_walks_by_visits(spark, tmp_path):
    """Walks of a stored graph come by start handle and place of the visit, as plain contexts say."""
    from braidlake.operators import walks
    from braidlake.operators.locate import step_offsets
    from braidlake.schema import Graph
    from braidlake.sources import store

    rng = random.Random(4)
    paths = {p: [2 * (k + 1) if k % 2 else 2 * (100 + 3 * k + rng.randrange(2)) + (rng.random() < 0.2) for k in range(12)] for p in range(9)}
    steps = spark.createDataFrame([(p, k, h) for p, path in paths.items() for k, h in enumerate(path)], "path_handle long, step long, handle long")
    nodes = steps.selectExpr("handle div 2 as node_id").distinct().selectExpr("node_id", "'AC' as sequence", "2L as seq_len")
    names = spark.createDataFrame([(p, f"s{p}", "c", 0, 0, False, 24) for p in paths], "path_handle long, sample string, contig string, haplotype long, fragment long, is_indexed boolean, path_len long")
    empty = spark.createDataFrame([], "handle long, next long"), spark.createDataFrame([], "key string, value string")
    graph = Graph(nodes, walks.edges_of_steps(steps), step_offsets(steps, nodes), names, *empty)
    store.write_graph(graph, f"{tmp_path}/g")
    opened = store.open_graph(spark, f"{tmp_path}/g")
    assert {"offset", "flip_offset"} <= set(opened.steps.columns) & set(opened.steps_by_node.columns)
    inside = opened.nodes.where("node_id between 3 and 9 or node_id between 109 and 124")
    found = walks.walks(walks.islands(opened.steps_by_node, inside.select("node_id")))
    rows = walks.named(found, None, None, None, None, None).orderBy("haplotype").collect()
    sequences = {2 * p: path for p, path in paths.items()} | {2 * p + 1: [h ^ 1 for h in path[::-1]] for p, path in paths.items()}
    place = plain_offsets(sequences)
    starts = [next((place[s, k]) for s in (2 * r.path_handle, 2 * r.path_handle + 1) for k in range(12) if sequences[s][k : k + len(r.walk)] == r.walk and (s % 2 == 0) == (r.walk == paths[r.path_handle][r.first_step : r.first_step + len(r.walk)])) for r in rows]
    assert len(rows) >= 9 and starts == sorted(starts) and [r.offset for r in rows] == [o for _, o in starts]


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_sampling_over_many_bins(spark, monkeypatch, at_once):
    """Equal to choosing one after the other, whatever the bins; interval 0 takes every step."""
    from braidlake.operators import locate

    monkeypatch.setattr(locate, "STEPS_AT_ONCE", at_once)
    rng, rows, lengths = random.Random(at_once), [], {}
    for p in range(12):
        at = 0
        for k in range(rng.choice([1, 2, 60, 150])):
            size = rng.choice([1, 1, 2, 5, 40])
            rows.append((p, k, 2 * rng.randint(1, 99), at, at + size))
            at += size
        lengths[p] = at
    steps = spark.createDataFrame(rows, "path_handle long, step long, handle long, step_start long, step_end long")
    paths = spark.createDataFrame([(p, p != 5) for p in lengths], "path_handle long, is_indexed boolean")
    for interval in (0, 1, 3, 17, 1000):
        want, due = set(), {}
        for p, k, h, start, _ in rows:
            if p != 5 and start >= due.get(p, 0):
                want.add((p, start, h, k))
                due[p] = start + interval
        got = [tuple(r) for r in locate.reference_index(steps, paths, interval).collect()]
        assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError, match="negative"):
        locate.reference_index(steps, paths, -1)
    assert locate.reference_index(steps.where("false"), paths, 5).count() == 0


@pytest.mark.parametrize("kind", ["equal", "nested", "one", "random", "wide"])
def test_parts_of_sequences_and_rounds_agree(spark, monkeypatch, kind):
    """Sequences that are ranked as arrays, in parts of a few, and in rounds; handles that lie far apart."""
    wide = {s: [random.Random(s % 9).choice([0, 1, 300, 1 << 20, (1 << 62) + 5]) for _ in range(20 + s % 3)] for s in range(-4, 30)}
    sequences = wide if kind == "wide" else made(kind)
    df = spark.createDataFrame([(s, k - 3, h) for s, path in sequences.items() for k, h in enumerate(path)], "seq long, idx long, handle long")
    want = plain_offsets(sequences)
    for name, value in (("VISITS_AT_ONCE", 100), ("SEQUENCES_AT_ONCE", 2), ("HANDLES_AT_ONCE", 0)):
        monkeypatch.setattr(visits, name, value)
        assert {(r.seq, r.idx + 3): (r.handle, r.offset) for r in visits.visit_offsets(df).collect()} == want


def test_differences_are_ordered_as_bytes():
    rng = random.Random(2)
    numbers = sorted({sign * (x + d) for sign in (1, -1) for d in (-1, 0, 1) for x in [0, 100, *(1 << k for k in range(62)), *(rng.randrange(1 << 62) for _ in range(99))]} | {(1 << 63) - 1, 1 - (1 << 63)})
    coded = [visits._difference(d) for d in numbers]
    assert coded == sorted(coded) and len(set(coded)) == len(coded) and all(x[0] > 0 for x in coded)
    assert all(not b.startswith(a) for a, b in zip(coded, coded[1:], strict=False))


def _shuffled(spark, run):
    """(bytes shuffled and spilled, bytes in the checkpoint folder) by a run."""
    import pathlib

    from braidlake.operators._shared import ensure_checkpoint

    ensure_checkpoint(spark)
    sc = spark.sparkContext
    none, folder = sc._gateway.new_array(spark._jvm.double, 0), pathlib.Path(sc.getCheckpointDir().removeprefix("file:"))

    def now():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
        own = sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).diskBytesSpilled() for i in range(stages.size()))
        return own, sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    before = now()
    run()
    return [b - a for a, b in zip(before, now(), strict=True)]


def test_visits_write_little(spark):
    """Places of short paths go through no checkpoint, and shuffle a few bytes a visit."""
    rng, n = random.Random(5), 3000
    rows = [(p, k, 2 * (3 * k + rng.randrange(2) if k % 2 else 3 * k)) for p in range(n) for k in range(40)]
    steps = spark.createDataFrame(rows, "path_handle long, step long, handle long").persist()
    assert steps.count() == 40 * n
    shuffled, kept = _shuffled(spark, lambda: visits.with_offsets(steps).write.format("noop").mode("overwrite").save())
    steps.unpersist()
    assert shuffled < 60 * 2 * 40 * n and kept == 0


def test_successors_in_a_row(spark):
    """Visits that lie by sequence meet the next one without moving; gaps end a run."""
    rng = random.Random(6)
    rows = [(s, k, rng.randrange(9), rng.randrange(99)) for s in range(20) for k in range(-3, rng.randrange(30)) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "seq long, idx long, handle long, offset long").repartition(4, "seq").persist()
    at = {(s, k): v for s, k, *v in rows}
    want = sorted((*at[s, k], *at[s, k + 1]) for s, k in at if (s, k + 1) in at)
    for in_a_row in (False, True):
        assert sorted(map(tuple, visits.successors(df, in_a_row).collect())) == want
    shuffled, _ = _shuffled(spark, lambda: visits.successors(df, True).write.format("noop").mode("overwrite").save())
    assert shuffled == 0
    df.unpersist()
