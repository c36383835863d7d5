"""Contexts of many queries at once, against a search from each on the driver."""

import random

import pytest

from braidlake.operators import contexts, traverse
from braidlake.schema import Graph


@pytest.fixture(scope="module")
def graph(spark):
    """A ring of 400 nodes of unequal lengths with chords, turns and a hub that a tenth of all nodes meet."""
    rng, n = random.Random(3), 400
    pairs = {(2 * v, 2 * (v % n + 1)) for v in range(1, n + 1)} | {(2 * rng.randint(1, n) + rng.randrange(2), 2 * rng.randint(1, n) + rng.randrange(2)) for _ in range(80)}
    pairs |= {(2 * v, 2 * 77 + 1) for v in range(1, n, 10)}
    pairs |= {(b ^ 1, a ^ 1) for a, b in pairs}
    nodes = spark.createDataFrame([(v, "A", 1 + rng.randrange(9)) for v in range(1, n + 1)], "node_id long, sequence string, seq_len long")
    none = [spark.createDataFrame([], kind) for kind in ("path_handle long, step long, handle long", "path_handle long", "handle long, next long", "key string, value string")]
    return Graph(nodes.cache(), spark.createDataFrame(sorted(pairs), "src long, dst long").cache(), *none)


@pytest.mark.parametrize(("width", "entries"), [(16, 30), (64, 20_000), (4_096, 100)])
def test_a_thousand_queries(spark, graph, monkeypatch, width, entries):
    monkeypatch.setattr(contexts, "WIDTH", width)
    monkeypatch.setattr(contexts, "ENTRIES", entries)
    rng, seeds = random.Random(width), []
    for q in range(1000):
        node = 77 if q % 3 == 0 else rng.randint(1, 400)
        seeds += [(q, node, side, rng.randrange(4)) for side in (0, 1)] + [(q, rng.randint(1, 400), 0, 40)] * (q % 50 == 0)
    met, near = [], contexts.Adjacency.near
    monkeypatch.setattr(contexts.Adjacency, "near", lambda self, ranges: met.append(len(ranges)) or near(self, ranges))
    got = contexts.contexts(graph, spark.createDataFrame(seeds, "query_id long, node_id long, side int, dist long"), 11).collect()
    whole, want = traverse.adjacency(graph), {}
    for q in range(1000):
        want |= {(q, n): d for n, d in whole.context([s[1:] for s in seeds if s[0] == q], 11).items()}
    assert {(r.query_id, r.node_id): r.dist for r in got} == want and len(got) == len(want)
    assert len(met) <= 16


def test_rounds_read_the_ranges_that_they_are_in(spark, graph, monkeypatch):
    monkeypatch.setattr(contexts, "WIDTH", 16)
    near = contexts.Adjacency(graph)
    all_, read = len(near.near(list(range(30))).inputFiles()), []
    plain = contexts.Adjacency.near
    monkeypatch.setattr(contexts.Adjacency, "near", lambda self, ranges: read.append(plain(self, ranges)) or read[-1])
    seeds = spark.createDataFrame([(5, 120, 0, 0), (5, 120, 1, 0), (6, 999, 0, 0)], "query_id long, node_id long, side int, dist long")
    assert {r.query_id for r in contexts.contexts(graph, seeds, 5, near).collect()} == {5}
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in read]
    assert len(read) >= 2 and all("PartitionFilters: [range" in p or "PartitionFilters: [isnotnull(range" in p for p in plans)
    ranges = [sorted(r.range for r in df.select("range").distinct().collect()) for df in read]
    assert ranges[0] == [7] and all(len(r) < all_ for r in ranges)
    near.drop()
    assert contexts.contexts(graph, seeds.where("false"), 6).count() == 0
