"""Chains without a component in one task, against dominators on the driver."""

import random

import pytest

from braidlake.operators import chains, traverse
from braidlake.schema import Graph


def made(spark, pairs):
    both = {(a, b) for a, b in pairs} | {(b ^ 1, a ^ 1) for a, b in pairs}
    nodes = sorted({h >> 1 for p in both for h in p})
    edges = spark.createDataFrame(sorted(both), "src long, dst long")
    frame = spark.createDataFrame([(n, "A", 1) for n in nodes], "node_id long, sequence string, seq_len long")
    none = [spark.createDataFrame([], kind) for kind in ("path_handle long, step long, handle long", "path_handle long", "handle long, next long", "key string, value string")]
    return Graph(frame, edges, *none)


def nested(rng, at, a, b, depth):
    """Edges of a random nest of chains and bubbles from handle a to handle b; at: the next free node."""
    if depth == 0 or rng.random() < 0.2:
        return [(a, b)], at
    out, here = [], a
    for k in range(rng.randrange(1, 4)):
        last = k == 2 or rng.random() < 0.4
        there, at = (b, at) if last else (2 * at + rng.randrange(2), at + 1)
        for _ in range(rng.randrange(1, 3)):
            inner = 2 * at + rng.randrange(2)
            part, at = nested(rng, at + 1, here, inner, depth - 1)
            more, at = nested(rng, at, inner, there, depth - 1)
            out += part + more
        here = there
        if last:
            return out, at
    return [*out, (here, b)], at


def layered(rng, at, n, width, reach):
    """A random graph without cycles between two tips; not made of nested bubbles."""
    rows, out = [[2 * at]], []
    at += 1
    for _ in range(n):
        rows.append([2 * (at + k) for k in range(rng.randrange(1, width + 1))])
        at += len(rows[-1])
    rows.append([2 * at])
    for i, row in enumerate(rows[:-1]):
        for h in row:
            out += [(h, rng.choice(rows[min(len(rows) - 1, i + rng.randrange(1, reach + 1))])) for _ in range(rng.randrange(1, 3))]
        out += [(rng.choice(row), h) for h in rows[i + 1]]
    return out, at + 1


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_dominators(spark, seed):
    """Nested bubbles, graphs without cycles, with back edges, turns and loops, in one graph of many components."""
    rng, pairs, at = random.Random(seed), [], 1
    for kind in range(14):
        if kind % 2:
            part, at = layered(rng, at, rng.randrange(3, 12), 3, 3)
        else:
            end = 2 * at + 2
            part, at = nested(rng, at + 2, 2 * at, end, 3)
        inner = [h for p in part for h in p]
        if kind % 7 > 3:
            part += [(rng.choice(inner), rng.choice(inner) ^ rng.randrange(2)) for _ in range(2)]
        if kind % 5 == 0:
            part.append((inner[1], inner[1]))
        pairs += part
    graph = made(spark, pairs)
    want = traverse.discover_chains(traverse.adjacency(graph))
    assert len(want) > 20 and (seed or sorted(map(tuple, chains.discover_chains(graph).collect())) == want)
    assert sorted(map(tuple, chains.discover_chains(graph, 0).collect())) == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Hundreds of bubbles in a row are contracted to one edge; no level is walked one after the other."""
    pairs = [p for k in range(300) for p in ((6 * k + 2, 6 * k + 4), (6 * k + 2, 6 * k + 6), (6 * k + 4, 6 * k + 8), (6 * k + 6, 6 * k + 8))]
    graph, seen, levels = made(spark, pairs), [], chains._levels
    monkeypatch.setattr(chains, "_levels", lambda edges, starts: seen.append(edges.count()) or levels(edges, starts))
    assert sorted(map(tuple, chains.discover_chains(graph, 0).collect())) == sorted(p for k in range(300) for p in ((6 * k + 2, 6 * k + 8), (6 * k + 9, 6 * k + 3)))
    assert seen == [1]
    core, rounds = chains.contract(spark.createDataFrame(pairs, "src long, dst long"))
    assert core.count() == 1 and len(rounds) < 25


def test_no_chains(spark):
    for pairs in ([], [(2, 4), (4, 6), (4, 8)], [(2, 4), (4, 2)], [(2, 3)]):
        graph = made(spark, pairs)
        assert sorted(map(tuple, chains.discover_chains(graph, 0).collect())) == traverse.discover_chains(traverse.adjacency(graph))
