"""Windows that keep their distances, against a search from the seeds of each move."""

import heapq
import random

from pyspark.sql import functions as F

from braidlake.operators.contexts import Adjacency, contexts
from braidlake.schema import Graph
from braidlake.streaming import windows
from braidlake.streaming.windows import Window, slide_windows


def made(seed: int, n: int) -> tuple[dict, set]:
    rng = random.Random(seed)
    sizes = {i: rng.choice([1, 1, 2, 5]) for i in range(1, n + 1)}
    edges = set()
    for i in range(1, n):
        for j in {i + 1, min(n, i + rng.randrange(1, 4)), rng.randrange(max(1, i - 3), i + 1)}:
            src, dst = 2 * i + (rng.random() < 0.1), 2 * j + (rng.random() < 0.1)
            edges |= {(src, dst), (dst ^ 1, src ^ 1)}
    return sizes, edges


def neighbours(sizes, edges):
    def near(at):
        node, side = at
        return [((node, 1 - side), sizes[node] - 1), *(((d >> 1, d & 1), 1) for s, d in edges if s == 2 * node + 1 - side)]

    return near


def search(seeds, near, limit):
    heap, dist = [(d, at) for at, d in seeds.items()], {}
    heapq.heapify(heap)
    while heap:
        d, at = heapq.heappop(heap)
        if at not in dist:
            dist[at] = d
            for n, w in near(at):
                if d + w <= limit:
                    heapq.heappush(heap, (d + w, n))
    return dist


def test_moves_are_repaired_as_if_searched_anew():
    for seed in range(30):
        near, rng = neighbours(*made(seed, 40)), random.Random(seed)
        window = Window()
        for _ in range(25):
            lo = rng.randrange(1, 38)
            seeds = {(n, s): rng.choice([0, 0, 3]) for n in range(lo, min(40, lo + rng.randrange(4))) for s in (0, 1) if rng.random() < 0.9}
            if rng.random() < 0.3:
                seeds |= {k: v for k, v in window.seeds.items() if rng.random() < 0.7}
            before = {n for n, _ in window.dist}
            inserted, removed, _ = window.move(seeds, near, 6)
            after = search(seeds, near, 6)
            assert window.dist == after
            assert inserted == sorted({n for n, _ in after} - before) and removed == sorted(before - {n for n, _ in after})
            again = Window.of_row(window.as_row())
            assert (again.seeds, again.dist, again.came) == (window.seeds, window.dist, window.came)


def test_a_long_window_settles_what_its_ends_reach():
    sizes = {i: 2 for i in range(1, 1_001)}
    edges = {e for i in range(1, 1_000) for e in ((2 * i, 2 * i + 2), (2 * i + 3, 2 * i + 1))}
    near, window = neighbours(sizes, edges), Window()
    at = lambda lo: {(n, s): 0 for n in range(lo, lo + 400) for s in (0, 1)}
    assert window.move(at(100), near, 8)[2] >= 800
    inserted, removed, settled = window.move(at(101), near, 8)
    assert inserted == [504] and removed == [96] and settled < 40
    assert window.move(at(101), near, 8) == ([], [], 0)
    assert len(window.move({}, near, 8)[1]) == 408 and window.dist == {}


def test_a_move_that_another_window_made_is_looked_up(monkeypatch):
    """A task's searches are those of its different moves; what it remembers is bounded, and forgetting changes nothing."""
    near, asked = neighbours(*made(5, 60)), []
    seeds = lambda m: {(n, s): 0 for n in range(1 + 5 * m, 11 + 5 * m) for s in (0, 1)}
    alone, want = Window(), []
    for m in range(8):
        want.append(alone.move(seeds(m), near, 6))
    moves = windows.Moves(lambda at: asked.append(at) or near(at), 6)
    for w in range(20):
        window, got = moves.same(Window()), []
        for m in range(8):
            window, *changes = moves.move(window, seeds(m))
            got.append(tuple(changes))
        assert got == want and window.dist == alone.dist and window.came == alone.came
        assert Window.of_packed(window.packed()).content() == window.content()
        once = once if w else len(asked)
    assert len(asked) == once
    monkeypatch.setattr(windows, "MOVES_HELD", 3)
    few = windows.Moves(near, 6)
    for _ in range(3):
        window = few.same(Window())
        for m in range(8):
            window, *changes = few.move(window, seeds(m))
            assert tuple(changes) == want[m] and len(few.made) <= 3


def test_a_stream_of_moves(spark, tmp_path, monkeypatch):
    from braidlake.operators import contexts as C

    monkeypatch.setattr(C, "WIDTH", 7)
    sizes, edges = made(3, 40)
    nodes = spark.createDataFrame([(n, "A" * k, k) for n, k in sizes.items()], "node_id long, sequence string, seq_len long")
    graph = Graph(nodes, spark.createDataFrame(sorted(edges), "src long, dst long"), *[spark.createDataFrame([], "x long")] * 4)
    rng, rows = random.Random(1), []
    for w in range(4):
        for m in range(6):
            lo = 1 + 4 * w + 3 * m
            rows.append((w, m, [(n, s, 0) for n in range(lo, lo + 5) for s in (0, 1)] + [(999, 0, 0)]))
    rows += [(0, 6, []), (1, 6, None)]
    kind = "window_id long, move long, seeds array<struct<node_id:long,side:int,dist:long>>"
    near = Adjacency(graph)
    for i, half in enumerate(([r for r in rows if r[1] < 2], [r for r in rows if 2 <= r[1] < 4], [r for r in rows if r[1] >= 4])):
        rng.shuffle(half)
        spark.createDataFrame(half, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        moves = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        made_ = slide_windows(moves, near, 5).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        made_.start(f"{tmp_path}/out").awaitTermination()
        assert i == 2 or spark.read.parquet(f"{tmp_path}/out").agg(F.max("move")).first()[0] <= 2 * i + 1
    got = [tuple(r)[:4] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    expected, step = [], neighbours(sizes, edges)
    for w in range(4):
        have = set()
        for _, m, seeds in sorted((r for r in rows if r[0] == w), key=lambda r: r[1]):
            now = {n for n, _ in search({(n, s): d for n, s, d in seeds or [] if n in sizes}, step, 5)}
            expected += [(w, m, n, "inserted") for n in now - have] + [(w, m, n, "removed") for n in have - now]
            have = now
    assert sorted(got) == sorted(expected) and len(expected) > 100
    one = [(0, n, s, 0) for n in (5, 6) for s in (0, 1)]
    many = contexts(graph, spark.createDataFrame(one, "query_id long, node_id long, side int, dist long"), 5, near)
    assert {r.node_id for r in many.collect()} == {n for n, _ in search({(n, s): 0 for _, n, s, _ in one}, step, 5)}
    batch = slide_windows(spark.createDataFrame(rows, kind), near, 5)
    assert sorted(tuple(r)[:4] for r in batch.collect()) == sorted(expected)
    near.drop()
