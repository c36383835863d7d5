"""Contexts of windows that move over a graph, as a stateful operator: each window keeps the distances that it has settled,
with what they came from, and a move repairs only those that its seeds change.

Moves of any number of windows come as a stream; the state of a window is in Spark's state store, and what a task needs of
the graph is read by ranges of node ids from the stored adjacency of `operators.contexts`. A folder of that adjacency must
be one that tasks can read through pyarrow's file systems.
"""

from __future__ import annotations

import heapq
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from copy import copy

import numpy as np
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from braidlake.operators.contexts import Adjacency
from braidlake.sources.formats import file_system

#: Ranges of node ids that a task holds; the one that was used the longest ago makes way.
HELD = 64
#: Moves that a task remembers, and node sides of the windows that these lead to; all are forgotten if there are more.
MOVES_HELD, SIDES_HELD = 1 << 16, 1 << 19
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SEEDS = "array<struct<node_id:long,side:int,dist:long>>"
CHANGES = "window_id long, move long, inserted array<long>, removed array<long>, settled long"
STATE = "window binary"

Side = tuple[int, int]
Near = Callable[[Side], list[tuple[Side, int]]]


class StoredNodes:
    """The neighbours of a node's side, fetched by ranges."""

    def __init__(self, path: str, width: int):
        self.path, self.width, self.held = path, width, OrderedDict()
        self.beside: dict[Side, list[tuple[Side, int]]] = {}

    def _range(self, k: int) -> dict:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        fs, inner = file_system(self.path)
        folder = f"{inner}/range={k}"
        nodes = {}
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            t = ds.dataset(folder, filesystem=fs, format="parquet").to_table(columns=["node_id", "seq_len", "onward", "back"])
            nodes = {n: (size, on or (), back or ()) for n, size, on, back in zip(*(c.to_pylist() for c in t.columns), strict=True)}
        self.held[k] = nodes
        if len(self.held) > HELD:
            self.held.popitem(last=False)
            self.beside.clear()
        return nodes

    def has(self, node: int) -> bool:
        return node in self._range(node // self.width)

    def near(self, at: Side) -> list[tuple[Side, int]]:
        found = self.beside.get(at)
        if found is None:
            found = self.beside[at] = self._near(at)
        return found

    def _near(self, at: Side) -> list[tuple[Side, int]]:
        node, side = at
        size, onward, back = self._range(node // self.width)[node]
        beyond = [((h >> 1, h & 1), 1) for h in (onward if side else back) if self.has(h >> 1)]
        return [((node, 1 - side), size - 1), *beyond]


class Window:
    """Settled distances of one window: dist by node side, and the side that it came from (a seed came from itself)."""

    def __init__(self):
        self.seeds: dict[Side, int] = {}
        self.dist: dict[Side, int] = {}
        self.came: dict[Side, Side] = {}
        self.bytes: bytes | None = None

    def __copy__(self) -> Window:
        other = Window()
        other.seeds, other.dist, other.came = self.seeds, dict(self.dist), dict(self.came)
        return other

    def content(self) -> tuple:
        return frozenset(self.seeds.items()), frozenset(self.dist.items()), frozenset(self.came.items())

    def _holds(self, node: int) -> bool:
        return (node, 0) in self.dist or (node, 1) in self.dist

    def move(self, seeds: dict[Side, int], near: Near, limit: int) -> tuple[list[int], list[int], int]:
        """(inserted nodes, removed nodes, sides that were settled anew). Moves, both ways, cost the same."""
        self.bytes = None
        gone = [s for s, d in self.seeds.items() if self.came.get(s) == s and seeds.get(s, d + 1) > d]
        lost: set[Side] = set()
        while gone:  # all that came from a seed that has gone; those are neighbours of what they came from
            at = gone.pop()
            if at not in lost:
                lost.add(at)
                gone += [n for n, _ in near(at) if n not in lost and self.came.get(n) == at]
        held = {node: True for node, _ in lost}
        for at in lost:
            del self.dist[at], self.came[at]
        heap = [(d, s, s) for s, d in seeds.items()]
        for at in lost:
            heap += [(self.dist[n] + w, at, n) for n, w in near(at) if n in self.dist and self.dist[n] + w <= limit]
        heapq.heapify(heap)
        settled = 0
        while heap:
            d, at, source = heapq.heappop(heap)
            if at in self.dist and self.dist[at] <= d:
                continue
            held.setdefault(at[0], self._holds(at[0]))
            self.dist[at], self.came[at] = d, source
            settled += 1
            for n, w in near(at):
                if d + w <= limit and (n not in self.dist or d + w < self.dist[n]):
                    heapq.heappush(heap, (d + w, n, at))
        self.seeds = seeds
        now = {node: self._holds(node) for node in held}
        return sorted(n for n in now if now[n] and not held[n]), sorted(n for n in now if held[n] and not now[n]), settled

    def as_row(self) -> tuple:
        split = lambda sides: [list(c) for c in zip(*sides, strict=True)] or [[], []]
        at = list(self.dist)
        return (*split(self.seeds), list(self.seeds.values()), *split(at), [self.dist[a] for a in at], *split([self.came[a] for a in at]))

    def packed(self) -> bytes:
        """The row as little-endian 64-bit numbers, after the lengths of its arrays. A window in `Moves` is packed once."""
        if self.bytes is None:
            row = self.as_row()
            self.bytes = np.array([*map(len, row), *(v for c in row for v in c)], "<i8").tobytes()
        return self.bytes

    @classmethod
    def of_packed(cls, data: bytes) -> Window:
        numbers, at, row = np.frombuffer(data, "<i8").tolist(), 8, []
        for n in numbers[:8]:
            row.append(numbers[at : at + n])
            at += n
        return cls.of_row(row)

    @classmethod
    def of_row(cls, row: Iterable) -> Window:
        seeds, sides, seed_dists, nodes, at, dists, from_nodes, from_sides = row
        window, places = cls(), list(zip(nodes, at, strict=True))
        window.seeds = dict(zip(zip(seeds, sides, strict=True), seed_dists, strict=True))
        window.dist = dict(zip(places, dists, strict=True))
        window.came = dict(zip(places, zip(from_nodes, from_sides, strict=True), strict=True))
        return window


class Moves:
    """Moves of windows over one graph. What a move does depends on the window and its new seeds alone, so a move that
    another window has made is looked up, and windows of equal content are one, which nobody changes."""

    def __init__(self, near: Near, limit: int):
        self.near, self.limit = near, limit
        self.clear()

    def clear(self) -> None:
        self.windows: dict[tuple, Window] = {}
        self.made: dict[tuple, tuple] = {}
        self.sides = 0

    def same(self, window: Window) -> Window:
        known = self.windows.setdefault(window.content(), window)
        if known is window:
            self.sides += len(window.dist) + len(window.seeds)
        return known

    def move(self, window: Window, seeds: dict[Side, int]) -> tuple[Window, list[int], list[int], int]:
        """The window after the move, and what `Window.move` says of it."""
        key = window, frozenset(seeds.items())
        found = self.made.get(key)
        if found is None:
            if len(self.made) >= MOVES_HELD or self.sides >= SIDES_HELD:
                self.clear()
            after = copy(window)
            changes = after.move(seeds, self.near, self.limit)
            found = self.made[key] = (self.same(after), *changes)
        return found


class Slide(StatefulProcessor):
    def __init__(self, path: str, width: int, limit: int):
        self.path, self.width, self.limit = path, width, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state, self.stored = handle.getValueState("window", STATE), StoredNodes(self.path, self.width)
        self.moves = Moves(self.stored.near, self.limit)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        window = self.moves.same(Window.of_packed(held[0]) if held is not None else Window())
        for _, move, nodes, sides, dists in sorted(rows, key=lambda r: r[1]):
            seeds: dict[Side, int] = {}
            for at, dist in zip(zip(nodes or (), sides or (), strict=True), dists or (), strict=True):
                if self.stored.has(at[0]):
                    seeds[at] = min(dist, seeds.get(at, dist))
            window, inserted, removed, settled = self.moves.move(window, seeds)
            if inserted or removed:
                yield Row(window_id=key[0], move=move, inserted=inserted, removed=removed, settled=settled)
        if window.dist:
            self.state.update((window.packed(),))
        elif held is not None:  # a window without seeds is over
            self.state.clear()

    def close(self) -> None:
        self.stored.held.clear()
        self.stored.beside.clear()
        self.moves.clear()


def slide_windows(moves: DataFrame, adjacency: Adjacency, limit: int) -> DataFrame:
    """(window_id, move, seeds) to (window_id, move, node_id, change, settled): what each move of a window brings into its
    context and what leaves it. seeds are (node_id, side, dist) as `contexts` takes them.

    moves is a stream, or a table as one batch. A window's moves are taken in the order of `move` within a batch, batches as
    they come; those of one batch are held together, so a stream bounds them by its trigger. No seeds (or null) end a window.
    """
    moves.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    moves.sparkSession.streams.active  # noqa: B018 - a session that has had no stream has nobody yet who keeps track of state stores
    rows = moves.selectExpr("cast(window_id as long) window_id", "cast(move as long) move", f"cast(seeds as {SEEDS}) seeds")
    rows = rows.select("window_id", "move", *[F.col(f"seeds.{c}").alias(c) for c in ("node_id", "side", "dist")])
    changes = rows.groupBy("window_id").transformWithState(Slide(adjacency.path, adjacency.width, limit), CHANGES, "Append", "None")
    with_name = lambda c: F.transform(c, lambda n: F.struct(n.alias("node_id"), F.lit(c).alias("change")))
    each = [with_name(c) for c in ("inserted", "removed")]
    return changes.select("window_id", "move", F.explode(F.concat(*each)).alias("x"), "settled").select("window_id", "move", "x.node_id", "x.change", "settled")
