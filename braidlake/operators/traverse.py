"""Traversals in two tiers.

Tier 1 walks on the driver and fetches nodes, edges and links by ranges of node ids as it meets them: a query touches a few
thousand nodes, most of them near each other, whatever the size of the graph, and rounds of joins would cost seconds each.
Tier 2 stays in DataFrames, a frontier a round, each written to the checkpoint folder; it takes any number of nodes and of
queries at once. A traversal that meets too many ranges goes on in tier 2. Both give equal results.
"""

from __future__ import annotations

import heapq
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.operators._shared import ensure_checkpoint
from braidlake.schema import Graph, canonical_snarl, encode, is_reverse, node_of

#: Rows that may come to the driver at once, node ids fetched together, and ranges that tier 1 fetches for one query.
MAX_EDGES, WIDTH, RANGES = 2_000_000, 4_096, 64


class LimitExceeded(ValueError):
    pass


class Spread(Exception):
    """A traversal meets more of the graph than the driver should hold."""


class Adjacency:
    """The graph on the driver: successors by handle, node lengths, chain links."""

    def __init__(self, edges, lengths, links=()):
        self.next: dict[int, list[int]] = {}
        for src, dst in edges:
            if dst:
                self.next.setdefault(src, []).append(dst)
        for out in self.next.values():
            out.sort()
        self.length, self.link = dict(lengths), dict(links)

    def successors(self, handle: int) -> list[int]:
        return self.next.get(handle, [])

    def length_of(self, node: int) -> int:
        return self.length[node]

    def link_of(self, handle: int) -> int | None:
        return self.link.get(handle)

    def has_links(self) -> bool:
        return bool(self.link)

    def context(self, seeds: list[tuple[int, int, int]], limit: int) -> dict[int, int]:
        """Nodes within `limit` of the seeds (node, side, distance), with their least distance. Seeds are always in."""
        heap, done, best = [(d, n, s) for n, s, d in seeds], set(), {}
        heapq.heapify(heap)
        while heap:
            d, n, s = heapq.heappop(heap)
            if (n, s) in done:
                continue
            done.add((n, s))
            best.setdefault(n, d)
            across = d + self.length_of(n) - 1
            if across <= limit and (n, 1 - s) not in done:
                heapq.heappush(heap, (across, n, 1 - s))
            if d + 1 <= limit:
                for h in self.successors(2 * n + (0 if s == 1 else 1)):  # leaving by this side
                    if (h >> 1, h & 1) not in done:
                        heapq.heappush(heap, (d + 1, h >> 1, h & 1))
        return best

    def between(self, start: int, end: int, have: set[int] = frozenset(), limit: int | None = None) -> set[int]:
        """Nodes reached from both ends towards each other; inside, in both orientations."""
        active, visited, found = [start, end ^ 1], {start >> 1, end >> 1}, set()
        while active:
            h = active.pop()
            if h >> 1 not in have and h >> 1 not in found:
                if limit is not None and len(found) >= limit:
                    raise LimitExceeded(f"more than {limit} new nodes between {start} and {end}")
                found.add(h >> 1)
            for nxt in self.successors(h):
                if nxt >> 1 not in visited:
                    visited.add(nxt >> 1)
                    active += [nxt, nxt ^ 1]
        return found | {n for n in (start >> 1, end >> 1) if n not in have}

    def is_entry(self, handle: int, within: set[int] | None = None) -> bool:
        """Whether a boundary handle opens a snarl: it branches, or its one successor is entered from elsewhere too."""
        out = self.successors(handle)
        if self.link_of(handle) is None or not out:
            return False
        if len(out) > 1:
            return True
        return (within is None or out[0] >> 1 in within) and len(self.successors(out[0] ^ 1)) > 1

    def snarls(self, nodes: set[int], partial: bool = False) -> list[tuple[int, int]]:
        """Snarls that the nodes cover, or with `partial` those they only begin to cover."""
        if partial and self.components(nodes) != 1:
            return []
        out = set()
        for n in nodes:
            for h in (2 * n, 2 * n + 1):
                if self.is_entry(h, nodes) and any(x >> 1 in nodes for x in self.successors(h)) and not (partial and self.link_of(h) >> 1 in nodes):
                    out.add(canonical_snarl(h, self.link_of(h)))
        return sorted(out)

    def components(self, nodes: set[int]) -> int:
        left, n = set(nodes), 0
        while left:
            stack, n = [left.pop()], n + 1
            while stack:
                v = stack.pop()
                for h in (2 * v, 2 * v + 1):
                    for x in self.successors(h):
                        if x >> 1 in left:
                            left.discard(x >> 1)
                            stack.append(x >> 1)
        return n

    def with_snarls(self, nodes: set[int]) -> set[int]:
        for start, end in self.snarls(nodes):
            nodes = nodes | self.between(start, end, nodes)
        return nodes

    def visible_link(self, nodes: set[int]) -> bool:
        return any(self.link_of(h) is not None for n in nodes for h in (2 * n, 2 * n + 1))

    def enclosing(self, nodes: set[int]) -> set[int]:
        """The nodes and those of the snarl around them, if a traversal outwards meets its boundary first."""
        if not nodes or self.components(nodes) != 1 or not self.has_links() or self.visible_link(nodes):
            return nodes
        active = deque(h for n in sorted(nodes) for h in (2 * n, 2 * n + 1))
        visited, collected = set(active), set()
        while active:
            h = active.popleft()
            if self.link_of(h ^ 1) is not None:
                if self.is_entry(h ^ 1):
                    nodes = nodes | collected
                    return nodes | self.between(h ^ 1, self.link_of(h ^ 1), nodes)
                return nodes
            if h >> 1 not in nodes:
                collected.add(h >> 1)
            for x in self.successors(h):
                for y in (x, x ^ 1):
                    if y not in visited:
                        visited.add(y)
                        active.append(y)
        return nodes

    def extended(self, nodes: set[int]) -> set[int]:
        nodes = self.with_snarls(nodes)
        return nodes if self.visible_link(nodes) else self.enclosing(nodes)


class Ranged(Adjacency):
    """The part of a graph that a traversal has met so far, by ranges of node ids. A stored graph is sorted by them, so a
    fetch reads what it needs of the files."""

    def __init__(self, graph: Graph, width: int | None = None, ranges: int | None = None):
        super().__init__((), ())
        self.graph, self.width, self.left, self.loaded = graph, width or WIDTH, ranges or RANGES, set()

    def _need(self, node: int) -> None:
        at = node // self.width
        if at in self.loaded:
            return
        if not self.left:
            raise Spread
        self.left -= 1
        self.loaded.add(at)
        lo, hi, g = at * self.width, (at + 1) * self.width - 1, self.graph
        kind = lambda k: F.lit(k).alias("kind")
        rows = g.nodes.where(F.col("node_id").between(lo, hi)).select(kind(0), F.col("node_id").alias("a"), F.col("seq_len").alias("b"))
        rows = rows.unionByName(g.edges.where(F.col("src").between(2 * lo, 2 * hi + 1)).select(kind(1), F.col("src").alias("a"), F.col("dst").alias("b")))
        rows = rows.unionByName(g.chain_links.where(F.col("handle").between(2 * lo, 2 * hi + 1)).select(kind(2), F.col("handle").alias("a"), F.col("next").alias("b")))
        rows = rows.limit(MAX_EDGES + 1).collect()
        if len(rows) > MAX_EDGES:
            raise Spread
        for k, a, b in rows:
            if k == 0:
                self.length[a] = b
            elif k == 2:
                self.link[a] = b
            elif b:
                self.next.setdefault(a, []).append(b)
        for k, a, _ in rows:
            if k == 1 and a in self.next:
                self.next[a].sort()

    def forget(self, keep: set[int]) -> None:
        """Drops the ranges that none of the nodes is in; others can be fetched in their place."""
        gone = self.loaded - {n // self.width for n in keep}
        self.loaded -= gone
        self.left += len(gone)
        for held, node in ((self.length, lambda n: n), (self.next, lambda h: h >> 1), (self.link, lambda h: h >> 1)):
            for k in [k for k in held if node(k) // self.width in gone]:
                del held[k]

    def successors(self, handle: int) -> list[int]:
        self._need(handle >> 1)
        return super().successors(handle)

    def length_of(self, node: int) -> int:
        self._need(node)
        return super().length_of(node)

    def link_of(self, handle: int) -> int | None:
        self._need(handle >> 1)
        return super().link_of(handle)

    def has_links(self) -> bool:
        return bool(self.link) or not self.graph.chain_links.isEmpty()


def tiered(graph: Graph, first, second):
    """first(part of the graph on the driver), or second() if that meets too much of it."""
    try:
        return first(Ranged(graph))
    except Spread:
        return second()


def dominators(near: Adjacency, start: int, end: int) -> list[int]:
    """The handles on every directed walk from start to end, in order; empty if there is none."""
    order, seen, stack = [], {start}, [(start, iter(near.successors(start)))]
    while stack:
        h, out = stack[-1]
        for x in out:
            if x not in seen:
                seen.add(x)
                stack.append((x, iter(near.successors(x))))
                break
        else:
            order.append(h)
            stack.pop()
    if end not in seen:
        return []
    rank = {h: i for i, h in enumerate(order)}
    before: dict[int, list[int]] = {h: [] for h in order}
    for h in order:
        for x in near.successors(h):
            before[x].append(h)
    idom = {start: start}
    changed = True
    while changed:
        changed = False
        for h in reversed(order[:-1]):
            best = None
            for p in before[h]:
                if p in idom:
                    a = p
                    while best is not None and a != best:
                        if rank[a] < rank[best]:
                            a = idom[a]
                        else:
                            best = idom[best]
                    best = a
            if idom.get(h) != best:
                idom[h], changed = best, True
    chain = [end]
    while chain[-1] != start:
        chain.append(idom[chain[-1]])
    return chain[::-1]


def discover_chains(near: Adjacency) -> list[tuple[int, int]]:
    """Chain links (handle, next), both ways, of the components with exactly two tips that a directed walk connects.

    A tip is a handle without predecessors. Boundaries are the handles on every walk from one tip to the other.
    """
    left, out = set(near.length), []
    while left:
        stack, members = [left.pop()], []
        while stack:
            v = stack.pop()
            members.append(v)
            for x in near.successors(2 * v) + near.successors(2 * v + 1):
                if x >> 1 in left:
                    left.discard(x >> 1)
                    stack.append(x >> 1)
        tips = sorted(h for v in members for h in (2 * v, 2 * v + 1) if not near.successors(h ^ 1))
        if len(tips) == 2:
            chain = dominators(near, tips[0], tips[1] ^ 1)
            out += [p for a, b in zip(chain, chain[1:], strict=False) for p in ((a, b), (b ^ 1, a ^ 1))]
    return sorted(out)


def adjacency(graph: Graph, most: int = MAX_EDGES) -> Adjacency | None:
    """A whole graph on the driver, for what has to see all of it, or None if the graph has more edges, or nodes, than may come to the driver. Both are counted before they are fetched."""
    count = lambda df: df.limit(most + 1).count()
    if count(graph.edges.select("src")) > most or count(graph.nodes.select("node_id")) > most:
        return None
    rows = graph.edges.select("src", "dst").collect()
    lengths = graph.nodes.select("node_id", "seq_len").collect()
    return Adjacency(map(tuple, rows), map(tuple, lengths), map(tuple, graph.chain_links.select("handle", "next").collect()))


def between_frontier(graph: Graph, ends: DataFrame, limit: int | None = None) -> DataFrame:
    """Tier 2 of `between`: (query_id, start, end) to (query_id, node_id)."""
    ensure_checkpoint(graph.spark)
    first = ends.select("query_id", F.explode(F.array(F.col("start"), F.col("end").bitwiseXOR(F.lit(1)))).alias("handle")).checkpoint()
    frontier, seen = first, first.select("query_id", node_of(F.col("handle")).alias("node_id")).distinct().checkpoint()
    while True:
        out = frontier.join(graph.edges, F.col("handle") == F.col("src")).select("query_id", node_of(F.col("dst")).alias("node_id")).distinct()
        new = out.join(seen, ["query_id", "node_id"], "left_anti").checkpoint()
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new).checkpoint()
        if limit is not None and not seen.groupBy("query_id").count().where(F.col("count") > limit).isEmpty():
            raise LimitExceeded(f"more than {limit} new nodes")
        frontier = new.select("query_id", F.explode(F.array(encode(F.col("node_id"), F.lit(0)), encode(F.col("node_id"), F.lit(1)))).alias("handle"))


def components_frontier(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(node_id, component): weak components of the subgraph on the nodes, by the least id. Large and small stars take turns,
    so the rounds grow with the logarithm of a component's size and not with its diameter."""
    ensure_checkpoint(graph.spark)
    pairs = graph.edges.select(node_of(F.col("src")).alias("node_id"), node_of(F.col("dst")).alias("other"))
    ids = nodes.select("node_id").distinct()
    pairs = pairs.join(ids, "node_id", "left_semi").join(ids.withColumnRenamed("node_id", "other"), "other", "left_semi")
    stars = _components(pairs.select(F.col("node_id").alias("a"), F.col("other").alias("b")))
    label = stars.select(F.col("a").alias("node_id"), F.col("b").alias("component"))
    return ids.join(label, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def enclosing_frontier(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Tier 2 of `enclosing`: (node_id). Handles of a round carry their place in the first tier's queue."""
    ensure_checkpoint(graph.spark)
    edges, links, one = graph.edges.where("dst <> 0"), graph.chain_links, F.lit(1)
    nodes = nodes.select("node_id").distinct().checkpoint()
    both = F.array(encode(F.col("node_id"), F.lit(0)), encode(F.col("node_id"), F.lit(1)))
    start = nodes.select(F.explode(both).alias("handle"))
    if components_frontier(graph, nodes).select("component").distinct().limit(2).count() != 1 or links.isEmpty() or not start.join(links, "handle", "left_semi").isEmpty():
        return nodes
    place = lambda df, *by: df.orderBy(*by).select("handle", F.monotonically_increasing_id().alias("place")).checkpoint()
    frontier = place(start, "handle")
    seen = frontier.select("handle")
    while not frontier.isEmpty():
        hit = frontier.join(links.select(F.col("handle").bitwiseXOR(one).alias("handle"), "next"), "handle").orderBy("place").first()
        if hit is not None:
            h = hit.handle ^ 1
            out = [x.dst for x in edges.where(F.col("src") == h).select("dst").distinct().orderBy("dst").limit(2).collect()]
            entry = len(out) > 1 or len(out) == 1 and edges.where(F.col("src") == out[0] ^ 1).distinct().limit(2).count() > 1
            if not entry:
                return nodes
            ends = graph.spark.createDataFrame([(0, h, hit.next)], "query_id long, start long, end long")
            inner = between_frontier(Graph(graph.nodes, edges, graph.steps, graph.paths, links, graph.tags), ends).select("node_id")
            before = seen.join(frontier.where(F.col("place") >= hit.place), "handle", "left_anti").select(node_of(F.col("handle")).alias("node_id"))
            return nodes.unionByName(before).unionByName(inner).distinct()
        reached = frontier.join(edges, F.col("handle") == F.col("src")).select("place", "dst", F.explode(F.array(F.lit(0), one)).alias("turn"))
        reached = reached.select(F.col("dst").bitwiseXOR(F.col("turn")).alias("handle"), F.struct("place", "dst", "turn").alias("at"))
        frontier = place(reached.groupBy("handle").agg(F.min("at").alias("at")).join(seen, "handle", "left_anti"), "at")
        seen = seen.unionByName(frontier.select("handle")).checkpoint()
    return nodes


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Large: neighbours above a are linked to a's least neighbour. Small: those below, and a itself, are."""
    if large:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _components(pairs: DataFrame) -> DataFrame:
    """(a, b): each id that is not the least of its component, and that least one."""
    pairs, before = pairs.where("a <> b").distinct().checkpoint(), None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs
        before, pairs = now, _stars(_stars(pairs, True), False).checkpoint()


def components_of_edges(edges: DataFrame) -> DataFrame:
    """(node_id, component) of the nodes that handles of (src, dst) are of."""
    a, b = node_of(F.col("src")), node_of(F.col("dst"))
    label = _components(edges.select(a.alias("a"), b.alias("b"))).select(F.col("a").alias("node_id"), F.col("b").alias("component"))
    own = edges.select(F.explode(F.array(a, b)).alias("node_id")).distinct()
    return own.join(label, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def with_snarls(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Tier 2 of `with_snarls`: the nodes and those of the snarls that they cover."""
    found = covered_snarls(graph, nodes).withColumn("query_id", F.monotonically_increasing_id())
    return nodes.select("node_id").unionByName(between_frontier(graph, found).select("node_id")).distinct()


def extended(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Tier 2 of `extended`: with covered snarls, and with the snarl around the nodes if none of them is a boundary."""
    return enclosing_frontier(graph, with_snarls(graph, nodes))


def add_node(nodes: DataFrame, node_id: int) -> DataFrame:
    """A set of nodes with one more; it may be in already."""
    one = nodes.sparkSession.createDataFrame([(node_id,)], "node_id long")
    return nodes.select("node_id").unionByName(one).distinct()


def remove_node(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.where(F.col("node_id") != node_id)


def degrees(edges: DataFrame) -> DataFrame:
    """(handle, out_degree)."""
    return edges.groupBy(F.col("src").alias("handle")).agg(F.count("*").alias("out_degree"))


def snarl_entries(graph: Graph) -> DataFrame:
    """(handle, next) of boundary handles that open a snarl."""
    degree = degrees(graph.edges)
    first = graph.edges.groupBy(F.col("src").alias("handle")).agg(F.min("dst").alias("only"))
    back = degree.select(F.col("handle").alias("back"), F.col("out_degree").alias("in_degree"))
    rows = graph.chain_links.join(degree, "handle").join(first, "handle").withColumn("back", F.col("only").bitwiseXOR(F.lit(1))).join(back, "back", "left")
    return rows.where("out_degree > 1 or in_degree > 1").select("handle", "next")


def covered_snarls(graph: Graph, nodes: DataFrame, partial: bool = False) -> DataFrame:
    """(start, end) of snarls of which the nodes hold the entry and a successor; partial: but not the other boundary, and
    only if the nodes are one weak component."""
    from braidlake.schema import edge_is_canonical, flip

    ids = nodes.select("node_id").distinct()
    inside = graph.edges.join(ids.withColumnRenamed("node_id", "d"), node_of(F.col("dst")) == F.col("d"), "left_semi").select(F.col("src").alias("handle")).distinct()
    rows = snarl_entries(graph).join(inside, "handle", "left_semi").join(ids, node_of(F.col("handle")) == F.col("node_id"), "left_semi")
    if partial:
        rows = rows.join(ids, node_of(F.col("next")) == F.col("node_id"), "left_anti")
        if components_frontier(graph, ids).select("component").distinct().limit(2).count() != 1:
            rows = rows.where(F.lit(False))
    a, b = F.col("handle"), F.col("next")
    start = F.when(edge_is_canonical(a, b), a).otherwise(flip(b))
    end = F.when(edge_is_canonical(a, b), b).otherwise(flip(a))
    return rows.select(start.alias("start"), end.alias("end")).distinct()
