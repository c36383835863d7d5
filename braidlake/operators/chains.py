"""Chains of a graph's components, of any size: no component is one task's.

A component with exactly two tips (handles without predecessors) that a directed walk connects has a chain: the handles on
every walk from one tip to the other. Handles with one way in and one way out are contracted into edges, independent ones
together, and parallel edges become one, in rounds whose number grows with the logarithm of the graph and with how deep
bubbles are nested. What is left of a component (one edge, if its bubbles are nested) is put in levels: each handle one above
its highest predecessor. A handle is on every walk if it is alone on its level and no edge passes it. An edge that is a link
of the chain is then opened again: its two halves are links if it was a contraction, and it stays as it is if it was of
parallel edges. What is left may have cycles; of these at most MAX_EDGES edges go to the driver, or an error says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.operators._shared import ensure_checkpoint
from braidlake.operators.traverse import MAX_EDGES, Adjacency, components_of_edges, dominators
from braidlake.schema import Graph, encode


def contract(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(src, dst) to what is left, (src, dst, via), and the contractions (handle, left, right) that a via stands for.

    left and right are the vias of the two edges that met at the handle; null stands for an edge that has nothing inside
    that all its walks pass.
    """
    rows, done, turn = edges.select("src", "dst", F.lit(None).cast("long").alias("via")), [], 0
    while True:
        merged = rows.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("via").alias("via"))
        merged = merged.select("src", "dst", F.when(F.col("n") == 1, F.col("via")).alias("via")).checkpoint()
        into = merged.groupBy(F.col("dst").alias("handle")).agg(F.count("*").alias("n"), F.max("src").alias("before"), F.max("via").alias("left")).where("n = 1").drop("n")
        out = merged.groupBy(F.col("src").alias("handle")).agg(F.count("*").alias("n"), F.max("dst").alias("after"), F.max("via").alias("right")).where("n = 1").drop("n")
        place = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: B023, E731
        single = into.join(out, "handle").withColumn("place", place("handle"))
        other = single.select(F.col("handle").alias("other"))
        # of neighbours that could both go the one whose hash is less does; those of a pair that meets itself are told apart by it too
        beside = single.select("handle", "place", F.explode(F.array("before", "after")).alias("other")).join(other, "other", "left_semi")
        kept = beside.where((place("other") < F.col("place")) | ((place("other") == F.col("place")) & (F.col("other") < F.col("handle")))).select("handle").distinct()
        chosen = single.join(kept, "handle", "left_anti").select("handle", "before", "left", "after", "right").checkpoint()
        if chosen.isEmpty():
            return merged, done
        done.append(chosen.select("handle", "left", "right"))
        gone = chosen.select("handle")
        rest = merged.join(gone, F.col("src") == F.col("handle"), "left_anti").join(gone, F.col("dst") == F.col("handle"), "left_anti")
        rows, turn = rest.unionByName(chosen.select(F.col("before").alias("src"), F.col("after").alias("dst"), F.col("handle").alias("via"))), turn + 1


def expand(links: DataFrame, contractions: list[DataFrame]) -> DataFrame:
    """Links (src, dst, via) with all that was contracted on them, as (src, dst). The last contractions are opened first."""
    for done in reversed(contractions):
        both = links.join(done.select(F.col("handle").alias("via"), "left", "right", F.lit(True).alias("here")), "via", "left")
        halves = F.array(F.struct("src", F.col("via").alias("dst"), F.col("left").alias("via")), F.struct(F.col("via").alias("src"), "dst", F.col("right").alias("via")))
        same = F.array(F.struct("src", "dst", "via"))
        links = both.select(F.explode(F.when(F.col("here"), halves).otherwise(same)).alias("e")).select("e.*")
    return links.select("src", "dst")


def _reached(edges: DataFrame, starts: DataFrame, a: str, b: str) -> DataFrame:
    """(component, handle) reached from the starts along the edges from column a to column b."""
    seen = frontier = starts.checkpoint()
    while not frontier.isEmpty():
        out = frontier.join(edges.select("component", F.col(a).alias("handle"), F.col(b).alias("next")), ["component", "handle"])
        frontier = out.select("component", F.col("next").alias("handle")).distinct().join(seen, ["component", "handle"], "left_anti").checkpoint()
        seen = seen.unionByName(frontier).checkpoint()
    return seen


def _levels(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(component, handle, level) of handles that no cycle comes before, and the edges that are left of the others."""
    frontier, levels, level = starts.withColumn("level", F.lit(0)).checkpoint(), None, 0
    while not frontier.isEmpty():
        levels = frontier if levels is None else levels.unionByName(frontier)
        met = edges.join(frontier.select("component", F.col("handle").alias("src")), ["component", "src"], "left_semi").select("component", F.col("dst").alias("handle")).distinct()
        edges = edges.join(frontier.select("component", F.col("handle").alias("src")), ["component", "src"], "left_anti").checkpoint()
        level += 1
        frontier = met.join(edges.select("component", F.col("dst").alias("handle")), ["component", "handle"], "left_anti").withColumn("level", F.lit(level)).checkpoint()
    return (starts.withColumn("level", F.lit(0)) if levels is None else levels), edges


def _passed_by_all(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(src, dst, via) between neighbours among the handles that are alone on their level and that no edge passes.

    What is counted has a row for each level of what is left of a component.
    """
    at = levels.select("component", "handle", "level")
    both = edges.join(at.withColumnRenamed("handle", "src").withColumnRenamed("level", "low"), ["component", "src"]).join(at.withColumnRenamed("handle", "dst").withColumnRenamed("level", "high"), ["component", "dst"])
    turns = both.select("component", F.explode(F.array(F.struct((F.col("low") + 1).alias("level"), F.lit(1).alias("n")), F.struct(F.col("high").alias("level"), F.lit(-1).alias("n")))).alias("t")).select("component", "t.*")
    turns = turns.groupBy("component", "level").agg(F.sum("n").alias("turn"))
    alone = at.groupBy("component", "level").agg(F.count("*").alias("n"), F.max("handle").alias("handle"))
    order = Window.partitionBy("component").orderBy("level")
    rows = alone.join(turns, ["component", "level"], "left").withColumn("over", F.sum(F.coalesce("turn", F.lit(0))).over(order))
    cuts = rows.where("n = 1 and over = 0").select("component", "level", "handle")
    cuts = cuts.select("component", F.col("handle").alias("src"), F.lead("handle").over(order).alias("dst"), (F.lead("level").over(order) - F.col("level")).alias("step")).where("dst is not null")
    only = edges.select("component", "src", "dst", "via")
    return cuts.join(only, ["component", "src", "dst"], "left").select("src", "dst", F.when(F.col("step") == 1, F.col("via")).alias("via"))


def _dominating(edges: DataFrame, ends: DataFrame) -> list[tuple[int, int, int | None]]:
    """The same by dominators on the driver, cycles or not."""
    rows = edges.select("component", "src", "dst", "via").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"components with cycles keep more than {MAX_EDGES} edges when their chains are contracted")
    out, of = [], {}
    for r in rows:
        of.setdefault(r.component, []).append(r)
    for component, first, last in ends.where(F.col("component").isin(list(of))).select("component", "first", "last").collect() if len(of) <= 10_000 else [tuple(r) for r in ends.collect() if r.component in of]:
        inner, pairs = {}, []
        for r in of[component]:
            if r.via is None:
                pairs.append((r.src, r.dst))
            else:  # the edge itself may be what all walks pass
                inner[-1 - len(inner)] = r.via
                pairs += [(r.src, -len(inner)), (-len(inner), r.dst)]
        chain = dominators(Adjacency(pairs, {}), first, last)
        handles = [(k, h) for k, h in enumerate(chain) if h >= 0]
        out += [(a, b, inner[chain[i + 1]] if j == i + 2 else None) for (i, a), (j, b) in zip(handles, handles[1:], strict=False)]
    return out


def _in_levels(core: DataFrame, ends: DataFrame) -> DataFrame:
    """(src, dst, via): the links of contracted components, a round for each level; of those with cycles on the driver."""
    first, last = (ends.select("component", F.col(c).alias("handle")) for c in ("first", "last"))
    forth = _reached(core, first, "src", "dst")
    used = forth.join(_reached(core, last, "dst", "src"), ["component", "handle"]).checkpoint()
    for c in ("src", "dst"):
        core = core.join(used.withColumnRenamed("handle", c), ["component", c], "left_semi")
    core = core.checkpoint()
    levels, left = _levels(core, first.join(used, ["component", "handle"], "left_semi"))
    cyclic = left.select("component").distinct().checkpoint()
    links = _passed_by_all(core.join(cyclic, "component", "left_anti"), levels.join(cyclic, "component", "left_anti"))
    more = [] if cyclic.isEmpty() else _dominating(core.join(cyclic, "component", "left_semi"), ends)
    return links.unionByName(core.sparkSession.createDataFrame(more, LINKS))


LINKS = "src long, dst long, via long"


def discover_chains(graph: Graph, on_driver: int = MAX_EDGES) -> DataFrame:
    """(handle, next): the links of all chains, both ways. What contraction leaves goes to the driver if it has no more edges
    than that, which saves its rounds; the links are the same."""
    ensure_checkpoint(graph.spark)
    edges = graph.edges.where("src > 1 and dst > 1").select("src", "dst").distinct().checkpoint()
    label = components_of_edges(edges).checkpoint()
    tips = label.select("component", F.explode(F.array(encode(F.col("node_id"), F.lit(0)), encode(F.col("node_id"), F.lit(1)))).alias("tip"))
    tips = tips.join(edges.select(F.col("src").bitwiseXOR(F.lit(1)).alias("tip")), "tip", "left_anti")
    ends = tips.groupBy("component").agg(F.count("*").alias("n"), F.min("tip").alias("first"), F.max("tip").bitwiseXOR(F.lit(1)).alias("last")).where("n = 2").drop("n").checkpoint()
    wanted = edges.withColumn("node_id", F.shiftright("src", 1)).join(label.join(ends, "component", "left_semi"), "node_id").select("src", "dst")
    core, contractions = contract(wanted)
    core = core.withColumn("node_id", F.shiftright("src", 1)).join(label, "node_id").drop("node_id").checkpoint()
    if core.limit(on_driver + 1).count() <= on_driver:
        links = graph.spark.createDataFrame(_dominating(core, ends), LINKS)
    else:
        links = _in_levels(core, ends)
    found = expand(links, contractions)
    both = F.array(F.struct(F.col("src").alias("handle"), F.col("dst").alias("next")), F.struct(F.col("dst").bitwiseXOR(F.lit(1)).alias("handle"), F.col("src").bitwiseXOR(F.lit(1)).alias("next")))
    return found.select(F.explode(both).alias("e")).select("e.*")
