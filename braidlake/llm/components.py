"""Connected components by alternating large and small stars, every round written to the shared folder.

A hub with many neighbours is joined with its one least neighbour by a merge join, whose skewed side Spark splits. Defined
results: repeated edges and loops change nothing; ids that have no edge to another are not named; no edges give no rows;
null ids are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.llm._common import Workspace


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour above u is linked to u's least neighbour. Small: those below and u itself are."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.hint("merge").join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(id, component) for every id in edges (a, b); a component is named by its least id. Written."""
    edges = ws.table(edges.select("a", "b").where("a <> b").distinct(), "edges", rows=edges.count())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        edges = ws.table(_stars(_stars(edges, True), False), "edges", rows=now[0])
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return ws.table(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots).distinct(), "components", rows=before[0] if before else 0)
