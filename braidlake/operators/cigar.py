"""Alignment of a walk to the reference walk: a common subsequence weighted by node lengths, gaps aligned base by base."""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlake.functions.seq import oriented

MISMATCH, GAP_OPEN, GAP_EXTEND = 4, 6, 1


def gap(n: int) -> int:
    return GAP_OPEN + GAP_EXTEND * (n - 1) if n else 0


def common_prefix(a, b) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def align_gap(a: str, b: str) -> list[tuple[str, int]]:
    """Edits that make b into a: equal ends, and between them mismatches with one gap, or an insertion and a deletion."""
    prefix = common_prefix(a, b)
    suffix = min(common_prefix(a[::-1], b[::-1]), len(a) - prefix, len(b) - prefix)
    i, d = len(a) - prefix - suffix, len(b) - prefix - suffix
    m = min(i, d)
    if m and MISMATCH * m + gap(i - m) + gap(d - m) > gap(i) + gap(d):
        m = 0
    return [("M", prefix), ("M", m), ("I", i - m), ("D", d - m), ("M", suffix)]


def weighted_lcs(a: list[int], b: list[int], weight) -> list[tuple[int, int]]:
    """Places (in a, in b) of a common subsequence of the greatest total weight.

    Equal ends belong to one in any case. Between them only equal pairs are met: along a, the places in b at which the best
    weight so far rises make a staircase, on which a pair finds by bisection what it continues, and takes its own step. A
    step points to the one that it continues, so what no step leads to is forgotten; no table of both walks is made.
    """
    start = common_prefix(a, b)
    tail = min(common_prefix(a[::-1], b[::-1]), len(a) - start, len(b) - start)
    inside_b: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, start - 1, -1):  # later places first: a place of a is used once
        inside_b.setdefault(b[j], []).append(j)
    places, bests, links = [start - 1], [0], [None]
    for i in range(start, len(a) - tail):
        if a[i] in inside_b:
            w = weight(a[i])
            for j in inside_b[a[i]]:
                k = bisect_left(places, j)
                best = bests[k - 1] + w
                end = k
                while end < len(places) and bests[end] <= best and (bests[end] < best or places[end] > j):
                    end += 1
                if end < len(places) and places[end] == j or w <= 0:
                    continue  # as good is known to end there
                places[k:end], bests[k:end], links[k:end] = [j], [best], [(i, j, links[k - 1])]
    out, link = [], links[-1]
    while link is not None:
        i, j, link = link
        out.append((i, j))
    return [(k, k) for k in range(start)] + out[::-1] + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def cigar(walk: list[int], ref: list[int], sequence) -> str:
    """The alignment of walk to ref; sequence gives a handle's oriented bases."""
    text = lambda part: "".join(map(sequence, part))
    edits: list[list] = []
    i = j = 0
    for x, y in [*weighted_lcs(walk, ref, lambda h: len(sequence(h))), (len(walk), len(ref))]:
        step = align_gap(text(walk[i:x]), text(ref[j:y]))
        if x < len(walk):
            step.append(("M", len(sequence(walk[x]))))
        for op, n in step:
            if n and edits and edits[-1][0] == op:
                edits[-1][1] += n
            elif n:
                edits.append([op, n])
        i, j = x + 1, y + 1
    return "".join(f"{n}{op}" for op, n in edits)


def with_bases(walks: DataFrame, nodes: DataFrame) -> DataFrame:
    """(walk, bases): each distinct walk with the oriented bases of its nodes."""
    distinct = walks.select("walk").distinct()
    steps = distinct.select("walk", F.posexplode("walk").alias("pos", "handle")).withColumn("node_id", F.shiftright("handle", 1))
    steps = steps.join(nodes.select("node_id", "sequence"), "node_id")
    here = F.struct("pos", oriented(F.col("sequence"), F.col("handle").bitwiseAND(F.lit(1))).alias("s"))
    return steps.groupBy("walk").agg(F.array_sort(F.collect_list(here))["s"].alias("bases"))


def with_cigars(walks: DataFrame, ref: list[int], nodes: DataFrame) -> DataFrame:
    """Adds cigar to rows with a walk; null for the reference. Equal walks are aligned once, each with the bases of its own
    nodes, so a task holds a walk and the reference, whatever the size of the subgraph."""
    if not ref:
        return walks.withColumn("cigar", F.lit(None).cast("string"))
    spark = walks.sparkSession
    one = with_bases(spark.createDataFrame([(list(ref),)], "walk array<long>"), nodes).first()
    of_ref = dict(zip(ref, one.bases, strict=True))

    def rows(batches):
        for b in batches:
            out = []
            for walk, bases in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                of = of_ref | dict(zip(walk, bases, strict=True))
                out.append(cigar(walk, ref, of.__getitem__))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["walk", "cigar"])

    aligned = with_bases(walks.where(~F.col("is_ref")), nodes).mapInArrow(rows, "walk array<long>, cigar string")
    found = walks.join(aligned.select(F.col("walk").alias("__walk"), "cigar"), F.col("walk") == F.col("__walk"), "left").drop("__walk")
    return found.withColumn("cigar", F.when(~F.col("is_ref"), F.col("cigar")))
