"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a hash. A source's budget is so many whole passes over it plus a remainder; the remainder is met by the
documents whose hash lies under the source's threshold. The threshold is found from sums of words by source and hash
bucket: cumulative sums show in which bucket the budget runs out, and only that boundary bucket is summed again, over
finer buckets, until one hash value is left. A larger budget has a larger threshold, so mixes are nested, and nothing is
sorted. What reaches the driver is one row per source and level.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that repeat a doc_id
and text share their hash and are taken or left together; very long texts count by their words and are never cut; an empty
table gives an empty mix; other columns are ignored by `mix` and passed on by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm._common import Workspace

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 12, 5
MOST_PASSES = 3
#: Thresholds are joined by broadcast up to so many sources, by shuffle beyond.
BROADCAST_SOURCES = 10_000


def shares(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Splits the sum of sizes by weight; what would exceed `most` passes over a source is shared again by weight."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s], float(sum(sizes))
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        for i in over or open_:
            target[i] = float(most * sizes[i]) if over else weights[i] * unit
            left -= target[i]
        if not over:
            break
        open_ = [i for i in open_ if i not in over]
    return target


def _keyed(docs: DataFrame, seed: int) -> tuple:
    """Size and hash of a document, as columns."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")), 64 - BITS * LEVELS)
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), h


def plan_mix(rows: DataFrame, weights=(1, 2, 3), most: float = MOST_PASSES) -> list[tuple]:
    """(source, source_size, target, whole passes, threshold) for each source of written rows (source, size, h)."""
    totals = rows.groupBy("source").agg(F.sum("size")).collect()
    totals = sorted(((r[0], r[1]) for r in totals), key=lambda x: (x[0] is None, x[0] or ""))
    targets = shares([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], most)
    plan = {}
    for (source, n), target in zip(totals, targets, strict=True):
        passes = min(int(target // n), int(most)) if n else 0
        plan[source] = {"n": n, "target": target, "passes": passes, "left": target - passes * n, "prefix": 0}
    _refine(rows, plan)
    return [(s, p["n"], p["target"], p["passes"], p["prefix"]) for s, p in plan.items()]


def _planned(rows: DataFrame, plan: list[tuple]) -> DataFrame:
    """Adds source_size, target and passes to rows (source, size, h)."""
    table = rows.sparkSession.createDataFrame(plan, "__s__ string, source_size long, target double, __whole__ int, __threshold__ long")
    joined = rows.join(F.broadcast(table) if len(plan) <= BROADCAST_SOURCES else table, F.col("source").eqNullSafe(F.col("__s__")))
    passes = F.col("__whole__") + (F.col("h") < F.col("__threshold__")).cast("int")
    return joined.withColumn("passes", passes).drop("__s__", "__whole__", "__threshold__")


def mix(docs: DataFrame, weights=(1, 2, 3), most: float = MOST_PASSES, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, passes (times the document is taken), taken (words)."""
    size, h = _keyed(docs, seed)
    with Workspace(docs.sparkSession, "mixing") as ws:
        rows = ws.table(docs.select("doc_id", "source", size.alias("size"), h.alias("h")), "sizes", keep=True)
        plan = plan_mix(rows, weights, most)
    taken = (F.col("passes") * F.col("size")).cast("long").alias("taken")
    return _planned(rows, plan).select("doc_id", "source", "size", "source_size", "target", "passes", taken)


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), most: float = MOST_PASSES, seed: int = 7) -> DataFrame:
    """The documents of the mix with all their columns, each as many times as it is taken."""
    size, h = _keyed(docs, seed)
    with Workspace(docs.sparkSession, "mixing") as ws:
        plan = plan_mix(ws.table(docs.select("source", size.alias("size"), h.alias("h")), "sizes"), weights, most)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row__"), "source", h.alias("h"))
    times = F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("__pass__")
    return _planned(packed, plan).where("passes > 0").select("__row__", times).select("__row__.*")


def _refine(rows: DataFrame, plan: dict) -> None:
    """Finds each source's threshold, level by level. prefix: the hash bits fixed so far, and at the end the threshold."""
    spark, open_ = rows.sparkSession, {s for s, p in plan.items() if p["left"] > 0}
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        if not open_:
            break
        edges = [(s, plan[s]["prefix"], plan[s]["left"]) for s in open_]
        edges = spark.createDataFrame(edges, "s string, prefix long, budget double")
        edges = F.broadcast(edges) if len(open_) <= BROADCAST_SOURCES else edges
        here = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("prefix"))
        sums = rows.join(edges, here).groupBy("s", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", upto).where(F.col("upto") > F.col("budget"))
        first = sums.groupBy("s").agg(F.min(F.struct("bucket", "upto", "words", "lo", "hi")).alias("b")).select("s", "b.*").collect()
        met = set()
        for s, bucket, upto, words, lo, hi in first:
            p = plan[s]
            p["left"] -= upto - words
            p["prefix"] = bucket
            if lo == hi:  # one hash value: take it if that comes nearer
                p["prefix"], p["left"] = lo + (2 * p["left"] > words), 0
            else:
                met.add(s)
        for s in open_ - {r[0] for r in first}:  # rounding: everything is within the budget
            plan[s]["prefix"] = (plan[s]["prefix"] + 1) << (shift + BITS)
        open_ = met
