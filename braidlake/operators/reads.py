"""Reads aligned to the graph: selection by subgraph, mappings, clipping, blocks, ranks, sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.functions import cs, gaf
from braidlake.operators.locate import clusters, overlapping
from braidlake.schema import node_of

OVERLAPPING, CLIPPED, CONTAINED = "overlapping", "clipped", "contained"


def path_steps(reads: DataFrame) -> DataFrame:
    """(aln_id, pos, handle) of each read with a path."""
    return reads.select("aln_id", F.posexplode("path").alias("pos", "handle")).withColumn("pos", F.col("pos").cast("long"))


def has_path() -> Column:
    """Whether a read has a target path that is not empty; null if the path is not known yet."""
    return F.size("path") > 0


def with_paths(reads: DataFrame, paths: DataFrame) -> DataFrame:
    """Reads whose path is not known (null) take it and its length from (aln_id, path, path_len), and their handle range from it."""
    new = paths.select("aln_id", F.col("path").alias("__path"), F.col("path_len").alias("__len"))
    rows = reads.join(new, "aln_id", "left").withColumn("__old", F.col("path"))
    rows = rows.withColumns({"path": F.coalesce("path", "__path"), "path_len": F.when(F.col("path").isNull(), F.coalesce("__len", "path_len")).otherwise(F.col("path_len"))})
    fresh = {c: F.when(F.col("__old").isNull(), f("path")).otherwise(F.col(c)) for c, f in (("min_handle", F.array_min), ("max_handle", F.array_max)) if c in reads.columns}
    return rows.withColumns(fresh).select(*[F.col(f"`{c}`") for c in reads.columns])


def handle_range(reads: DataFrame) -> DataFrame:
    return reads.select("aln_id", F.array_min("path").alias("min_handle"), F.array_max("path").alias("max_handle"))


#: Reads that one task numbers in a row, if they are numbered without gaps; their counts are carried on to the next bin.
READS_AT_ONCE = 1 << 16


def blocks(reads: DataFrame, size: int = 1000) -> DataFrame:
    """Adds block_id: consecutive reads, cut where being unaligned flips and after `size` of them (0 counts as 1).

    Reads are numbered bin by bin of their ids; what passes from a bin to the next is its number of reads, its last run's
    start and its number of blocks, one row a bin.
    """
    if size < 0:
        raise ValueError("the size of a block must not be negative")
    size = max(size, 1)
    rows = reads.withColumn("__bin", F.floor(F.col("aln_id") / READS_AT_ONCE))
    inside = Window.partitionBy("__bin").orderBy("aln_id")
    flag = F.col("is_unaligned")
    rows = rows.withColumn("__i", F.row_number().over(inside).cast("long") - 1).withColumn("__flip", F.coalesce(flag != F.lag(flag).over(inside), F.lit(False)))
    bins = rows.groupBy("__bin").agg(
        F.count("*").alias("n"), F.min_by(flag, "__i").alias("first"), F.max_by(flag, "__i").alias("last"), F.max(F.when(F.col("__flip"), F.col("__i"))).alias("flip"))
    order = Window.orderBy("__bin")  # one row for each bin of reads
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bins = bins.withColumn("__opens", F.coalesce(F.lag("last").over(order) != F.col("first"), F.lit(True)))
    start = F.when(F.col("flip").isNotNull(), F.col("__base") + F.col("flip")).when(F.col("__opens"), F.col("__base"))
    bins = bins.withColumn("__run", F.last(start, ignorenulls=True).over(before)).select("__bin", "__base", "__opens", "__run")
    rows = rows.join(bins, "__bin")
    number, opens = F.col("__base") + F.col("__i"), F.col("__flip") | ((F.col("__i") == 0) & F.col("__opens"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    run = F.coalesce(F.last(F.when(opens, number), ignorenulls=True).over(upto), F.col("__run"))
    rows = rows.withColumn("__start", ((number - run) % size == 0).cast("long"))
    starts = rows.groupBy("__bin").agg(F.sum("__start").alias("n"))
    starts = starts.select("__bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__blocks"))
    rows = rows.join(starts, "__bin").withColumn("block_id", (F.col("__blocks") + F.sum("__start").over(upto) - 1).cast("long"))
    return rows.select(*[F.col(f"`{c}`") for c in reads.columns], "block_id")


def block_summary(blocked: DataFrame) -> DataFrame:
    """One row a block: reads, handle range (null if any member has no path) and common read length (null if they differ)."""
    whole = F.count("min_handle") == F.count("*")
    same = (F.min("seq_len") == F.max("seq_len")) & (F.min("seq_len") > 0)
    return blocked.groupBy("block_id").agg(
        F.count("*").alias("reads"), F.when(whole, F.min("min_handle")).alias("min_handle"), F.max("max_handle").alias("max_handle"),
        F.when(same, F.min("seq_len")).alias("read_length"), F.sum(F.octet_length("name")).cast("long").alias("name_bytes"))


def start_ranks(reads: DataFrame) -> DataFrame:
    """(aln_id, start, rank): how many earlier reads start at the same handle; null for reads without a path.

    Ranks are counted bin by bin of ids, so a handle at which very many reads start is no single task's.
    """
    rows = reads.select("aln_id", F.try_element_at("path", F.lit(1)).alias("start"), F.floor(F.col("aln_id") / READS_AT_ONCE).alias("bin"))
    some = rows.where("start is not null")
    before = Window.partitionBy("start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = some.groupBy("start", "bin").agg(F.count("*").alias("n")).select("start", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("start", "bin").orderBy("aln_id")) - 1
    ranked = some.withColumn("rank", rank).join(counts, ["start", "bin"]).select("aln_id", "start", (F.col("base") + F.col("rank")).cast("long").alias("rank"))
    return ranked.unionByName(rows.where("start is null").select("aln_id", "start", F.lit(None).cast("long").alias("rank")))


def blocks_meeting(block_rows: DataFrame, clusters: DataFrame) -> DataFrame:
    """Blocks whose handle range meets a cluster of nodes, each once, for any number of both and ranges of any length."""
    handles = clusters.select((2 * F.col("cluster_min")).alias("low"), (2 * F.col("cluster_max") + 1).alias("high"))
    return overlapping(block_rows, handles, ("min_handle", "max_handle"), ("low", "high")).dropDuplicates(["block_id"])


def node_bitmaps(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, bitmap): the sets of node_id of each key, as bitmaps of 32,768 ids."""
    at = rows.withColumn("bucket", F.bitmap_bucket_number("node_id")).withColumn("bit", F.bitmap_bit_position("node_id"))
    return at.groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def blocks_with_nodes(block_bitmaps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(block_id, shared): blocks whose reads visit some of the nodes, and how many of these they visit. Bitmaps of a bucket
    that both have are and-ed."""
    wanted = node_bitmaps(nodes.select("node_id").distinct()).withColumnRenamed("bitmap", "wanted")
    both = block_bitmaps.join(wanted, "bucket")
    pairs = both.select("block_id", "bucket", F.explode(F.array("bitmap", "wanted")).alias("bitmap"))
    met = pairs.groupBy("block_id", "bucket").agg(F.bitmap_count(F.bitmap_and_agg("bitmap")).alias("n"))
    return met.groupBy("block_id").agg(F.sum("n").alias("shared")).where("shared > 0")


#: Clusters of a node set, and words of 64 ids that these span, that may go to all tasks: 1 MB of them.
MOST_CLUSTERS, MOST_WORDS = 64, 1 << 17


def node_words(nodes: DataFrame) -> list[tuple[int, int, list[int]]] | None:
    """A node set as (first word, last word, words) of its clusters, a bit for each id; None if it is too large to broadcast.
    Only numbers of clusters and words are asked first."""
    runs = clusters(nodes.select("node_id"), 1024).limit(MOST_CLUSTERS + 1).collect()
    spans = [(r.cluster_min >> 6, r.cluster_max >> 6) for r in runs]
    if len(runs) > MOST_CLUSTERS or sum(b - a + 1 for a, b in spans) > MOST_WORDS:
        return None
    word = F.shiftright("node_id", 6)
    rows = nodes.select("node_id").distinct().groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(node_id & 63 as int))")).alias("bits")).collect()
    found = {r.word: r.bits for r in rows}
    return [(a, b, [found.get(k, 0) for k in range(a, b + 1)]) for a, b in spans]


def is_inside(words: list[tuple[int, int, list[int]]], spark) -> tuple[DataFrame, Column]:
    """A row for all tasks that holds a node set, as column `__set`, and whether its bit of column handle is set, as a function."""
    one = spark.createDataFrame([(words,)], "__set array<struct<first: long, last: long, words: array<long>>>")

    def inside(handle: Column) -> Column:
        word, bit = F.shiftright(handle, 7), F.shiftright(handle, 1).bitwiseAND(F.lit(63)).cast("int")
        at = lambda s: F.element_at(s["words"], (word - s["first"] + 1).cast("int"))
        return F.exists("__set", lambda s: (word >= s["first"]) & (word <= s["last"]) & (F.getbit(F.when((word >= s["first"]) & (word <= s["last"]), at(s)), bit) == 1))

    return one, inside


def select(reads: DataFrame, nodes: DataFrame, how: str = OVERLAPPING) -> DataFrame:
    """Reads with a node in the subgraph, or with all of them.

    A node set of up to 1 MB of bits goes to all tasks, and each read looks its nodes up, so reads are neither taken apart nor
    moved; a larger one is joined with the steps of the reads.
    """
    words = node_words(nodes)
    if words is not None:
        one, inside = is_inside(words, reads.sparkSession)
        test = F.forall("path", inside) if how == CONTAINED else F.exists("path", inside)
        return reads.join(F.broadcast(one)).where((F.size("path") > 0) & test).select(*[F.col(f"`{c}`") for c in reads.columns])
    steps = path_steps(reads).withColumn("node_id", node_of(F.col("handle")))
    ids = nodes.select("node_id").distinct()
    if how == CONTAINED:
        outside = steps.join(ids, "node_id", "left_anti").select("aln_id").distinct()
        return reads.where(F.size("path") > 0).join(outside, "aln_id", "left_anti")
    return reads.join(steps.join(ids, "node_id", "left_semi").select("aln_id").distinct(), "aln_id", "left_semi")


def target_lengths(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(aln_id, target_len): the bases of the nodes on each read's path."""
    rows = path_steps(reads).withColumn("node_id", node_of(F.col("handle"))).join(nodes.select("node_id", "seq_len"), "node_id")
    return rows.groupBy("aln_id").agg(F.sum("seq_len").cast("long").alias("target_len"))


def mappings(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each edit on each node: aln_id, op_no, pos, handle, node_start, node_end, node_len, query_start, query_end, op, len, seq.

    Ops and nodes both have ranges of target offsets; an op lies on every node that its range meets. Insertions have no
    target length and stay on the node that ends where they are, at the start of the alignment on the first used node.
    Insertions without a path are on handle 0.
    """
    rows = reads.where(F.size("diff") > 0).select("aln_id", "path", "diff", "path_start", "seq_start")
    ops = rows.select("aln_id", "path_start", "seq_start", F.size("path").alias("n"), F.posexplode("diff").alias("op_no", "d"))
    before = Window.partitionBy("aln_id").orderBy("op_no").rowsBetween(Window.unboundedPreceding, -1)
    target = F.when(F.col("d.op") == "+", 0).otherwise(F.col("d.len"))
    query = F.when(F.col("d.op") == "-", 0).otherwise(F.col("d.len"))
    t0 = F.col("path_start") + F.coalesce(F.sum(target).over(before), F.lit(0))
    ops = ops.withColumn("t0", t0).withColumn("q0", F.col("seq_start") + F.coalesce(F.sum(query).over(before), F.lit(0)))
    ops = ops.withColumn("t1", F.col("t0") + target).withColumn("at_start", F.col("t0") == F.col("path_start"))
    on = path_steps(reads).withColumn("node_id", node_of(F.col("handle"))).join(nodes.select("node_id", "seq_len"), "node_id")
    along = Window.partitionBy("aln_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    on = on.withColumn("n0", F.coalesce(F.sum("seq_len").over(along), F.lit(0))).withColumn("n1", F.col("n0") + F.col("seq_len"))
    on = on.select("aln_id", "pos", "handle", "seq_len", "n0", "n1")
    first = (F.col("n0") <= F.col("path_start")) & (F.col("path_start") < F.col("n1"))
    after = (F.col("n0") < F.col("t0")) & (F.col("t0") <= F.col("n1"))
    start_rule = F.when(F.col("at_start"), first).otherwise(after)
    meets = F.when(F.col("d.op") == "+", start_rule).otherwise((F.col("n0") < F.col("t1")) & (F.col("t0") < F.col("n1")))
    both = ops.where("n > 0").join(on, "aln_id").where(meets)
    lo, hi = F.greatest("t0", "n0"), F.least("t1", "n1")
    size = F.when(F.col("d.op") == "+", F.col("d.len")).otherwise(hi - lo)
    q0 = F.col("q0") + F.when(F.col("d.op").isin(":", "*"), lo - F.col("t0")).otherwise(0)
    q1 = q0 + F.when(F.col("d.op") == "-", 0).otherwise(size)
    lo = F.when(F.col("d.op") == "+", F.col("t0")).otherwise(lo)
    hi = F.when(F.col("d.op") == "+", F.col("t0")).otherwise(hi)
    placed = both.select(
        "aln_id", "op_no", "pos", "handle", (lo - F.col("n0")).alias("node_start"), (hi - F.col("n0")).alias("node_end"), F.col("seq_len").alias("node_len"),
        q0.alias("query_start"), q1.alias("query_end"), F.col("d.op").alias("op"), size.alias("len"), F.col("d.seq").alias("seq"))
    zero = F.lit(0).cast("long")
    free = ops.where("n = 0 and d.op = '+'").select(
        "aln_id", "op_no", zero.alias("pos"), zero.alias("handle"), zero.alias("node_start"), zero.alias("node_end"), zero.alias("node_len"),
        F.col("q0").alias("query_start"), (F.col("q0") + F.col("d.len")).alias("query_end"), F.col("d.op").alias("op"), F.col("d.len").alias("len"), F.col("d.seq").alias("seq"))
    return placed.unionByName(free)


def clip(reads: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Fragments of reads inside the nodes `ids`: one for each maximal run of mappings there, with its own intervals and ops.

    A read without a difference string, a path or an aligned part has none. fragment counts from 1; it is null where the
    only fragment spans the whole query interval.
    """
    usable = reads.where((F.size("diff") > 0) & (F.size("path") > 0) & ~gaf.is_unaligned())
    rows = mappings(usable, nodes).withColumn("node_id", node_of(F.col("handle")))
    wanted = ids.select("node_id", F.lit(True).alias("inside")).distinct()
    rows = rows.join(wanted, "node_id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    order = Window.partitionBy("aln_id").orderBy("op_no", "pos")
    apart = F.coalesce(F.col("inside") != F.lag("inside").over(order), F.lit(True)).cast("int")
    rows = rows.withColumn("run", F.sum(apart).over(order)).where("inside")
    last = F.max_by("node_end", F.struct("op_no", "pos"))
    whole = F.sort_array(F.collect_list(F.struct("op_no", "pos", F.struct("op", "len", "seq").alias("d"))))
    steps = F.sort_array(F.collect_set(F.struct("pos", "handle", "node_len")))
    out = rows.groupBy("aln_id", "run").agg(
        F.min("query_start").alias("seq_start"), F.max("query_end").alias("seq_end"), F.min_by("node_start", F.struct("op_no", "pos")).alias("path_start"),
        last.alias("last_end"), steps.alias("steps"), cs.normalize(whole["d"]).alias("diff"))
    length = F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + x["node_len"])
    out = out.withColumn("path_len", length).withColumn("path", F.transform("steps", lambda x: x["handle"]))
    out = out.withColumn("path_end", F.col("path_len") - F.element_at("steps", -1)["node_len"] + F.col("last_end"))
    number = F.row_number().over(Window.partitionBy("aln_id").orderBy("run")).cast("long")
    total = F.count("*").over(Window.partitionBy("aln_id"))
    out = out.withColumn("number", number).withColumn("total", total)
    kept = reads.select("aln_id", "name", "seq_len", "matches", "edits", "mapq", "score", "base_quality", "pair_name", "pair_is_next", "pair_is_proper", "optional", F.col("seq_start").alias("q0"), F.col("seq_end").alias("q1"))
    out = out.drop("steps", "last_end", "run").join(kept, "aln_id")
    alone = (F.col("total") == 1) & (F.col("seq_start") == F.col("q0")) & (F.col("seq_end") == F.col("q1"))
    mark = F.array(F.struct(F.lit("fi").alias("tag"), F.lit("i").alias("type"), F.col("number").cast("string").alias("value")))
    out = out.withColumn("optional", F.when(alone, F.col("optional")).otherwise(F.concat("optional", mark)))
    return out.withColumn("fragment", F.when(~alone, F.col("number"))).drop("q0", "q1", "number", "total")


def sort_lines(lines: DataFrame, by_hash: bool = False, stable: bool = True, partitions: int | None = None) -> DataFrame:
    """Lines (line_no, value) in the order of their sort key, or of a hash; equal keys in the order of line_no if stable.

    partitions: into how many sorted parts, about; by default as many as the session shuffles into.
    """
    if partitions is not None and partitions < 1:
        raise ValueError("partitions must be greater than 0")
    key = F.xxhash64("value") if by_hash else gaf.sort_key(F.col("value"))
    rows = lines.withColumn("__key", key)
    order = ["__key", *(["line_no"] if stable else [])]
    rows = rows.orderBy(*order) if partitions is None else rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return rows.drop("__key")


def column_bytes(reads: DataFrame) -> DataFrame:
    """One row: the bytes that names, quality strings, optional fields and pair names take, and the number of ops."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).cast("long")
    fields = F.aggregate("optional", F.lit(0), lambda a, x: a + F.octet_length(x["tag"]) + F.octet_length(x["type"]) + F.octet_length(x["value"]) + 2)
    return reads.agg(
        size("name").alias("name_bytes"), size("base_quality").alias("quality_bytes"), F.coalesce(F.sum(fields), F.lit(0)).cast("long").alias("optional_bytes"),
        size("pair_name").alias("pair_name_bytes"), F.coalesce(F.sum(F.greatest(F.size("diff"), F.lit(0))), F.lit(0)).cast("long").alias("diff_ops"))


def roundtrip(reads: DataFrame, nodes: DataFrame) -> DataFrame:
    """What storing reads in blocks changes: exact reads get a match, bases outside ACGT become N, path_len comes from the graph."""
    lengths = target_lengths(reads, nodes)
    whole = F.array(F.struct(F.lit(":").alias("op"), (F.col("seq_end") - F.col("seq_start")).alias("len"), F.lit(None).cast("string").alias("seq")))
    masked = F.transform("diff", lambda x: F.struct(x["op"].alias("op"), x["len"].alias("len"), F.regexp_replace(x["seq"], "[^ACGT]", "N").alias("seq")))
    out = reads.join(lengths, "aln_id", "left").withColumn("path_len", F.coalesce("target_len", F.lit(0).cast("long"))).drop("target_len")
    return out.withColumn("diff", F.when(gaf.is_exact(), whole).otherwise(masked))


def counters(selected: DataFrame, fragments: DataFrame, block_rows: DataFrame) -> DataFrame:
    """One row: the reads of a set, the fragments that clipping made of them, and the blocks that were read for it."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(selected, "reads").join(n(fragments, "fragments"), F.lit(True)).join(n(block_rows, "blocks"), F.lit(True))
