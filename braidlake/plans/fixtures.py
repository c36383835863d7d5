"""A layered graph and reads derived from the driver's tables: one path a customer, one read an event.

Odd steps of a path are anchors that all paths share, even ones one of two alleles, some inverted. The SQL below makes the
same tables; queries compare the two.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlake.operators.locate import short_paths, step_offsets
from braidlake.operators.visits import with_offsets
from braidlake.operators.walks import edges_of_steps
from braidlake.schema import Graph

_CACHE: dict[tuple, Graph] = {}
INDEXED_EVERY, PIECE = 10, 8
#: A read starts at one of so many first steps of its path and has up to so many.
READ_STARTS, READ_STEPS = 20, 5

STEPS = """steps AS (SELECT path_handle, step, 2*node_id + rev AS handle, node_id, rev FROM (
 SELECT o_custkey AS path_handle, step,
  CASE WHEN step % 2 = 1 THEN 1 + 3*CAST(FLOOR((step-1)/2) AS BIGINT) ELSE 2 + 3*CAST(FLOOR((step-2)/2) AS BIGINT) + alt END AS node_id,
  CAST(CASE WHEN step % 2 = 0 AND inv = 1 THEN 1 ELSE 0 END AS BIGINT) AS rev
 FROM (SELECT o_custkey, l_partkey % 2 AS alt, CASE WHEN l_returnflag = 'R' AND l_suppkey % 8 = 0 THEN 1 ELSE 0 END AS inv,
   CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS step
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey) a) b)"""
NODES = """nodes AS (SELECT node_id, substr(repeat('ACGTTGCAAC',3), CAST(1+node_id%10 AS INT), CAST(1+node_id%5 AS INT)) AS sequence,
 CAST(1+node_id%5 AS BIGINT) AS seq_len FROM (SELECT DISTINCT node_id FROM steps) d)"""
EDGES = """e0 AS (SELECT DISTINCT a, b FROM (SELECT handle AS a, LEAD(handle) OVER (PARTITION BY path_handle ORDER BY step) AS b FROM steps) x WHERE b IS NOT NULL),
edges AS (SELECT a AS src, b AS dst FROM e0 UNION SELECT b + 1 - 2*(b%2), a + 1 - 2*(a%2) FROM e0)"""
OFFSETS = """offsets AS (SELECT path_handle, step, handle, s.node_id, rev, CAST(SUM(seq_len) OVER (PARTITION BY path_handle ORDER BY step) - seq_len AS BIGINT) AS step_start,
 CAST(SUM(seq_len) OVER (PARTITION BY path_handle ORDER BY step) AS BIGINT) AS step_end FROM steps s JOIN nodes n ON s.node_id = n.node_id)"""
LINKS = """l0 AS (SELECT 2*node_id AS handle, 2*node_id + 6 AS next FROM nodes WHERE node_id % 3 = 1 AND node_id + 3 IN (SELECT node_id FROM nodes)),
links AS (SELECT handle, next FROM l0 UNION ALL SELECT next + 1, handle + 1 FROM l0)"""
PATHS = """paths AS (SELECT path_handle, concat('c', CAST(path_handle AS VARCHAR)) AS sample, n_name AS contig, path_handle % 2 AS haplotype, CAST(0 AS BIGINT) AS fragment,
 path_handle % 10 = 0 AS is_indexed, path_len FROM (SELECT path_handle, CAST(MAX(step_end) AS BIGINT) AS path_len FROM offsets GROUP BY path_handle) p
 JOIN customer ON c_custkey = path_handle JOIN nation ON n_nationkey = c_nationkey)"""
FRAGMENTS = """fragments AS (SELECT path_handle * 1000 + CAST(FLOOR((step-1)/8) AS BIGINT) AS path_handle, concat('c', CAST(path_handle AS VARCHAR)) AS sample, MIN(step_start) AS fragment
 FROM offsets GROUP BY path_handle, CAST(FLOOR((step-1)/8) AS BIGINT))"""
MOVES = """moves AS (SELECT node_id AS n1, CAST(0 AS BIGINT) AS s1, node_id AS n2, CAST(1 AS BIGINT) AS s2, seq_len-1 AS w FROM nodes UNION ALL
 SELECT node_id, CAST(1 AS BIGINT), node_id, CAST(0 AS BIGINT), seq_len-1 FROM nodes UNION ALL
 SELECT CAST(FLOOR(src/2) AS BIGINT), 1-src%2, CAST(FLOOR(dst/2) AS BIGINT), dst%2, CAST(1 AS BIGINT) FROM edges)"""
READS = """w AS (SELECT e.event_id, string_agg(concat(CASE WHEN s.rev=0 THEN '>' ELSE '<' END, CAST(s.node_id AS VARCHAR)), '' ORDER BY s.step) AS path,
  CAST(SUM(n.seq_len) AS BIGINT) AS path_len, MIN(s.handle) AS min_handle, MAX(s.handle) AS max_handle FROM events e
  JOIN steps s ON s.path_handle = e.user_id AND s.step BETWEEN 1 + e.event_id % 20 AND 5 + e.event_id % 20 JOIN nodes n ON n.node_id = s.node_id GROUP BY e.event_id),
ok AS (SELECT * FROM w WHERE path_len >= 5),
r0 AS (SELECT e.event_id AS aln_id, e.event_type, concat('r', CAST(e.event_id AS VARCHAR)) AS name, coalesce(ok.path, '*') AS path, coalesce(ok.path_len, 0) AS path_len,
 CASE WHEN ok.path IS NULL THEN NULL WHEN e.event_type = 'click' THEN concat(':', CAST(ok.path_len-1 AS VARCHAR)) WHEN e.event_type = 'error' THEN concat(':1*AC:', CAST(ok.path_len-2 AS VARCHAR))
  WHEN e.event_type = 'purchase' THEN concat(':1+GAT:', CAST(ok.path_len-1 AS VARCHAR)) WHEN e.event_type = 'signup' THEN concat(':1-AA:', CAST(ok.path_len-3 AS VARCHAR))
  ELSE concat(':', CAST(ok.path_len AS VARCHAR)) END AS cs,
 CAST(CASE WHEN e.event_type = 'click' AND ok.path IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS path_start,
 CASE WHEN e.event_id % 10 = 0 THEN 255 ELSE e.event_id % 61 END AS mapq0, ok.min_handle, ok.max_handle FROM events e LEFT JOIN ok ON ok.event_id = e.event_id),
reads AS (SELECT *, CASE WHEN cs IS NULL THEN 0 WHEN event_type = 'click' THEN path_len - 1 WHEN event_type = 'purchase' THEN path_len + 3 WHEN event_type = 'signup' THEN path_len - 2 ELSE path_len END AS seq_len,
 CASE WHEN cs IS NULL THEN 0 ELSE path_len END AS path_end,
 CASE WHEN cs IS NULL THEN 0 WHEN event_type = 'click' OR event_type = 'error' THEN path_len - 1 WHEN event_type = 'signup' THEN path_len - 2 ELSE path_len END AS matches,
 CASE WHEN cs IS NULL THEN 0 WHEN event_type = 'error' THEN 1 WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'signup' THEN 2 ELSE 0 END AS edits FROM r0),
lines AS (SELECT aln_id, concat(name, '\t', CAST(seq_len AS VARCHAR), '\t0\t', CAST(seq_len AS VARCHAR), '\t+\t', path, '\t', CAST(path_len AS VARCHAR), '\t', CAST(path_start AS VARCHAR), '\t', CAST(path_end AS VARCHAR), '\t',
 CAST(matches AS VARCHAR), '\t', CAST(matches + edits AS VARCHAR), '\t', CAST(mapq0 AS VARCHAR), '\tAS:i:', CAST(aln_id % 100 - 20 AS VARCHAR),
 CASE WHEN cs IS NULL THEN '' ELSE concat('\tcs:Z:', cs) END, CASE WHEN aln_id % 4 = 0 THEN concat('\tfn:Z:r', CAST(aln_id + 1 AS VARCHAR), '\tpd:b:1') WHEN aln_id % 4 = 1 THEN concat('\tfp:Z:r', CAST(aln_id - 1 AS VARCHAR), '\tpd:b:0') ELSE '' END,
 '\txx:Z:', event_type) AS line FROM reads)"""
VISITS = """vs AS (SELECT 2*path_handle AS seq, step AS idx, handle FROM steps UNION ALL SELECT 2*path_handle + 1, -step, handle + 1 - 2*(handle%2) FROM steps),
vl AS (SELECT seq, list(handle ORDER BY idx DESC) AS back, MAX(idx) AS top FROM vs GROUP BY seq),
vr AS (SELECT seq, idx, handle, ROW_NUMBER() OVER (PARTITION BY handle ORDER BY list_append(back[top - idx + 2:], seq - 1000000000000)) - 1 AS "offset" FROM vs JOIN vl USING (seq)),
placed AS (SELECT path_handle, step, s.handle, f."offset", b."offset" AS flip_offset FROM steps s JOIN vr f ON f.seq = 2*path_handle AND f.idx = step JOIN vr b ON b.seq = 2*path_handle + 1 AND b.idx = -step)"""
NATIONS = """ns AS (SELECT 1000000 * (c_nationkey + 1) AS base, path_handle, step, 2*(1000000 * (c_nationkey + 1) + node_id) + CASE WHEN c_nationkey % 2 = 0 THEN 0 ELSE rev END AS handle FROM steps JOIN customer ON c_custkey = path_handle),
n0 AS (SELECT DISTINCT base, a, b FROM (SELECT base, handle AS a, LEAD(handle, 1, 2*(base + 999999)) OVER (PARTITION BY path_handle ORDER BY step) AS b FROM ns UNION ALL SELECT base, 2*base, handle FROM ns WHERE step = 1) x),
ne AS (SELECT base, a AS src, b AS dst FROM n0 UNION SELECT base, b + 1 - 2*(b%2), a + 1 - 2*(a%2) FROM n0)"""
ALL = ",\n".join([STEPS, NODES, EDGES, OFFSETS, LINKS, PATHS, FRAGMENTS, MOVES, READS])


def sql(select: str) -> str:
    """The select over all fixture tables, as one statement for the other engine."""
    return f"WITH RECURSIVE {ALL}{'' if select.lstrip().startswith(',') else chr(10)}{select}"


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("step", F.row_number().over(order).cast("long"))
    odd = F.col("step") % 2 == 1
    node = F.when(odd, 1 + 3 * F.floor((F.col("step") - 1) / 2)).otherwise(2 + 3 * F.floor((F.col("step") - 2) / 2) + F.col("l_partkey") % 2).cast("long")
    rev = (~odd & (F.col("l_returnflag") == "R") & (F.col("l_suppkey") % 8 == 0)).cast("long")
    return rows.select(F.col("o_custkey").alias("path_handle"), "step", (2 * node + rev).alias("handle"))


def load(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder of tables, cached for the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _CACHE:
        return _CACHE[key]
    raw = steps(spark, sf_dir).sortWithinPartitions("path_handle", "step").persist()  # what follows reads paths in this order
    short = short_paths(raw)
    node_id = F.col("node_id")
    nodes = raw.select(F.shiftright("handle", 1).alias("node_id")).distinct()
    sequence = F.substr(F.repeat(F.lit("ACGTTGCAAC"), 3), (1 + node_id % 10).cast("int"), (1 + node_id % 5).cast("int"))
    nodes = nodes.select("node_id", sequence.alias("sequence"), (1 + node_id % 5).alias("seq_len")).persist()
    edges = edges_of_steps(raw, short).persist()
    offsets = step_offsets(raw, nodes, short).sortWithinPartitions("path_handle", "step").persist()
    anchors = nodes.where("node_id % 3 = 1").select("node_id")
    pairs = anchors.join(anchors.select((F.col("node_id") - 3).alias("node_id")), "node_id").select((2 * node_id).alias("handle"), (2 * node_id + 6).alias("next"))
    links = pairs.unionByName(pairs.select((F.col("next") + 1).alias("handle"), (F.col("handle") + 1).alias("next"))).persist()
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    lengths = offsets.groupBy("path_handle").agg(F.max("step_end").alias("path_len"))
    paths = lengths.join(customer, F.col("path_handle") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    paths = paths.select(
        "path_handle", F.concat(F.lit("c"), F.col("path_handle").cast("string")).alias("sample"), F.col("n_name").alias("contig"), (F.col("path_handle") % 2).alias("haplotype"),
        F.lit(0).cast("long").alias("fragment"), (F.col("path_handle") % INDEXED_EVERY == 0).alias("is_indexed"), "path_len").persist()
    tags = spark.createDataFrame([("gbwt_source", "braidlake"), ("gbwt_kind", "layered"), ("gbz_version", "1"), ("gbz_gbz_note", "x"), ("other", "y")], "key string, value string")
    _CACHE[key] = Graph(nodes, edges, offsets, paths, links, tags)
    return _CACHE[key]


def placed(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph whose steps have the places of their visits, cached for the session."""
    key = (spark.sparkContext.applicationId, sf_dir, "placed")
    if key not in _CACHE:
        graph = load(spark, sf_dir)
        _CACHE[key] = replace(graph, steps=with_offsets(graph.steps).persist())
    return _CACHE[key]


def nations(spark: SparkSession, sf_dir: str) -> Graph:
    """A graph with a component for each nation: the steps of its customers between a first and a last node, so that it has
    two tips. Every other nation has inverted steps, and so walks that turn back."""
    graph = load(spark, sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("path_handle"), "c_nationkey")
    base = 1_000_000 * (F.col("c_nationkey") + 1).cast("long")
    rev = F.when(F.col("c_nationkey") % 2 == 0, 0).otherwise(F.col("handle").bitwiseAND(F.lit(1)))
    rows = graph.steps.select("path_handle", "step", "handle").join(customer, "path_handle")
    rows = rows.select("path_handle", base.alias("base"), "step", (2 * (base + F.shiftright("handle", 1)) + rev).alias("handle"))
    last = Window.partitionBy("path_handle").orderBy("step")
    pairs = rows.select(F.col("handle").alias("a"), F.coalesce(F.lead("handle").over(last), 2 * (F.col("base") + 999_999)).alias("b"))
    pairs = pairs.unionByName(rows.where("step = 1").select((2 * F.col("base")).alias("a"), F.col("handle").alias("b"))).distinct()
    one = F.lit(1)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").bitwiseXOR(one).alias("src"), F.col("a").bitwiseXOR(one).alias("dst"))).distinct()
    nodes = edges.select(F.shiftright("src", 1).alias("node_id")).distinct().select("node_id", F.lit("A").alias("sequence"), F.lit(1).cast("long").alias("seq_len"))
    return Graph(nodes, edges, graph.steps.limit(0), graph.paths.limit(0), graph.chain_links.limit(0), graph.tags)


def fragments(graph: Graph) -> DataFrame:
    """Paths cut every few steps into fragments that start at their offset."""
    rows = graph.steps.withColumn("piece", F.floor((F.col("step") - 1) / PIECE))
    rows = rows.groupBy("path_handle", "piece").agg(F.min("step_start").alias("fragment"))
    return rows.select((F.col("path_handle") * 1000 + F.col("piece")).alias("path_handle"), F.concat(F.lit("c"), F.col("path_handle").cast("string")).alias("sample"), F.lit("x").alias("contig"), F.lit(0).cast("long").alias("haplotype"), "fragment")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aln_id, value): the reads as text lines."""
    graph = load(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    after = Window.partitionBy("path_handle").orderBy("step")
    ahead = lambda c: [F.col(c), *[F.lead(c, k).over(after) for k in range(1, READ_STEPS)]]
    rows = graph.steps.where(F.col("step") < READ_STARTS + READ_STEPS)
    rows = rows.select("path_handle", "step", "step_start", F.array(*ahead("handle")).alias("walk"), F.greatest(*ahead("step_end")).alias("end")).where(F.col("step") <= READ_STARTS)
    rows = rows.select("path_handle", "step", F.filter("walk", lambda h: h.isNotNull()).alias("walk"), (F.col("end") - F.col("step_start")).alias("path_len"))
    from braidlake.schema import walk_text

    # events go to the paths, each to the steps that a read may start at; as no key, the step leaves paths where they are
    on = (F.col("path_handle") == F.col("user_id")) & (F.col("step") - 1 - F.col("event_id") % READ_STARTS == 0)
    rows = events.join(rows.where("path_len >= 5"), on, "left")
    kind, n, text = F.col("event_type"), F.col("path_len"), lambda x: x.cast("string")
    cs = F.when(kind == "click", F.concat(F.lit(":"), text(n - 1))).when(kind == "error", F.concat(F.lit(":1*AC:"), text(n - 2))).when(kind == "purchase", F.concat(F.lit(":1+GAT:"), text(n - 1)))
    cs = cs.when(kind == "signup", F.concat(F.lit(":1-AA:"), text(n - 3))).otherwise(F.concat(F.lit(":"), text(n)))
    size = F.when(kind == "click", n - 1).when(kind == "purchase", n + 3).when(kind == "signup", n - 2).otherwise(n)
    match = F.when(kind.isin("click", "error"), n - 1).when(kind == "signup", n - 2).otherwise(n)
    edits = F.when(kind == "error", 1).when(kind == "purchase", 3).when(kind == "signup", 2).otherwise(0)
    or0 = lambda x: text(F.coalesce(F.when(n.isNotNull(), x), F.lit(0)))
    i = F.col("event_id")
    pair = F.when(i % 4 == 0, F.concat(F.lit("\tfn:Z:r"), text(i + 1), F.lit("\tpd:b:1"))).when(i % 4 == 1, F.concat(F.lit("\tfp:Z:r"), text(i - 1), F.lit("\tpd:b:0"))).otherwise("")
    main = F.concat_ws(
        "\t", F.concat(F.lit("r"), text(i)), or0(size), F.lit("0"), or0(size), F.lit("+"), F.coalesce(walk_text(F.col("walk")), F.lit("*")), or0(n), or0(F.when(kind == "click", 1).otherwise(0)), or0(n),
        or0(match), or0(match + edits), text(F.when(i % 10 == 0, 255).otherwise(i % 61)), F.concat(F.lit("AS:i:"), text(i % 100 - 20)))
    return rows.select(i.alias("aln_id"), F.concat(main, F.coalesce(F.concat(F.lit("\tcs:Z:"), F.when(n.isNotNull(), cs)), F.lit("")), pair, F.lit("\txx:Z:"), kind).alias("value"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlake.functions import gaf

    return gaf.parse_lines(lines(spark, sf_dir))
