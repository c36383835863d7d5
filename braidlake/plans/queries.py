"""One query for each operator over the fixture graph, and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions import cs, gaf, mapping, seq
from braidlake.operators import chains, cigar, contexts, locate, traverse, visits, walks
from braidlake.operators import reads as R
from braidlake.operators._shared import ensure_checkpoint, numbered
from braidlake.plans import fixtures
from braidlake.plans.query import DISTINCT, REFERENCE, SlidingContext, SubgraphQuery, run, slide
from braidlake.schema import Graph, flipped_path, is_reverse, node_of, walk_text
from braidlake.sources import formats, store
from braidlake.sources import text as text_io
from braidlake.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LO, HI = 10, 40


def query(sql: str | None = None):
    """Registers a function of the graph (and, if it takes more, the session and folder) with its SQL over the fixture tables."""

    def add(f):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            args = (fixtures.load(spark, sf_dir), spark, sf_dir)
            return f(*args[: f.__code__.co_argcount])

        QUERIES[f.__name__] = call
        if sql:
            SQL[f.__name__] = fixtures.sql(sql)
        return f

    return add


def region(graph: Graph) -> DataFrame:
    return graph.nodes.where(F.col("node_id").between(LO, HI)).select("node_id")


SIGN = "CASE WHEN {h} % 2 = 0 THEN '>' ELSE '<' END"
NODE = "CAST(FLOOR({h}/2) AS BIGINT)"
FLIP = "{h} + 1 - 2*({h} % 2)"
CANONICAL = "CASE WHEN src % 2 = 0 THEN FLOOR(dst/2) >= FLOOR(src/2) ELSE FLOOR(dst/2) > FLOOR(src/2) OR (FLOOR(dst/2) = FLOOR(src/2) AND dst % 2 = 0) END"
INSIDE = f"FLOOR(src/2) BETWEEN {LO} AND {HI} AND FLOOR(dst/2) BETWEEN {LO} AND {HI}"


# --- scans and lookups ---------------------------------------------------------------------------------------------


@query("SELECT node_id, sequence, seq_len FROM nodes")
def nodes_scan(g):
    return g.nodes


@query("SELECT src, dst FROM edges")
def edges_scan(g):
    return g.edges


@query("SELECT path_handle, step, handle, step_start, step_end FROM offsets")
def step_offsets(g):
    return g.steps


@query("SELECT path_handle, sample, contig, haplotype, fragment, is_indexed, path_len FROM paths")
def paths_scan(g):
    return g.paths


@query("SELECT handle, next FROM links ORDER BY handle")
def chain_links_scan(g):
    return g.chain_links.orderBy("handle")


@query("""SELECT 'nodes' AS key, CAST(COUNT(*) AS VARCHAR) AS value FROM nodes UNION ALL SELECT 'chain_links', CAST(COUNT(*) AS VARCHAR) FROM links
UNION ALL SELECT 'chains', CAST(COUNT(*)//2 AS VARCHAR) FROM links WHERE handle NOT IN (SELECT next FROM links) UNION ALL SELECT 'paths', CAST(COUNT(*) AS VARCHAR) FROM paths
UNION ALL SELECT 'samples', CAST(COUNT(DISTINCT sample) AS VARCHAR) FROM paths UNION ALL SELECT 'haplotypes', CAST(COUNT(DISTINCT (sample, haplotype)) AS VARCHAR) FROM paths
UNION ALL SELECT 'contigs', CAST(COUNT(DISTINCT contig) AS VARCHAR) FROM paths""")
def graph_header_counts(g):
    return store.header_counts(g)


@query("""SELECT substr(key, 6) AS key, value FROM (SELECT concat(CASE n_nationkey % 4 WHEN 0 THEN 'gbwt_' WHEN 1 THEN 'gbwt_gbwt_' WHEN 2 THEN 'gbwtx' ELSE 'gbz_gbwt_' END, n_name) AS key, CAST(n_regionkey AS VARCHAR) AS value FROM nation) t WHERE starts_with(key, 'gbwt_')""")
def tags_by_prefix(g, spark, sf_dir):
    """Tags made of the nations' names, of which some have the prefix, twice or inside."""
    kind = F.col("n_nationkey") % 4
    prefix = F.when(kind == 0, "gbwt_").when(kind == 1, "gbwt_gbwt_").when(kind == 2, "gbwtx").otherwise("gbz_gbwt_")
    tags = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(prefix, F.col("n_name")).alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return store.tags_with_prefix(tags, "gbwt_")


REVCOMP = "reverse(translate(sequence, 'ACGT', 'TGCA'))"


@query(f"""SELECT 2*n.node_id + o.rev AS handle, CASE WHEN o.rev = 0 THEN sequence ELSE {REVCOMP} END AS sequence, l.next, s.successors
FROM nodes n CROSS JOIN (SELECT 0 AS rev UNION ALL SELECT 1) o LEFT JOIN links l ON l.handle = 2*n.node_id + o.rev
LEFT JOIN (SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS successors FROM edges GROUP BY src) s ON s.src = 2*n.node_id + o.rev
WHERE n.node_id IN (1, 2, 22, 40, 999999)""")
def node_point_lookup(g):
    wanted = g.nodes.where(F.col("node_id").isin(1, 2, 22, 40, 999999))
    rows = store.oriented_nodes(Graph(wanted, g.edges, g.steps, g.paths, g.chain_links, g.tags))
    out = F.array_join(F.transform(F.sort_array(F.collect_list("dst")), lambda x: x.cast("string")), ",")
    near = g.edges.groupBy(F.col("src").alias("handle")).agg(out.alias("successors"))
    return rows.join(g.chain_links, "handle", "left").join(near, "handle", "left").select("handle", "sequence", "next", "successors")


@query(f"SELECT src, dst FROM edges WHERE {NODE.format(h='src')} BETWEEN {LO} AND {HI} AND dst > 0")
def successors(g):
    return g.edges.where(node_of(F.col("src")).between(LO, HI) & (F.col("dst") > 0))


@query(f"SELECT {FLIP.format(h='src')} AS handle, {FLIP.format(h='dst')} AS predecessor FROM edges WHERE FLOOR(src/2) = 22")
def predecessors(g):
    rows = g.edges.where(node_of(F.col("src")) == 22)
    return rows.select(F.col("src").bitwiseXOR(F.lit(1)).alias("handle"), F.col("dst").bitwiseXOR(F.lit(1)).alias("predecessor"))


@query(f"SELECT src, dst FROM edges WHERE {INSIDE}")
def induced_edges(g):
    ids = region(g)
    return g.edges.join(ids, node_of(F.col("src")) == F.col("node_id"), "left_semi").join(ids, node_of(F.col("dst")) == F.col("node_id"), "left_semi")


@query("SELECT src AS handle, COUNT(*) AS out_degree FROM edges GROUP BY src")
def degree_stats(g):
    return traverse.degrees(g.edges)


@query(f"SELECT src, dst FROM edges WHERE {CANONICAL}")
def canonical_edges(g):
    return walks.canonical_edges(g.edges)


@query(f"SELECT (SELECT COUNT(*) FROM nodes) AS nodes, (SELECT COUNT(*) FROM edges WHERE {CANONICAL}) AS edges, (SELECT CAST(SUM(seq_len) AS BIGINT) FROM nodes) AS bases")
def graph_statistics(g):
    return walks.statistics(g)


@query("SELECT path_handle, contig, haplotype, path_len FROM paths WHERE sample IN ('c7', 'c10') ORDER BY path_handle")
def paths_for_sample(g):
    return g.paths.where(F.col("sample").isin("c7", "c10")).select("path_handle", "contig", "haplotype", "path_len").orderBy("path_handle")


@query(f"SELECT MIN(node_id) AS min_node, MAX(node_id) AS max_node, COUNT(*) AS n FROM nodes WHERE node_id BETWEEN {LO} AND {HI}")
def node_range(g):
    return region(g).agg(F.min("node_id").alias("min_node"), F.max("node_id").alias("max_node"), F.count("*").alias("n"))


# --- as-of and interval joins --------------------------------------------------------------------------------------


def place_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    sample = F.concat(F.lit("c"), F.col("user_id").cast("string"))
    return events.select(F.col("event_id").alias("query_id"), sample.alias("sample"), F.lit("x").alias("contig"), F.lit(0).cast("long").alias("haplotype"), (F.col("event_id") % 97).alias("offset"))


PLACES = ", pq AS (SELECT event_id AS query_id, concat('c', CAST(user_id AS VARCHAR)) AS sample, event_id % 97 AS \"offset\" FROM events)"


@query(PLACES + """ SELECT q.query_id, f.path_handle, f.fragment, q."offset" - f.fragment AS path_offset FROM pq q ASOF LEFT JOIN fragments f ON q.sample = f.sample AND q."offset" >= f.fragment""")
def find_path_asof(g, spark, sf_dir):
    found = locate.find_paths(place_queries(spark, sf_dir), fixtures.fragments(g))
    return found.select("query_id", "path_handle", "fragment", "path_offset")


INDEX = """, ix AS (SELECT o.path_handle, o.step_start AS path_offset, o.handle AS node_handle, o.step FROM offsets o JOIN paths p ON p.path_handle = o.path_handle WHERE p.is_indexed AND o.step = 1
UNION ALL SELECT n.path_handle, n.step_start, n.handle, n.step FROM ix JOIN LATERAL (SELECT * FROM offsets o WHERE o.path_handle = ix.path_handle AND o.step_start >= ix.path_offset + 20 ORDER BY o.step_start LIMIT 1) n ON true)"""


@query(INDEX + " SELECT path_handle, path_offset, node_handle, step FROM ix")
def reference_index(g):
    return locate.reference_index(g.steps, g.paths, 20)


@query("SELECT o.path_handle, o.step_start AS path_offset, o.handle AS node_handle, o.step FROM offsets o JOIN paths p ON p.path_handle = o.path_handle WHERE p.is_indexed")
def reference_index_all(g):
    """An index of every node of the indexed paths."""
    return locate.reference_index(g.steps, g.paths, 0)


@query(INDEX + ", pq AS (SELECT event_id AS query_id, user_id AS path_handle, event_id % 97 AS \"at\" FROM events) SELECT q.query_id, q.path_handle, x.path_offset, x.node_handle, x.step FROM pq q ASOF LEFT JOIN ix x ON q.path_handle = x.path_handle AND q.\"at\" >= x.path_offset")
def indexed_position_asof(g, spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    q = events.select(F.col("event_id").alias("query_id"), F.col("user_id").alias("path_handle"), (F.col("event_id") % 97).alias("at"))
    found = locate.indexed_positions(q, locate.reference_index(g.steps, g.paths, 20))
    return found.select("query_id", "path_handle", "path_offset", "node_handle", "step")


@query("SELECT e.event_id AS query_id, e.user_id AS path_handle, o.step, o.handle, e.event_id % 97 - o.step_start AS node_offset FROM events e JOIN offsets o ON o.path_handle = e.user_id AND o.step_start <= e.event_id % 97 AND e.event_id % 97 < o.step_end")
def offset_to_position(g, spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    q = events.select(F.col("event_id").alias("query_id"), F.col("user_id").alias("path_handle"), (F.col("event_id") % 97).alias("path_offset"))
    return locate.offset_to_position(q, g.steps).select("query_id", "path_handle", "step", "handle", "node_offset")


@query("SELECT e.event_id AS query_id, o.step, o.handle FROM events e JOIN offsets o ON o.path_handle = e.user_id AND o.step_start < e.event_id % 97 + 15 AND o.step_end > e.event_id % 97")
def interval_to_nodes(g, spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.col("event_id") % 97
    q = events.select(F.col("event_id").alias("query_id"), F.col("user_id").alias("path_handle"), at.alias("start"), (at + 15).alias("end"))
    return locate.interval_to_steps(q, g.steps).select("query_id", "step", "handle")


@query("SELECT MIN(node_id) AS cluster_min, MAX(node_id) AS cluster_max, COUNT(*) AS n FROM (SELECT node_id, SUM(CASE WHEN gap > 1 THEN 1 ELSE 0 END) OVER (ORDER BY node_id) AS c FROM (SELECT node_id, node_id - LAG(node_id) OVER (ORDER BY node_id) AS gap FROM nodes) x) y GROUP BY c")
def node_id_clusters(g):
    return locate.clusters(g.nodes, gap=1)


# --- traversals ----------------------------------------------------------------------------------------------------

CONTEXT = "ctx AS ({seeds} UNION SELECT m.n2, m.s2, c.d + m.w FROM ctx c JOIN moves m ON m.n1 = c.n AND m.s1 = c.s WHERE c.d + m.w <= {limit}) SELECT n AS node_id, CAST(MIN(d) AS BIGINT) AS dist FROM ctx GROUP BY n"


def _context(g: Graph, seeds, limit: int) -> DataFrame:
    def in_frames():
        df = g.spark.createDataFrame([(0, *s) for s in seeds], "query_id long, node_id long, side int, dist long")
        return contexts.contexts(g, df, limit).select("node_id", "dist")

    return traverse.tiered(g, lambda near: g.spark.createDataFrame(sorted(near.context(seeds, limit).items()), "node_id long, dist long"), in_frames)


def _ids(g: Graph, nodes) -> DataFrame:
    return g.spark.createDataFrame([(n,) for n in sorted(nodes)], "node_id long")


SEED_40 = "SELECT CAST(40 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS d UNION ALL SELECT 40, 1, 0"


@query(", " + CONTEXT.format(seeds=f"SELECT * FROM ({SEED_40}) z", limit=20))
def context_nodes(g):
    return _context(g, [(40, 0, 0), (40, 1, 0)], 20)


@query(", " + CONTEXT.format(seeds="SELECT CAST(FLOOR(o.handle/2) AS BIGINT) AS n, CASE WHEN k = 0 THEN o.handle % 2 ELSE 1 - o.handle % 2 END AS s, CASE WHEN k = 0 THEN 33 - o.step_start ELSE o.step_end - 34 END AS d FROM offsets o CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) z WHERE o.path_handle = 10 AND o.step_start <= 33 AND 33 < o.step_end", limit=12))
def context_position(g):
    s = locate.offset_to_position(F.broadcast(g.spark.createDataFrame([(0, 10, 33)], "query_id long, path_handle long, path_offset long")), g.steps).first()
    rev = s.handle & 1
    return _context(g, [(s.handle >> 1, rev, s.node_offset), (s.handle >> 1, 1 - rev, s.step_end - s.step_start - s.node_offset - 1)], 12)


@query(", " + CONTEXT.format(seeds="SELECT CAST(FLOOR(o.handle/2) AS BIGINT) AS n, CASE WHEN k = 0 THEN o.handle % 2 ELSE 1 - o.handle % 2 END AS s, CASE WHEN k = 0 THEN GREATEST(20 - o.step_start, 0) WHEN o.step_end > 45 THEN o.step_end - 46 ELSE 0 END AS d FROM offsets o CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) z WHERE o.path_handle = 10 AND o.step_start < 45 AND o.step_end > 20", limit=8))
def context_interval(g):
    from braidlake.plans.query import seeds_of

    row = g.paths.where("path_handle = 10").first()
    seeds, _ = seeds_of(g, SubgraphQuery.path_interval(row.contig, 20, 45, sample=row.sample, haplotype=row.haplotype))
    return _context(g, seeds, 8)


@query(", " + CONTEXT.format(seeds=f"SELECT * FROM ({SEED_40}) z", limit=6))
def context_frontier(g):
    """The second tier: a frontier a round in DataFrames."""
    seeds = g.spark.createDataFrame([(0, 40, 0, 0), (0, 40, 1, 0)], "query_id long, node_id long, side int, dist long")
    return contexts.contexts(g, seeds, 6).select("node_id", "dist")


@query(", ctx AS (SELECT node_id AS q, node_id AS n, s, CAST(0 AS BIGINT) AS d FROM nodes CROSS JOIN (SELECT CAST(0 AS BIGINT) AS s UNION ALL SELECT 1) z UNION SELECT c.q, m.n2, m.s2, c.d + m.w FROM ctx c JOIN moves m ON m.n1 = c.n AND m.s1 = c.s WHERE c.d + m.w <= 9) SELECT q AS query_id, n AS node_id, CAST(MIN(d) AS BIGINT) AS dist FROM ctx GROUP BY q, n")
def context_many(g):
    """The contexts of all nodes, each a query of its own, at once."""
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    return contexts.contexts(g, g.nodes.select(F.col("node_id").alias("query_id"), "node_id", sides, F.lit(0).alias("dist")), 9)


@query(""", wq AS (SELECT unnest(range(0, path_len, 20)) AS pos FROM paths WHERE path_handle = 10),
 ctx AS (SELECT q.pos, CAST(FLOOR(o.handle/2) AS BIGINT) AS n, CASE WHEN k = 0 THEN o.handle % 2 ELSE 1 - o.handle % 2 END AS s, CASE WHEN k = 0 THEN q.pos - o.step_start ELSE o.step_end - q.pos - 1 END AS d
  FROM wq q JOIN offsets o ON o.path_handle = 10 AND o.step_start <= q.pos AND q.pos < o.step_end CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) z
  UNION SELECT c.pos, m.n2, m.s2, c.d + m.w FROM ctx c JOIN moves m ON m.n1 = c.n AND m.s1 = c.s WHERE c.d + m.w <= 15),
 win AS (SELECT DISTINCT pos, n FROM ctx)
 SELECT pos, n AS node_id, 'inserted' AS change FROM win w WHERE NOT EXISTS (SELECT 1 FROM win b WHERE b.pos = w.pos - 20 AND b.n = w.n)
 UNION ALL SELECT pos + 20, n, 'removed' FROM win w WHERE pos + 20 IN (SELECT pos FROM wq) AND NOT EXISTS (SELECT 1 FROM win b WHERE b.pos = w.pos + 20 AND b.n = w.n)""")
def window_slides(g):
    """A window along a whole path: what each move brings in and leaves behind."""
    row, out = g.paths.where("path_handle = 10").first(), []
    window = SlidingContext(g)
    for at in range(0, row.path_len, 20):
        changes = window.move(SubgraphQuery.path_offset(row.contig, at, sample=row.sample, haplotype=row.haplotype).with_(context=15))
        out += [(at, n, change) for change, nodes in zip(("inserted", "removed"), changes, strict=True) for n in nodes]
    return g.spark.createDataFrame(out, "pos long, node_id long, change string")


@query(f""", mv AS (SELECT DISTINCT path_handle AS w, CAST(FLOOR((step - 1) / 5) AS BIGINT) - k AS mv, {NODE.format(h='handle')} AS n FROM steps CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) y WHERE FLOOR((step - 1) / 5) >= k),
 ctx AS (SELECT w, mv, n, s, CAST(0 AS BIGINT) AS d FROM mv CROSS JOIN (SELECT CAST(0 AS BIGINT) AS s UNION ALL SELECT 1) z UNION SELECT c.w, c.mv, m.n2, m.s2, c.d + m.w FROM ctx c JOIN moves m ON m.n1 = c.n AND m.s1 = c.s WHERE c.d + m.w <= 6),
 win AS (SELECT DISTINCT w, mv, n FROM ctx), tops AS (SELECT w, MAX(mv) AS top FROM mv GROUP BY w)
 SELECT w AS window_id, mv AS move, n AS node_id, 'inserted' AS change FROM win ANTI JOIN (SELECT w, mv + 1 AS mv, n FROM win) b USING (w, mv, n)
 UNION ALL SELECT w, mv + 1, n, 'removed' FROM win JOIN tops USING (w) WHERE mv < top AND NOT EXISTS (SELECT 1 FROM win b WHERE b.w = win.w AND b.mv = win.mv + 1 AND b.n = win.n)""")
def window_states(g):
    """A window of ten steps along each path, five at a time: what each move brings in and leaves, from kept distances."""
    at = F.floor((F.col("step") - 1) / 5)
    sides = [F.struct(node_of(F.col("handle")).alias("node_id"), F.lit(side).alias("side"), F.lit(0).cast("long").alias("dist")) for side in (0, 1)]
    seeds = g.steps.select("path_handle", F.explode(F.when(at > 0, F.array(at, at - 1)).otherwise(F.array(at))).alias("move"), F.explode(F.array(*sides)).alias("seed"))
    moves = seeds.groupBy(F.col("path_handle").alias("window_id"), "move").agg(F.collect_set("seed").alias("seeds"))  # ten steps at most
    return windows.slide_windows(moves, contexts.Adjacency(g), 6).drop("settled")


BETWEEN = """bt AS (SELECT CAST(2*22 AS BIGINT) AS h UNION SELECT CAST(2*31 + 1 AS BIGINT) UNION SELECT x.h FROM bt JOIN edges e ON e.src = bt.h
 JOIN LATERAL (SELECT e.dst AS h UNION ALL SELECT e.dst + 1 - 2*(e.dst % 2)) x ON true WHERE FLOOR(e.dst/2) NOT IN (22, 31))"""


@query(f", {BETWEEN} SELECT DISTINCT {NODE.format(h='h')} AS node_id FROM bt")
def between_nodes(g):
    ends = g.spark.createDataFrame([(0, 44, 62)], "query_id long, start long, end long")
    return traverse.tiered(g, lambda near: _ids(g, near.between(44, 62)), lambda: traverse.between_frontier(g, ends).select("node_id"))


@query(", " + CONTEXT.format(seeds=f"SELECT * FROM ({SEED_40}) z", limit=10).replace("ctx", "c1").split(" SELECT n AS")[0] + ", " + CONTEXT.format(seeds=f"SELECT * FROM ({SEED_40.replace('40', '46')}) z", limit=10).replace("ctx", "c2").split(" SELECT n AS")[0] + " SELECT DISTINCT n AS node_id, 'inserted' AS change FROM c2 WHERE n NOT IN (SELECT n FROM c1) UNION ALL SELECT DISTINCT n, 'removed' FROM c1 WHERE n NOT IN (SELECT n FROM c2)")
def window_slide_delta(g):
    inserted, removed = slide(_context(g, [(40, 0, 0), (40, 1, 0)], 10), _context(g, [(46, 0, 0), (46, 1, 0)], 10))
    return inserted.select("node_id", F.lit("inserted").alias("change")).unionByName(removed.select("node_id", F.lit("removed").alias("change")))


ENTRIES = f"""deg AS (SELECT src, COUNT(*) AS n, MIN(dst) AS only FROM edges GROUP BY src),
entries AS (SELECT l.handle, l.next FROM links l JOIN deg d ON d.src = l.handle LEFT JOIN deg b ON b.src = {FLIP.format(h='d.only')} WHERE d.n > 1 OR b.n > 1)"""


def snarls_sql(extra: str = "") -> str:
    start = f"CASE WHEN {CANONICAL.replace('src', 'handle').replace('dst', 'next')} THEN handle ELSE {FLIP.format(h='next')} END"
    end = f"CASE WHEN {CANONICAL.replace('src', 'handle').replace('dst', 'next')} THEN next ELSE {FLIP.format(h='handle')} END"
    return f"""sn AS (SELECT DISTINCT {start} AS "start", {end} AS "end" FROM entries WHERE FLOOR(handle/2) BETWEEN {LO} AND {HI}
 AND handle IN (SELECT src FROM edges WHERE FLOOR(dst/2) BETWEEN {LO} AND {HI}){extra})"""


@query(f", {ENTRIES} SELECT handle, next FROM entries")
def snarl_entries(g):
    return traverse.snarl_entries(g)


@query(f', {ENTRIES}, {snarls_sql()} SELECT "start", "end" FROM sn')
def covered_snarls(g):
    return traverse.covered_snarls(g, region(g))


WITHIN = f"BETWEEN {LO} AND {HI + 1}"
ONE_COMPONENT = f"""cc AS (SELECT node_id, node_id AS c FROM nodes WHERE node_id {WITHIN} UNION SELECT {NODE.format(h='e.dst')}, cc.c FROM cc JOIN edges e ON FLOOR(e.src/2) = cc.node_id WHERE FLOOR(e.dst/2) {WITHIN}),
one AS (SELECT COUNT(*) AS n FROM (SELECT node_id, MIN(c) AS m FROM cc GROUP BY node_id) z WHERE m = node_id)"""


@query(f", {ENTRIES}, {ONE_COMPONENT}, {snarls_sql(f' AND NOT FLOOR(next/2) BETWEEN {LO} AND {HI}').replace(f'AND {HI}', f'AND {HI + 1}')} SELECT \"start\", \"end\" FROM sn WHERE (SELECT n FROM one) = 1")
def partial_snarls(g):
    return traverse.covered_snarls(g, g.nodes.where(F.col("node_id").between(LO, HI + 1)), partial=True)


@query(f""", {ENTRIES}, {snarls_sql()}, ex AS (SELECT "start" AS s0, "end" AS e0, "start" AS h FROM sn UNION SELECT "start", "end", {FLIP.format(h='"end"')} FROM sn
 UNION SELECT ex.s0, ex.e0, x.h FROM ex JOIN edges e ON e.src = ex.h JOIN LATERAL (SELECT e.dst AS h UNION ALL SELECT {FLIP.format(h='e.dst')}) x ON true WHERE FLOOR(e.dst/2) <> FLOOR(ex.s0/2) AND FLOOR(e.dst/2) <> FLOOR(ex.e0/2))
 SELECT DISTINCT {NODE.format(h='h')} AS node_id FROM ex""")
def extract_snarls(g):
    found = traverse.covered_snarls(g, region(g)).withColumn("query_id", F.monotonically_increasing_id())
    return traverse.between_frontier(g, found).select("node_id").distinct()


@query("SELECT node_id FROM nodes WHERE node_id BETWEEN 22 AND 25")
def enclosing_snarl(g):
    """An allele between two anchors, and the snarl that they bound."""
    return traverse.tiered(g, lambda near: _ids(g, near.enclosing({23})), lambda: traverse.enclosing_frontier(g, _ids(g, [23])))


@query(f""", cc AS (SELECT node_id, node_id AS c FROM nodes UNION SELECT {NODE.format(h='e.dst')}, cc.c FROM cc JOIN edges e ON FLOOR(e.src/2) = cc.node_id) SELECT node_id, MIN(c) AS component FROM cc GROUP BY node_id""")
def weak_components(g):
    return traverse.components_frontier(g, g.nodes.select("node_id"))


# --- haplotypes ----------------------------------------------------------------------------------------------------

ISLANDS = f"""isl AS (SELECT path_handle, MIN(step) AS first_step, MIN(step_start) AS walk_start, MAX(step_end) AS walk_end,
 string_agg(concat({SIGN.format(h='handle')}, CAST({NODE.format(h='handle')} AS VARCHAR)), '' ORDER BY step) AS fw,
 string_agg(concat({SIGN.format(h='(handle+1)')}, CAST({NODE.format(h='handle')} AS VARCHAR)), '' ORDER BY step DESC) AS bw, list(handle ORDER BY step) AS lf, list({FLIP.format(h='handle')} ORDER BY step DESC) AS lb,
 MAX(CASE WHEN path_handle = 10 AND step = 9 THEN 1 ELSE 0 END) AS is_ref FROM (SELECT *, step - ROW_NUMBER() OVER (PARTITION BY path_handle ORDER BY step) AS run FROM offsets WHERE FLOOR(handle/2) BETWEEN {LO} AND {HI}) x GROUP BY path_handle, run)"""
WALKS = f"""{ISLANDS}, wk AS (SELECT path_handle, first_step, CASE WHEN is_ref = 1 OR lf <= lb THEN fw ELSE bw END AS walk, CASE WHEN is_ref = 1 OR lf <= lb THEN lf ELSE lb END AS l, is_ref = 1 AS is_ref, walk_end - walk_start AS len FROM isl
 UNION ALL SELECT path_handle, first_step, bw, lb, false, walk_end - walk_start FROM isl WHERE lf = lb OR (is_ref = 1 AND lb < lf))"""


def _walks(g: Graph) -> DataFrame:
    return walks.walks(walks.islands(g.steps, region(g), 10, 9))


@query(f", {WALKS} SELECT path_handle, first_step, walk, is_ref, len FROM wk")
def subgraph_walks_all(g):
    return _walks(g).withColumn("walk", walk_text(F.col("walk")))


@query(f", {WALKS} SELECT walk, COUNT(*) AS weight, bool_or(is_ref) AS is_ref, MIN(len) AS len FROM wk GROUP BY walk")
def subgraph_walks_distinct(g):
    return walks.distinct_walks(_walks(g)).withColumn("walk", walk_text(F.col("walk")))


@query(f", {WALKS} SELECT walk, len FROM wk WHERE is_ref")
def subgraph_walks_reference(g):
    return _walks(g).where("is_ref").select(walk_text(F.col("walk")).alias("walk"), "len")


@query(f", {ISLANDS} SELECT walk_start AS \"start\", walk_end AS \"end\", fw AS walk FROM isl WHERE is_ref = 1")
def reference_interval(g):
    rows = walks.islands(g.steps, region(g), 10, 9).where("is_ref")
    return rows.select(F.col("walk_start").alias("start"), F.col("walk_end").alias("end"), walk_text(F.col("walk")).alias("walk"))


NAMED = """nm AS (SELECT l, walk, is_ref, len, weight, CASE WHEN is_ref THEN 'c10' ELSE 'unknown' END AS sample, CASE WHEN is_ref THEN 0 ELSE ROW_NUMBER() OVER (PARTITION BY is_ref ORDER BY l) END AS haplotype,
 (SELECT contig FROM paths WHERE path_handle = 10) AS contig, CASE WHEN is_ref THEN (SELECT MIN(walk_start) FROM isl WHERE is_ref = 1) ELSE 0 END AS "start", CASE WHEN is_ref THEN (SELECT MAX(walk_end) FROM isl WHERE is_ref = 1) ELSE len END AS "end"
 FROM (SELECT l, walk, COUNT(*) AS weight, bool_or(is_ref) AS is_ref, MIN(len) AS len FROM wk GROUP BY l, walk) d)"""


def _named(g: Graph) -> DataFrame:
    found = walks.islands(g.steps, region(g), 10, 9)
    ref, name = found.where("is_ref").first(), g.paths.where("path_handle = 10").first()
    return walks.named(walks.distinct_walks(walks.walks(found)), name.sample, name.contig, name.haplotype, ref.walk_start, ref.walk_end)


@query(f', {WALKS}, {NAMED} SELECT sample, haplotype, contig, "start", "end", walk, weight FROM nm')
def walk_names(g):
    return _named(g).select("sample", "haplotype", "contig", "start", "end", walk_text(F.col("walk")).alias("walk"), "weight")


EDGE_TEXT = "concat('L', chr(9), CAST({a} AS VARCHAR), chr(9), CASE WHEN src % 2 = 0 THEN '+' ELSE '-' END, chr(9), CAST({b} AS VARCHAR), chr(9), CASE WHEN dst % 2 = 0 THEN '+' ELSE '-' END, chr(9), '0M')".format(a=NODE.format(h="src"), b=NODE.format(h="dst"))


@query(f""", {WALKS}, {NAMED} SELECT concat('H', chr(9), 'VN:Z:1.1', chr(9), 'RS:Z:c10') AS line UNION ALL SELECT concat('S', chr(9), CAST(node_id AS VARCHAR), chr(9), sequence) FROM nodes WHERE node_id BETWEEN {LO} AND {HI}
UNION ALL SELECT {EDGE_TEXT} FROM edges WHERE {INSIDE} AND {CANONICAL}
UNION ALL SELECT concat('W', chr(9), sample, chr(9), CAST(haplotype AS VARCHAR), chr(9), contig, chr(9), CAST("start" AS VARCHAR), chr(9), CAST("end" AS VARCHAR), chr(9), walk, chr(9), 'WT:i:', CAST(weight AS VARCHAR)) FROM nm""")
def gfa_lines(g):
    ids = region(g)
    return walks.gfa_lines(g.nodes.join(ids, "node_id", "left_semi"), induced_edges(g), _named(g), "c10").select("line")


@query(f"SELECT node_id, concat('{{\"id\": \"', CAST(node_id AS VARCHAR), '\", \"sequence\": \"', sequence, '\"}}') AS json FROM nodes WHERE node_id BETWEEN {LO} AND {HI}")
def json_nodes(g):
    return walks.json_nodes(g.nodes.join(region(g), "node_id", "left_semi"))


JSON_END = "'{x}\": \"', CAST({n} AS VARCHAR), '\", \"{x}_is_reverse\": ', CASE WHEN {h} % 2 = 1 THEN 'true' ELSE 'false' END"


@query(f"SELECT src, dst, concat('{{\"', {JSON_END.format(x='from', n=NODE.format(h='src'), h='src')}, ', \"', {JSON_END.format(x='to', n=NODE.format(h='dst'), h='dst')}, '}}') AS json FROM edges WHERE {INSIDE} AND {CANONICAL}")
def json_edges(g):
    return walks.json_edges(induced_edges(g))


@query(f", {WALKS}, {NAMED} SELECT is_ref, haplotype, concat('{{\"name\": \"', sample, '#', CAST(haplotype AS VARCHAR), '#', contig, '[', CAST(\"start\" AS VARCHAR), '-', CAST(\"end\" AS VARCHAR), ']\", \"weight\": ', CAST(weight AS VARCHAR), ', \"path\": [', list_aggregate(list_transform(l, lambda h: concat('{{\"id\": \"', CAST(h // 2 AS VARCHAR), '\", \"is_reverse\": ', CASE WHEN h % 2 = 1 THEN 'true' ELSE 'false' END, '}}')), 'string_agg', ', '), ']}}') AS json FROM nm")
def json_paths(g):
    return walks.json_paths(_named(g))


# --- visits in order, paths as positions -----------------------------------------------------------------------------


@query(f", {fixtures.VISITS} SELECT path_handle, step, handle, \"offset\", flip_offset FROM placed")
def visit_ranks(g, spark, sf_dir):
    """The place of every visit among those to its handle, read forwards and backwards."""
    return fixtures.placed(spark, sf_dir).steps.select("path_handle", "step", "handle", "offset", "flip_offset")


@query(f", {fixtures.VISITS} SELECT a.handle, a.\"offset\", b.handle AS next_handle, b.\"offset\" AS next_offset FROM vr a JOIN vr b ON a.seq = b.seq AND b.idx = a.idx + 1 WHERE a.seq % 2 = 0")
def visit_successors(g, spark, sf_dir):
    steps = fixtures.placed(spark, sf_dir).steps
    rows = steps.select(F.col("path_handle").alias("seq"), F.col("step").alias("idx"), "handle", "offset")
    return visits.successors(rows, locate.short_paths(g.steps))


@query(f""", {fixtures.VISITS} SELECT e.event_id AS query_id, e.event_id % 97 AS seq_offset, CAST(FLOOR(o.handle/2) AS BIGINT) AS node_id, o.handle % 2 = 1 AS is_reverse, e.event_id % 97 - o.step_start AS node_offset,
 o.handle, p."offset" AS visit FROM events e JOIN offsets o ON o.path_handle = e.user_id AND o.step_start <= e.event_id % 97 AND e.event_id % 97 < o.step_end JOIN placed p ON p.path_handle = o.path_handle AND p.step = o.step""")
def position_views(g, spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    q = events.select(F.col("event_id").alias("query_id"), F.col("user_id").alias("path_handle"), (F.col("event_id") % 97).alias("path_offset"))
    in_place = locate.short_paths(g.steps, locate.STEPS_IN_PLACE)
    found = locate.position_views(locate.offset_to_position(q, fixtures.placed(spark, sf_dir).steps, in_place))
    return found.select("query_id", F.col("path_offset").alias("seq_offset"), "node_id", "is_reverse", "node_offset", "handle", "visit")


@query(f""", {fixtures.VISITS}, {WALKS},
 first AS (SELECT i.path_handle, i.first_step, i.first_step + len(i.lf) - 1 AS last_step FROM isl i),
 forms AS (SELECT w.*, l[1] AS start_handle, p."offset" FROM wk w JOIN first f USING (path_handle, first_step) JOIN isl i USING (path_handle, first_step) JOIN placed p ON p.path_handle = w.path_handle AND p.step = w.first_step WHERE w.l = i.lf AND i.lf <> i.lb
  UNION ALL SELECT w.*, l[1], p.flip_offset FROM wk w JOIN first f USING (path_handle, first_step) JOIN isl i USING (path_handle, first_step) JOIN placed p ON p.path_handle = w.path_handle AND p.step = f.last_step WHERE w.l = i.lb AND i.lf <> i.lb)
 SELECT path_handle, first_step, walk, start_handle, "offset", is_ref, CASE WHEN is_ref THEN 0 ELSE ROW_NUMBER() OVER (PARTITION BY is_ref ORDER BY start_handle, "offset") END AS haplotype FROM forms""")
def walk_order(g, spark, sf_dir):
    """All walks of a subgraph, numbered by start handle and the place of the visit that they start with."""
    rows = walks.walks(walks.islands(fixtures.placed(spark, sf_dir).steps, region(g), 10, 9))
    rows = walks.named(rows.where(F.col("walk") != flipped_path(F.col("walk"))), "c10", "x", 0, 0, 0)
    return rows.select("path_handle", "first_step", walk_text(F.col("walk")).alias("walk"), F.col("walk")[0].alias("start_handle"), "offset", "is_ref", "haplotype")


@query("SELECT path_handle, string_agg(concat(CASE WHEN rev = 0 THEN '>' ELSE '<' END, CAST(node_id AS VARCHAR)), '' ORDER BY step) AS walk FROM steps GROUP BY path_handle")
def path_walk_text(g):
    """The walk of every path."""
    rows = g.steps.groupBy("path_handle").agg(F.sort_array(F.collect_list(F.struct("step", "handle")))["handle"].alias("w"))
    return rows.select("path_handle", walk_text(F.col("w")).alias("walk"))


def _gap_sql(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0 ELSE 6 + {n} - 1 END"


CIGARS = f"""hs AS (SELECT 2*node_id AS h, sequence AS s FROM nodes UNION ALL SELECT 2*node_id + 1, {REVCOMP} FROM nodes),
 st AS (SELECT walk, is_ref, x, h, s FROM (SELECT walk, is_ref, unnest(l) AS h, generate_subscripts(l, 1) AS x FROM nm) u JOIN hs USING (h)), rf AS (SELECT x AS y, h, s FROM st WHERE is_ref),
 mt AS (SELECT walk, x, y, length(st.s) AS n FROM st JOIN rf USING (h) WHERE NOT is_ref UNION ALL SELECT walk, 0, 0, 0 FROM nm WHERE NOT is_ref UNION ALL SELECT walk, len(l) + 1, (SELECT COUNT(*) FROM rf) + 1, 0 FROM nm WHERE NOT is_ref),
 gp AS (SELECT walk, x, y, n, LAG(x) OVER w AS px, LAG(y) OVER w AS py FROM mt WINDOW w AS (PARTITION BY walk ORDER BY x)),
 ga AS (SELECT g.walk, g.x, string_agg(s, '' ORDER BY st.x) AS a FROM gp g JOIN st ON st.walk = g.walk AND NOT is_ref AND st.x > px AND st.x < g.x GROUP BY g.walk, g.x),
 gb AS (SELECT g.walk, g.x, string_agg(s, '' ORDER BY rf.y) AS b FROM gp g JOIN rf ON rf.y > py AND rf.y < g.y GROUP BY g.walk, g.x),
 gs AS (SELECT g.walk, g.x, n, coalesce(a, '') AS a, coalesce(b, '') AS b FROM gp g LEFT JOIN ga ON ga.walk = g.walk AND ga.x = g.x LEFT JOIN gb ON gb.walk = g.walk AND gb.x = g.x WHERE px IS NOT NULL),
 g1 AS (SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: a[1:k] = b[1:k])) AS p, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda k: right(a, k) = right(b, k))) AS q FROM gs),
 g2 AS (SELECT *, least(q, length(a) - p, length(b) - p) AS sf FROM g1), g3 AS (SELECT *, length(a) - p - sf AS i, length(b) - p - sf AS d FROM g2),
 g4 AS (SELECT *, CASE WHEN 4*least(i, d) + {_gap_sql("(i - least(i, d))")} + {_gap_sql("(d - least(i, d))")} > {_gap_sql("i")} + {_gap_sql("d")} THEN 0 ELSE least(i, d) END AS m FROM g3),
 op AS (SELECT walk, x, 1 AS k, 'M' AS op, p AS n FROM g4 UNION ALL SELECT walk, x, 2, 'M', m FROM g4 UNION ALL SELECT walk, x, 3, 'I', i - m FROM g4 UNION ALL SELECT walk, x, 4, 'D', d - m FROM g4 UNION ALL SELECT walk, x, 5, 'M', sf FROM g4 UNION ALL SELECT walk, x, 6, 'M', n FROM g4),
 o1 AS (SELECT *, CASE WHEN op IS DISTINCT FROM LAG(op) OVER (PARTITION BY walk ORDER BY x, k) THEN 1 ELSE 0 END AS cut FROM op WHERE n > 0), o2 AS (SELECT *, SUM(cut) OVER (PARTITION BY walk ORDER BY x, k) AS run FROM o1),
 o3 AS (SELECT walk, run, op, CAST(SUM(n) AS BIGINT) AS n FROM o2 GROUP BY walk, run, op), cg AS (SELECT walk, string_agg(concat(CAST(n AS VARCHAR), op), '' ORDER BY run) AS cigar FROM o3 GROUP BY walk)"""


@query(f", {WALKS}, {NAMED}, {CIGARS} SELECT walk, weight, cigar FROM nm LEFT JOIN cg USING (walk)")
def cigar_walks(g):
    """Walks aligned to the reference walk. Here all nodes that two walks share can be aligned at once, as layers have one order: the SQL takes them all."""
    rows = _named(g)
    ref = list(rows.where("is_ref").first().walk)
    return cigar.with_cigars(rows, ref, g.nodes).select(walk_text(F.col("walk")).alias("walk"), "weight", "cigar")


@query(f"""SELECT sha256(string_agg(concat(lpad(CAST(part AS VARCHAR), 20, '0'), ' ', digest), chr(10) ORDER BY part)) AS name FROM (SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
 SELECT CAST(FLOOR(node_id / {walks.NAMED_AT_ONCE}) AS BIGINT) AS part, concat('S', chr(9), lpad(CAST(node_id AS VARCHAR), 20, '0'), chr(9), sequence) AS line FROM nodes UNION ALL
 SELECT CAST(FLOOR(FLOOR(src/2) / {walks.NAMED_AT_ONCE}) AS BIGINT), concat('L', chr(9), lpad(CAST(src AS VARCHAR), 20, '0'), chr(9), lpad(CAST(dst AS VARCHAR), 20, '0')) FROM edges WHERE {CANONICAL}) x GROUP BY part) y""")
def stable_name(g):
    return walks.stable_name(g.nodes, g.edges)


# --- alignment records ---------------------------------------------------------------------------------------------


def _reads(spark, sf_dir) -> DataFrame:
    """The parsed reads, as a store would hold them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _READS:
        _READS[key] = gaf.parse_lines(fixtures.lines(spark, sf_dir).repartition("aln_id")).persist()  # operators group by read
    return _READS[key]


_READS: dict[tuple, DataFrame] = {}


@query("SELECT aln_id, line FROM lines")
def gaf_lines(g, spark, sf_dir):
    return fixtures.lines(spark, sf_dir).withColumnRenamed("value", "line")


@query("SELECT aln_id, name, seq_len, CAST(0 AS BIGINT) AS seq_start, seq_len AS seq_end, path, path_len, path_start, path_end, matches, CAST(edits AS BIGINT) AS edits, CASE WHEN mapq0 <> 255 THEN mapq0 END AS mapq, aln_id % 100 - 20 AS score, CASE WHEN aln_id % 4 = 0 THEN concat('r', CAST(aln_id + 1 AS VARCHAR)) WHEN aln_id % 4 = 1 THEN concat('r', CAST(aln_id - 1 AS VARCHAR)) END AS pair_name, CASE WHEN aln_id % 4 < 2 THEN aln_id % 4 = 0 END AS pair_is_proper FROM reads")
def gaf_parse(g, spark, sf_dir):
    path = F.when(F.size("path") == 0, "*").otherwise(walk_text(F.col("path"))).alias("path")
    return fixtures.reads(spark, sf_dir).where("error is null").select("aln_id", "name", "seq_len", "seq_start", "seq_end", path, "path_len", "path_start", "path_end", "matches", "edits", "mapq", "score", "pair_name", "pair_is_proper")


TOKENS = "tk AS (SELECT aln_id, pos - 1 AS pos, tok FROM (SELECT aln_id, unnest(regexp_extract_all(path, '[<>][0-9]+')) AS tok, generate_subscripts(regexp_extract_all(path, '[<>][0-9]+'), 1) AS pos FROM reads) x)"
HANDLE = "2*CAST(substr(tok, 2) AS BIGINT) + CASE WHEN tok LIKE '<%' THEN 1 ELSE 0 END"


@query("""SELECT event_id AS aln_id, CASE event_id % 11 WHEN 1 THEN 'too few fields' WHEN 2 THEN 'bad query interval' WHEN 3 THEN 'bad strand' WHEN 4 THEN 'bad path' WHEN 5 THEN 'bad path length' WHEN 6 THEN 'bad number'
 WHEN 7 THEN 'bad optional field' WHEN 8 THEN 'duplicate field' WHEN 9 THEN CASE WHEN cs IS NOT NULL THEN 'bad difference string' END WHEN 10 THEN 'bad target interval' END AS error FROM events JOIN reads ON aln_id = event_id""")
def gaf_errors(g, spark, sf_dir):
    """What is wrong with lines that were broken, each in one of ten ways."""
    part, kind = F.split("value", "\t", -1), F.col("aln_id") % 11
    put = lambda k, text: F.array_join(F.transform(part, lambda x, i: F.when(i == k, F.lit(text)).otherwise(x)), "\t")
    broken = F.when(kind == 1, F.array_join(F.slice(part, 1, 11), "\t"))
    for n, (k, text) in {2: (1, "x"), 3: (4, "?"), 4: (5, "12>3"), 5: (6, "-5"), 6: (9, "1.5")}.items():
        broken = broken.when(kind == n, put(k, text))
    broken = broken.when(kind == 7, F.concat("value", F.lit("\tzz:i:1.5"))).when(kind == 8, F.concat("value", F.lit("\tAS:i:1")))
    broken = broken.when(kind == 9, F.regexp_replace("value", "\tcs:Z:[^\t]*", "\tcs:Z::3?")).when(kind == 10, F.regexp_replace(put(7, "x"), "\tcs:Z:[^\t]*", ""))
    return gaf.parse_lines(fixtures.lines(spark, sf_dir).withColumn("value", F.coalesce(broken, "value"))).select("aln_id", "error")


@query(f", {TOKENS} SELECT aln_id, pos, {HANDLE} AS handle FROM tk")
def gaf_path_steps(g, spark, sf_dir):
    return R.path_steps(_reads(spark, sf_dir))


@query(f", {TOKENS} SELECT r.aln_id, greatest(r.path_len - r.path_end, 0) AS path_start, r.path_len - r.path_start AS path_end, coalesce(string_agg(CASE WHEN tok LIKE '<%' THEN concat('>', substr(tok, 2)) WHEN tok LIKE '>%' THEN concat('<', substr(tok, 2)) END, '' ORDER BY pos DESC), '') AS path FROM reads r LEFT JOIN tk USING (aln_id) GROUP BY ALL")
def gaf_strand_flip(g, spark, sf_dir):
    """Every line with strand `-`."""
    lines = fixtures.lines(spark, sf_dir).withColumn("value", F.regexp_replace("value", "\t[+]\t", "\t-\t"))
    return gaf.parse_lines(lines).select("aln_id", "path_start", "path_end", walk_text(F.col("path")).alias("path"))


@query("""SELECT aln_id, unnest(['xx', 'ya', 'yi', 'yf', 'yb']) AS tag, unnest(['Z', 'A', 'i', 'f', 'b']) AS type, unnest([event_type, substr(event_type, 1, 1), concat('-', CAST(aln_id AS VARCHAR)), concat(CAST(aln_id % 7 AS VARCHAR), '.5e-3'), CAST(aln_id % 2 AS VARCHAR)]) AS value FROM reads""")
def typed_fields(g, spark, sf_dir):
    """Optional fields of every type, besides those that have columns of their own."""
    number = F.col("aln_id").cast("string")
    more = [F.lit("\tya:A:"), F.regexp_extract("value", "\txx:Z:(.)", 1), F.lit("\tyi:i:-"), number, F.lit("\tyf:f:"), (F.col("aln_id") % 7).cast("string"), F.lit(".5e-3\tyb:b:"), (F.col("aln_id") % 2).cast("string")]
    rows = gaf.parse_lines(fixtures.lines(spark, sf_dir).withColumn("value", F.concat("value", *more)))
    return rows.select("aln_id", F.explode("optional").alias("x")).select("aln_id", "x.tag", "x.type", "x.value")


OPS = r"""op AS (SELECT aln_id, CAST(pos - 1 AS BIGINT) AS op_no, substr(t, 1, 1) AS op, CASE substr(t, 1, 1) WHEN ':' THEN CAST(substr(t, 2) AS BIGINT) WHEN '*' THEN 1 ELSE length(t) - 1 END AS len,
 CASE substr(t, 1, 1) WHEN '*' THEN substr(t, 3) WHEN '+' THEN substr(t, 2) END AS seq FROM (SELECT aln_id, unnest(regexp_extract_all(cs, '[=:*+\-][^=:*+\-]*')) AS t, generate_subscripts(regexp_extract_all(cs, '[=:*+\-][^=:*+\-]*'), 1) AS pos FROM reads) x)"""


@query(f", {OPS} SELECT aln_id, op_no, op, len, seq FROM op")
def cs_ops(g, spark, sf_dir):
    return _reads(spark, sf_dir).select("aln_id", F.posexplode("diff").alias("op_no", "d")).select("aln_id", F.col("op_no").cast("long").alias("op_no"), "d.op", "d.len", "d.seq")


@query(f""", {OPS} SELECT aln_id, CAST(SUM(CASE WHEN op IN (':','*','+') THEN len ELSE 0 END) AS BIGINT) AS query_len, CAST(SUM(CASE WHEN op IN (':','*','-') THEN len ELSE 0 END) AS BIGINT) AS target_len,
CAST(SUM(CASE WHEN op = ':' THEN len ELSE 0 END) AS BIGINT) AS matches, CAST(SUM(CASE WHEN op <> ':' THEN len ELSE 0 END) AS BIGINT) AS edits FROM op GROUP BY aln_id""")
def cs_stats(g, spark, sf_dir):
    rows = _reads(spark, sf_dir).where(F.size("diff") > 0)
    return rows.select("aln_id", cs.query_len(F.col("diff")).alias("query_len"), cs.target_len(F.col("diff")).alias("target_len"), cs.matches(F.col("diff")).alias("matches"), cs.edits(F.col("diff")).alias("edits"))


@query(f", {OPS} SELECT aln_id, CAST(COUNT(*) AS BIGINT) AS ops, CAST(2*SUM(CASE WHEN op <> '*' THEN len ELSE 0 END) AS BIGINT) AS merged_len FROM op GROUP BY aln_id")
def cs_normalize(g, spark, sf_dir):
    """Every op but mismatches is written twice, matches with an empty one between, and merged to one again."""
    rows = fixtures.lines(spark, sf_dir).select("aln_id", F.regexp_extract("value", r"\tcs:Z:([^\t]*)", 1).alias("cs")).where("cs <> ''")
    twice = F.regexp_replace(F.regexp_replace("cs", r":(\d+)", ":$1:0:$1"), r"([+-][A-Za-z]+)", "$1$1")
    ops = cs.normalize(cs.parse(twice))
    merged = F.aggregate(ops, F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"] != "*", x["len"]).otherwise(0))
    return rows.select("aln_id", F.size(ops).cast("long").alias("ops"), merged.alias("merged_len"))


@query("""SELECT aln_id, CASE aln_id % 8 WHEN 1 THEN 'query interval' WHEN 2 THEN 'target interval' WHEN 3 THEN CASE WHEN cs IS NOT NULL THEN 'empty path with a length' END WHEN 4 THEN CASE WHEN cs IS NOT NULL THEN 'query length' END
 WHEN 5 THEN CASE WHEN cs IS NOT NULL THEN 'target length' ELSE 'empty path with a length' END WHEN 6 THEN CASE WHEN cs IS NOT NULL THEN 'matches' END WHEN 7 THEN CASE WHEN cs IS NOT NULL THEN 'edits' END END AS problem FROM reads""")
def gaf_validate(g, spark, sf_dir):
    """Reads of which seven in eight are made inconsistent, each in one of seven ways."""
    kind, c = F.col("aln_id") % 8, F.col
    more = lambda name, *kinds, by=1: F.col(name) + F.when(kind.isin(*kinds), by).otherwise(0)
    long_query = F.when(kind == 4, 5).otherwise(0)
    changed = {"seq_end": more("seq_end", 1, 4), "seq_len": c("seq_len") + long_query, "path_end": more("path_end", 2, 5), "path_len": more("path_len", 5), "matches": more("matches", 6), "edits": more("edits", 7)}
    broken = _reads(spark, sf_dir).withColumns(changed | {"path": F.when(kind == 3, F.array().cast("array<long>")).otherwise(c("path"))})
    return broken.select("aln_id", gaf.validation_error().alias("problem"))


@query("""SELECT aln_id, cs IS NULL AS is_unaligned, CASE WHEN cs IS NOT NULL THEN aln_id % 4 NOT IN (1, 2) ELSE aln_id % 4 <> 2 END AS is_full, cs IS NOT NULL AND edits = 0 AS is_exact FROM reads""")
def gaf_flags(g, spark, sf_dir):
    """Flags of reads of which some begin after, and some end before, what they are reads of."""
    kind = F.col("aln_id") % 4
    starts = F.col("seq_start") + F.when((kind == 1) & (F.size("path") > 0), 1).otherwise(0)
    rows = _reads(spark, sf_dir).withColumns({"seq_start": starts, "seq_len": F.col("seq_len") + F.when(kind == 2, 2).otherwise(0)})
    return rows.select("aln_id", gaf.is_unaligned().alias("is_unaligned"), gaf.is_full().alias("is_full"), gaf.is_exact().alias("is_exact"))


def _target(g: Graph, reads: DataFrame) -> DataFrame:
    """Adds target: the bases of each read's path."""
    rows = R.path_steps(reads).withColumn("node_id", node_of(F.col("handle"))).join(g.nodes, "node_id")
    bases = F.struct("pos", seq.oriented(F.col("sequence"), is_reverse(F.col("handle"))).alias("s"))
    whole = rows.groupBy("aln_id").agg(F.array_join(F.sort_array(F.collect_list(bases))["s"], "").alias("target"))
    return reads.join(whole, "aln_id", "left").withColumn("target", F.coalesce("target", F.lit("")))


@query(f""", {TOKENS}, tg AS (SELECT aln_id, string_agg(CASE WHEN tok LIKE '>%' THEN sequence ELSE {REVCOMP} END, '' ORDER BY pos) AS target FROM tk JOIN nodes ON node_id = CAST(substr(tok, 2) AS BIGINT) GROUP BY aln_id)
SELECT l.aln_id, CASE r.event_type WHEN 'error' THEN replace(l.line, '*AC', concat('*', substr(target, 2, 1), 'C')) WHEN 'signup' THEN replace(l.line, '-AA', concat('-', substr(target, 2, 2))) ELSE l.line END AS line FROM lines l JOIN reads r USING (aln_id) LEFT JOIN tg USING (aln_id)""")
def gaf_format(g, spark, sf_dir):
    return _target(g, _reads(spark, sf_dir)).select("aln_id", gaf.to_line(F.col("target")).alias("line"))


@query("SELECT aln_id, min_handle, max_handle FROM reads")
def read_handle_range(g, spark, sf_dir):
    return R.handle_range(_reads(spark, sf_dir))


BLOCKS = """b1 AS (SELECT *, SUM(flip) OVER (ORDER BY aln_id) AS run FROM (SELECT *, CASE WHEN (cs IS NULL) <> LAG(cs IS NULL) OVER (ORDER BY aln_id) THEN 1 ELSE 0 END AS flip FROM reads) x),
bl AS (SELECT *, DENSE_RANK() OVER (ORDER BY run, part) - 1 AS block_id FROM (SELECT *, FLOOR((ROW_NUMBER() OVER (PARTITION BY run ORDER BY aln_id) - 1) / 50) AS part FROM b1) y),
bs AS (SELECT block_id, COUNT(*) AS reads, CASE WHEN COUNT(min_handle) = COUNT(*) THEN MIN(min_handle) END AS min_handle, MAX(max_handle) AS max_handle, CASE WHEN MIN(seq_len) = MAX(seq_len) AND MIN(seq_len) > 0 THEN MIN(seq_len) END AS read_length, CAST(SUM(length(name)) AS BIGINT) AS name_bytes FROM bl GROUP BY block_id)"""


def _blocked(spark, sf_dir) -> DataFrame:
    return R.blocks(_reads(spark, sf_dir).withColumn("is_unaligned", gaf.is_unaligned()), 50)


@query(f", {BLOCKS} SELECT * FROM bs")
def block_summary(g, spark, sf_dir):
    return R.block_summary(_blocked(spark, sf_dir))


@query(f""", {OPS} SELECT (SELECT CAST(SUM(length(name)) AS BIGINT) FROM reads) AS name_bytes, CAST(0 AS BIGINT) AS quality_bytes, (SELECT CAST(SUM(length(event_type) + 5) AS BIGINT) FROM reads) AS optional_bytes,
(SELECT CAST(SUM(CASE WHEN aln_id % 4 = 0 THEN length(CAST(aln_id + 1 AS VARCHAR)) + 1 WHEN aln_id % 4 = 1 THEN length(CAST(aln_id - 1 AS VARCHAR)) + 1 ELSE 0 END) AS BIGINT) FROM reads) AS pair_name_bytes, (SELECT COUNT(*) FROM op WHERE len > 0) AS diff_ops""")
def column_bytes(g, spark, sf_dir):
    return R.column_bytes(_reads(spark, sf_dir))


@query(f", {BLOCKS} SELECT aln_id, name FROM bl WHERE block_id >= 3 AND block_id < 7")
def row_range_scan(g, spark, sf_dir):
    """The rows of some blocks of a store."""
    path = _store_folder(spark, "rows")
    store.write_alignments(_reads(spark, sf_dir).drop("error"), path, store.AlignmentParams(block_size=50))
    return store.open_alignments(spark, path).rows(3, 7).select("aln_id", "name")


@query(f", {TOKENS} SELECT r.aln_id, t.h AS \"start\", CASE WHEN t.h IS NOT NULL THEN ROW_NUMBER() OVER (PARTITION BY t.h ORDER BY r.aln_id) - 1 END AS rank FROM reads r LEFT JOIN (SELECT aln_id, {HANDLE} AS h FROM tk WHERE pos = 0) t USING (aln_id)")
def gbwt_start_rank(g, spark, sf_dir):
    return R.start_ranks(_reads(spark, sf_dir))


CLUSTERS = "cl AS (SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(4 AS BIGINT)), (60, 70)) v(cluster_min, cluster_max))"


@query(f", {BLOCKS}, {CLUSTERS} SELECT block_id FROM bs WHERE EXISTS (SELECT 1 FROM cl WHERE min_handle <= 2*cluster_max + 1 AND max_handle >= 2*cluster_min)")
def blocks_overlapping(g, spark, sf_dir):
    clusters = spark.createDataFrame([(1, 4), (60, 70)], "cluster_min long, cluster_max long")
    return R.blocks_meeting(R.block_summary(_blocked(spark, sf_dir)), clusters).select("block_id")


@query(f", {BLOCKS}, {TOKENS} SELECT block_id, COUNT(DISTINCT CAST(substr(tok, 2) AS BIGINT)) AS shared FROM bl JOIN tk USING (aln_id) WHERE CAST(substr(tok, 2) AS BIGINT) % 5 = 2 GROUP BY block_id")
def blocks_with_nodes(g, spark, sf_dir):
    """Blocks whose reads visit some of a scattered set of nodes, by bitmaps, and how many of them."""
    steps = _blocked(spark, sf_dir).select("block_id", F.explode("path").alias("handle")).select("block_id", node_of(F.col("handle")).alias("node_id"))
    return R.blocks_with_nodes(R.node_bitmaps(steps, "block_id"), g.nodes.where("node_id % 5 = 2"))


@query(f", {TOKENS} SELECT DISTINCT aln_id FROM tk WHERE CAST(substr(tok, 2) AS BIGINT) BETWEEN {LO} AND {HI}")
def reads_overlapping(g, spark, sf_dir):
    return R.select(_reads(spark, sf_dir), region(g)).select("aln_id")


@query(f", {TOKENS} SELECT aln_id FROM tk GROUP BY aln_id HAVING bool_and(CAST(substr(tok, 2) AS BIGINT) BETWEEN {LO} AND {HI})")
def reads_contained(g, spark, sf_dir):
    return R.select(_reads(spark, sf_dir), region(g), R.CONTAINED).select("aln_id")


@query("SELECT aln_id, path_len AS target_len FROM reads WHERE path <> '*'")
def read_target_len(g, spark, sf_dir):
    return R.target_lengths(_reads(spark, sf_dir), g.nodes)


MAPPINGS = f"""{TOKENS}, {OPS}, nd AS (SELECT t.aln_id, t.pos, {HANDLE} AS handle, seq_len AS node_len, CAST(SUM(seq_len) OVER w - seq_len AS BIGINT) AS n0, CAST(SUM(seq_len) OVER w AS BIGINT) AS n1 FROM tk t JOIN nodes ON node_id = CAST(substr(tok, 2) AS BIGINT) WINDOW w AS (PARTITION BY aln_id ORDER BY pos)),
o1 AS (SELECT op.*, r.path_start, CASE WHEN op = '+' THEN 0 ELSE len END AS tl, CASE WHEN op = '-' THEN 0 ELSE len END AS ql FROM op JOIN reads r USING (aln_id)),
o2 AS (SELECT *, CAST(path_start + SUM(tl) OVER w - tl AS BIGINT) AS t0, CAST(path_start + SUM(tl) OVER w AS BIGINT) AS t1, CAST(SUM(ql) OVER w - ql AS BIGINT) AS q0 FROM o1 WINDOW w AS (PARTITION BY aln_id ORDER BY op_no)),
mp AS (SELECT o.aln_id, op_no, CAST(pos AS BIGINT) AS pos, handle, greatest(t0, n0) - n0 AS node_start, CASE WHEN op = '+' THEN t0 ELSE least(t1, n1) END - n0 AS node_end, node_len, q0 + CASE WHEN op IN (':','*') THEN greatest(t0, n0) - t0 ELSE 0 END AS query_start,
 op, CASE WHEN op = '+' THEN len ELSE least(t1, n1) - greatest(t0, n0) END AS len FROM o2 o JOIN nd n ON o.aln_id = n.aln_id AND CASE WHEN op = '+' THEN n0 < t0 AND t0 <= n1 ELSE n0 < t1 AND t0 < n1 END)"""


@query(f", {MAPPINGS} SELECT aln_id, op_no, pos, handle, node_start, node_end, query_start, op, len FROM mp")
def read_mappings(g, spark, sf_dir):
    rows = R.mappings(_reads(spark, sf_dir), g.nodes)
    return rows.select("aln_id", F.col("op_no").cast("long").alias("op_no"), "pos", "handle", "node_start", "node_end", "query_start", "op", "len")


@query(f""", {MAPPINGS}, {'m0 AS (SELECT *, LAG(handle) OVER w AS h, LAG(node_end) OVER w AS e FROM mp WINDOW w AS (PARTITION BY aln_id ORDER BY op_no, pos))'}
SELECT aln_id, op_no, pos, CASE WHEN op = '-' THEN 0 ELSE len END AS query_len, node_end - node_start AS target_len, node_start = 0 AS at_start, node_end = node_len AS at_end, coalesce(handle = h AND node_start = e, false) AS follows FROM m0""")
def mapping_algebra(g, spark, sf_dir):
    """Lengths of each mapping, where it lies in its node, and whether it goes on from the one before."""
    from pyspark.sql import Window

    before = F.lag(F.struct("handle", "node_end")).over(Window.partitionBy("aln_id").orderBy("op_no", "pos"))
    rows = R.mappings(_reads(spark, sf_dir), g.nodes).withColumn("before", before)
    return rows.select(
        "aln_id", F.col("op_no").cast("long").alias("op_no"), "pos", mapping.query_len().alias("query_len"), mapping.target_len().alias("target_len"), mapping.is_at_start().alias("at_start"),
        mapping.is_at_end().alias("at_end"), F.coalesce(mapping.follows(F.col("before")), F.lit(False)).alias("follows"))


CLIPPED_RUNS = f"""m1 AS (SELECT *, FLOOR(handle/2) BETWEEN {LO} AND {HI} AS inside FROM mp), m2 AS (SELECT *, SUM(apart) OVER (PARTITION BY aln_id ORDER BY op_no, pos) AS run FROM (SELECT *, CASE WHEN inside = LAG(inside) OVER (PARTITION BY aln_id ORDER BY op_no, pos) THEN 0 ELSE 1 END AS apart FROM m1) z)"""


@query(f""", {MAPPINGS}, {CLIPPED_RUNS},
f1 AS (SELECT aln_id, run, MIN(query_start) AS seq_start, CAST(MAX(query_start + CASE WHEN op = '-' THEN 0 ELSE len END) AS BIGINT) AS seq_end, arg_min(node_start, op_no * 100000 + pos) AS path_start,
 arg_max(node_end, op_no * 100000 + pos) AS last_end, arg_max(node_len, op_no * 100000 + pos) AS last_len FROM m2 WHERE inside GROUP BY aln_id, run),
f2 AS (SELECT aln_id, run, string_agg(CAST(handle AS VARCHAR), ',' ORDER BY pos) AS path, CAST(SUM(node_len) AS BIGINT) AS path_len FROM (SELECT DISTINCT aln_id, run, pos, handle, node_len FROM m2 WHERE inside) a GROUP BY aln_id, run),
d1 AS (SELECT *, SUM(new) OVER (PARTITION BY aln_id, run ORDER BY op_no, pos) AS g FROM (SELECT *, CASE WHEN op <> '*' AND op = LAG(op) OVER (PARTITION BY aln_id, run ORDER BY op_no, pos) THEN 0 ELSE 1 END AS new FROM m2 WHERE inside) b),
d2 AS (SELECT aln_id, run, string_agg(concat(op, CAST(len AS VARCHAR)), '' ORDER BY g) AS diff FROM (SELECT aln_id, run, g, MIN(op) AS op, CAST(SUM(len) AS BIGINT) AS len FROM d1 GROUP BY aln_id, run, g) c WHERE len > 0 GROUP BY aln_id, run)
SELECT aln_id, seq_start, seq_end, path, path_len, path_start, path_len - last_len + last_end AS path_end, diff,
 CASE WHEN COUNT(*) OVER (PARTITION BY aln_id) > 1 OR seq_start > 0 OR seq_end < r.seq_len THEN ROW_NUMBER() OVER (PARTITION BY aln_id ORDER BY run) END AS fragment
FROM f1 JOIN f2 USING (aln_id, run) JOIN d2 USING (aln_id, run) JOIN (SELECT aln_id, seq_len FROM reads) r USING (aln_id)""")
def reads_clipped(g, spark, sf_dir):
    rows = R.clip(_reads(spark, sf_dir), g.nodes, region(g))
    path = F.array_join(F.transform("path", lambda h: h.cast("string")), ",").alias("path")
    diff = F.array_join(F.transform("diff", lambda d: F.concat(d["op"], d["len"].cast("string"))), "").alias("diff")
    return rows.select("aln_id", "seq_start", "seq_end", path, "path_len", "path_start", "path_end", diff, "fragment")


@query("SELECT aln_id, ROW_NUMBER() OVER (ORDER BY min_handle NULLS LAST, max_handle, aln_id) AS rank FROM reads")
def gaf_sort_interval(g, spark, sf_dir):
    """The place of each line in the sorted text."""
    lines = fixtures.lines(spark, sf_dir).withColumnRenamed("aln_id", "line_no")
    ranked = numbered(R.sort_lines(lines).select("line_no"), "rank")
    return ranked.select(F.col("line_no").alias("aln_id"), (F.col("rank") + 1).alias("rank"))


@query("SELECT COUNT(*) AS n, COUNT(DISTINCT line) AS lines FROM lines")
def gaf_sort_hash_count(g, spark, sf_dir):
    lines = fixtures.lines(spark, sf_dir).withColumnRenamed("aln_id", "line_no")
    return R.sort_lines(lines, by_hash=True).agg(F.count("*").alias("n"), F.countDistinct("value").alias("lines"))


@query("SELECT line_no, line_no < 3 AS is_header FROM (SELECT event_id AS line_no FROM events) x WHERE line_no < 3")
def header_vs_data_lines(g, spark, sf_dir):
    lines = fixtures.lines(spark, sf_dir).select(F.col("aln_id").alias("line_no"), F.when(F.col("aln_id").isin(0, 1, 2, 7), F.concat(F.lit("@"), "value")).otherwise(F.col("value")).alias("value"))
    return text_io.headers(lines).select("line_no", F.lit(True).alias("is_header"))


@query("SELECT aln_id, path_len, CAST(CASE WHEN cs IS NULL THEN 0 WHEN edits = 0 THEN 1 ELSE 3 END AS BIGINT) AS ops FROM reads WHERE path_len <> 1")
def alignment_store_roundtrip(g, spark, sf_dir):
    rows = R.roundtrip(_reads(spark, sf_dir), g.nodes)
    return rows.select("aln_id", "path_len", F.size("diff").cast("long").alias("ops"))


@query(f""", {MAPPINGS}, {BLOCKS}, {CLIPPED_RUNS} SELECT (SELECT COUNT(DISTINCT aln_id) FROM tk WHERE CAST(substr(tok, 2) AS BIGINT) BETWEEN {LO} AND {HI}) AS reads,
(SELECT COUNT(DISTINCT (aln_id, run)) FROM m2 WHERE inside) AS fragments, (SELECT COUNT(*) FROM bs WHERE min_handle <= {2 * HI + 1} AND max_handle >= {2 * LO}) AS blocks""")
def read_counters(g, spark, sf_dir):
    """Reads that overlap a region, the fragments of them inside it, and the blocks whose handle range meets it."""
    ids = region(g)
    found = R.select(_reads(spark, sf_dir), ids)
    met = R.blocks_meeting(R.block_summary(_blocked(spark, sf_dir)), locate.clusters(ids, gap=1000))
    return R.counters(found, R.clip(found, g.nodes, ids), met)


def _store_folder(spark: SparkSession, name: str) -> str:
    import uuid

    ensure_checkpoint(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def _as_file(ordered: DataFrame, kind: str) -> str:
    """Writes sorted lines (value) as zipped parts and returns their folder."""
    spark = ordered.sparkSession
    formats.register(spark)
    path = _store_folder(spark, kind)
    ordered.write.format(kind).option("compression", "gzip").mode("append").save(path)
    return path


@query("SELECT aln_id, concat('r', CAST(aln_id AS VARCHAR)) AS name, line FROM lines")
def gaf_file_source(g, spark, sf_dir):
    """The reads as a zipped file, read back by ranges; header lines are left out as the file is read."""
    lines = fixtures.lines(spark, sf_dir).unionByName(spark.createDataFrame([(-1, "@HD\tVN:Z:1.0")], "aln_id long, value string"))
    path = _as_file(lines.orderBy("aln_id").select("value"), "gaf")
    rows = spark.read.format("gaf").option("splitBytes", 1 << 20).load(path).where("kind = 'r'")
    return rows.select(F.substr("name", F.lit(2)).cast("long").alias("aln_id"), "name", F.col("value").alias("line"))


@query(f"SELECT 'S' AS kind, CAST(node_id AS VARCHAR) AS name, concat('S', chr(9), CAST(node_id AS VARCHAR), chr(9), sequence) AS line FROM nodes UNION ALL SELECT 'L', CAST({NODE.format(h='src')} AS VARCHAR), {EDGE_TEXT} FROM edges WHERE {CANONICAL}")
def gfa_file_source(g, spark):
    """The nodes and edges of the whole graph as a zipped file, read back by ranges without its header."""
    path = _as_file(walks.in_order(walks.gfa_lines(g.nodes, g.edges, None)), "gfa")
    return spark.read.format("gfa").load(path).where("kind in ('S', 'L')").select("kind", "name", F.col("value").alias("line"))


@query("SELECT concat('c', CAST(path_handle AS VARCHAR)) AS sample, step, handle, step_start, step_end FROM offsets")
def gfa_reader(g, spark):
    """The whole graph with all its paths as a zipped file, read as a graph: the steps of its paths with their offsets."""
    whole = g.steps.groupBy("path_handle").agg(F.sort_array(F.collect_list(F.struct("step", "handle")))["handle"].alias("walk"))
    named = whole.join(g.paths, "path_handle").select("walk", F.lit(False).alias("is_ref"), "sample", "contig", "haplotype", F.lit(0).cast("long").alias("start"), F.col("path_len").alias("end"))
    read = text_io.read_gfa(spark, _as_file(walks.in_order(walks.gfa_lines(g.nodes, g.edges, named)), "gfa"))
    return read.steps.join(read.paths.select("path_handle", "sample"), "path_handle").select("sample", (F.col("step") + 1).alias("step"), "handle", "step_start", "step_end")


@query(INDEX + """ SELECT 'nodes' AS name, COUNT(*) AS n FROM nodes UNION ALL SELECT 'edges', COUNT(*) FROM edges UNION ALL SELECT 'steps', COUNT(*) FROM offsets UNION ALL SELECT 'paths', COUNT(*) FROM paths
UNION ALL SELECT 'chain_links', COUNT(*) FROM links UNION ALL SELECT 'reference_index', COUNT(*) FROM ix""")
def graph_store(g, spark, sf_dir):
    """Builds a graph store, opens it, and counts the rows of its tables."""
    path = _store_folder(spark, "graph")
    store.write_graph(g, path, 20)
    opened = store.open_graph(spark, path)
    tables = {n: getattr(opened, n) for n in ("nodes", "edges", "steps", "paths", "chain_links")} | {"reference_index": spark.read.parquet(f"{path}/reference_index")}
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, df in tables.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f", {BLOCKS}, {TOKENS} SELECT 'alignments' AS name, COUNT(*) AS n FROM bl UNION ALL SELECT 'blocks', COUNT(*) FROM bs UNION ALL SELECT 'nodes', COUNT(DISTINCT CAST(substr(tok, 2) AS BIGINT)) FROM tk")
def alignment_store(g, spark, sf_dir):
    """Builds a store of alignments, opens it, and counts its reads, blocks and visited nodes."""
    path = _store_folder(spark, "reads")
    store.write_alignments(_reads(spark, sf_dir).drop("error"), path, store.AlignmentParams(block_size=50))
    opened = store.open_alignments(spark, path)
    count = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return count(opened.alignments, "alignments").unionByName(count(opened.blocks, "blocks")).unionByName(count(opened.nodes, "nodes"))


READ_VISITS = """rv AS (SELECT aln_id AS seq, pos AS idx, {handle} AS handle FROM tk), rl AS (SELECT seq, list(handle ORDER BY idx DESC) AS back, MAX(idx) AS top FROM rv GROUP BY seq),
rr AS (SELECT seq, idx, handle, ROW_NUMBER() OVER (PARTITION BY handle ORDER BY list_append(back[top - idx + 2:], seq - 1000000000000)) - 1 AS "offset" FROM rv JOIN rl USING (seq))"""


def _position_store(spark, sf_dir) -> str:
    path = _store_folder(spark, "positions")
    store.write_alignments(_reads(spark, sf_dir).drop("error"), path, store.AlignmentParams(block_size=50, start_positions=True))
    return path


@query(f", {TOKENS}, {READ_VISITS.format(handle=HANDLE)} SELECT aln_id, rr.handle AS start_handle, rr.\"offset\" AS start_offset FROM reads LEFT JOIN rr ON rr.seq = aln_id AND rr.idx = 0")
def read_start_positions(g, spark, sf_dir):
    """What a store keeps of the paths of reads: the first visit of each."""
    return spark.read.parquet(f"{_position_store(spark, sf_dir)}/alignments").select("aln_id", "start_handle", "start_offset")


@query("SELECT aln_id, path, min_handle, max_handle FROM reads")
def read_paths_restored(g, spark, sf_dir):
    """All paths of a store that keeps positions, restored by jumps."""
    rows = store.open_alignments(spark, _position_store(spark, sf_dir)).alignments
    return rows.select("aln_id", F.when(F.size("path") > 0, walk_text(F.col("path"))).otherwise("*").alias("path"), "min_handle", "max_handle")


@query(f""", {fixtures.NATIONS}, nh AS (SELECT DISTINCT base, src AS gone FROM ne),
 reached AS (SELECT base, gone, 2*base AS handle FROM nh WHERE gone <> 2*base UNION SELECT r.base, r.gone, e.dst FROM reached r JOIN ne e ON e.src = r.handle AND e.dst <> r.gone),
 doms AS (SELECT DISTINCT base, h AS handle FROM (SELECT base, gone AS h FROM nh UNION SELECT base, 2*(base + 999999) FROM nh) c WHERE NOT EXISTS (SELECT 1 FROM reached r WHERE r.base = c.base AND r.gone = h AND r.handle = 2*(r.base + 999999))),
 placed AS (SELECT d.base, d.handle, CASE WHEN d.handle % 1000000 = 999998 AND d.handle = 2*(d.base + 999999) THEN 1000000000 ELSE (SELECT COUNT(*) FROM reached r JOIN doms o ON o.base = r.base AND o.handle = r.handle WHERE r.base = d.base AND r.gone = d.handle) END AS place FROM doms d),
 found AS (SELECT handle, LEAD(handle) OVER (PARTITION BY base ORDER BY place) AS next FROM placed)
 SELECT handle, next FROM found WHERE next IS NOT NULL UNION ALL SELECT {FLIP.format(h='next')}, {FLIP.format(h='handle')} FROM found WHERE next IS NOT NULL""")
def chain_discovery(g, spark, sf_dir):
    """The chains of a graph with a component for each nation; the SQL takes each handle away and looks what is still reached."""
    return chains.discover_chains(fixtures.nations(spark, sf_dir))


def _by_path(g: Graph, output: str) -> DataFrame:
    row = g.paths.where("path_handle = 10").first()
    q = SubgraphQuery.path_offset(row.contig, 33, sample=row.sample, haplotype=row.haplotype).with_(context=12, output=output)
    return run(g, q).walks


POSITION = CONTEXT.format(seeds="SELECT CAST(FLOOR(o.handle/2) AS BIGINT) AS n, CASE WHEN k = 0 THEN o.handle % 2 ELSE 1 - o.handle % 2 END AS s, CASE WHEN k = 0 THEN 33 - o.step_start ELSE o.step_end - 34 END AS d FROM offsets o CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) z WHERE o.path_handle = 10 AND o.step_start <= 33 AND 33 < o.step_end", limit=12).split(" SELECT n AS node_id")[0]
QUERIED = WALKS.replace(f"FLOOR(handle/2) BETWEEN {LO} AND {HI}", "CAST(FLOOR(handle/2) AS BIGINT) IN (SELECT n FROM ctx)").replace("step = 9", "step_start <= 33 AND step_end > 33")


@query(f", {POSITION}, {QUERIED} SELECT walk, COUNT(*) AS weight, bool_or(is_ref) AS is_ref, MIN(len) AS len FROM wk GROUP BY walk")
def path_offset_query(g):
    """Locate, expand by a context, list distinct haplotypes with weights: a whole query."""
    return _by_path(g, DISTINCT).select(walk_text(F.col("walk")).alias("walk"), "weight", "is_ref", "len")


@query(f", {POSITION}, {QUERIED} SELECT walk, len FROM wk WHERE is_ref")
def path_offset_reference(g):
    return _by_path(g, REFERENCE).select(walk_text(F.col("walk")).alias("walk"), "len")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


